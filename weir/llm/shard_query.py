"""op8: all documents into 40 shards, counts at most one apart, equal texts together."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import ranked, stash
from weir.llm.sharding import balanced_shards

NAME = "op8_label_propagation"
SQL = None  # iterative; tests check the law, the slots and the cut
SHARDS = 40


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; a null text is empty and linked with nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = docs.select(
        F.monotonically_increasing_id().alias("row"),  # written once: doc_id may be null or repeated
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("link"),
    )
    facts = stash(facts, "facts")
    placed = balanced_shards(facts, SHARDS, id_col="row", link_col="link").select(F.col("id").alias("row"), "shard")
    placed = ranked(stash(placed, "shards"), ["shard"], ["row"], "slot", max(1, facts.count() // SHARDS))
    return facts.join(placed, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
