"""op6: bytes of 50-byte strings that a smaller document already has, removed from all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.suffixes import remove_repeats

NAME = "op6_induced_suffixes"
SQL = None  # byte strings; tests compare with a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
