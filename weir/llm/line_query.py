"""op7: repeated multi-line chunks removed from all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.line_chunks import dedup_lines

NAME = "op7_line_chunks"
SQL = None  # rolling hashes; tests compare with a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (of the input; null text: 0), n_removed (lines), kept_chars, kept_sha256 (null for a null text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    out = dedup_lines(docs.withColumn("n_lines", lines.cast("long")))
    return out.select("doc_id", "n_lines", F.col("lines_removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
