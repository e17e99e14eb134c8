"""op2: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.quality import document_statistics, quality_rules

NAME = "op2_mcd_quality"
SQL = None  # iterated estimates; tests compare with a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality_rules(document_statistics(docs))
    return out.select(F.col("id").alias("doc_id"), *"n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept distance".split())
