"""op3: license scan of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.licenses import license_scan

NAME = "op3_license_diagonals"
SQL = None  # votes by diagonal over hashed k-grams; tests compare with a brute-force scan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs).select(F.col("id").alias("doc_id"), *"n_words n_base first_word last_word base_labels labels score n_spans".split())
