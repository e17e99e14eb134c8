"""op4: near-duplicate groups of all documents by the Jaccard similarity of five-word shingles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.jaccard import jaccard_groups

NAME = "op4_vertical_jaccard"
SQL = None  # components; tests compare with a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
