"""op5: near-duplicate vectors within labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.embeddings import near_vectors

NAME = "op5_pivot_permutations"
SQL = None  # an index; tests measure its recall against all pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
