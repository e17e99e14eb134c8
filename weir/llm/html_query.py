"""op9: main text of all pages."""

from pyspark.sql import DataFrame, SparkSession

from weir.llm.html_text import extract_text

NAME = "op9_text_density"
SQL = None  # a tree walk; tests compare with pages of known text


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
