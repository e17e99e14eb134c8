"""op1: encode every document, decode it again, digest both."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.bpe import decode, encode

NAME = "op1_tree_bpe"
SQL = None  # tests compare with the tokenizers library on whole texts
TOKENIZER = "word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs, path), path)
    return both.select(
        F.col("id").alias("doc_id"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
