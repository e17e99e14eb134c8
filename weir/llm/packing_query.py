"""op10: all documents into sequences of at most 4096 tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.bpe import encode
from weir.llm.packing import cut_pieces, pack

NAME = "op10_least_squares_packing"
SQL = None  # a fitted plan; tests check the packing laws and the padding
TOKENIZER, WINDOW, END = "word_bpe_49k.json", 4096, 2


def packed(docs: DataFrame) -> DataFrame:
    tokens = encode(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return pack(cut_pieces(tokens, WINDOW, END), WINDOW).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; a null text is empty and has only the end id."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
