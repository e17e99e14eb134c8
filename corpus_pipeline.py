"""The corpus pipeline: quality rules, line dedup, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import stash
from weir.llm.jaccard import jaccard_groups
from weir.llm.line_chunks import dedup_lines
from weir.llm.packing_query import packed
from weir.llm.quality import document_statistics, quality_rules
from weir.llm.suffixes import remove_repeats


def _plain(docs: DataFrame) -> DataFrame:
    """docs with columns named by their place, so that no operator's names clash with them."""
    return docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))


def _as_before(out: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """out, in columns named by their place, as the columns of documents again, with this text and its n_chars."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col(f"c{n}")).alias(c) for n, c in enumerate(columns)])


def _worded(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are told apart by id and content, so equal rows stay or go together;
    null ids count as an id."""
    fields = [F.col("doc_id"), F.xxhash64("text", F.lit(0), "lang", F.lit(1), "source")]
    row = F.struct(*[f.alias(n) for f, n in zip(fields, ("i", "h"), strict=True)])
    keyed = docs.select(row.alias("row"), "text", "lang", "source")
    kept = quality_rules(document_statistics(keyed, id_col="row")).where("kept").select("id.*").toDF("_kept_i", "_kept_h")
    bare = _plain(docs)
    place = {c: F.col(f"c{n}") for n, c in enumerate(docs.columns)}
    same = place["doc_id"].eqNullSafe(F.col("_kept_i")) & (F.xxhash64(place["text"], F.lit(0), place["lang"], F.lit(1), place["source"]) == F.col("_kept_h"))
    return bare.join(kept, same, "left_semi").toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; a document of which no word is left goes with them. Null ids stay as they are."""
    i, t = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    return _worded(_as_before(dedup_lines(_plain(docs), i, t), docs.columns, F.col(t)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id. Rows of one id stay or go together;
    those with a null id stay."""
    groups = jaccard_groups(docs.select("doc_id", "text"))
    first = groups.groupBy("id").agg(F.min("component_id").alias("least")).where("id <=> least").select(F.col("id").alias("_kept"))
    own = F.col(f"c{docs.columns.index('doc_id')}")
    return _plain(docs).join(first, own.eqNullSafe(F.col("_kept")), "left_semi").toDF(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that a smaller document already has go, and what is then no whole character with them. Rows of one
    id lose nothing to each other; those with a null id stay as they are."""
    bare = _plain(docs)
    i, t = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    out = remove_repeats(bare, id_col=i, text_col=t, keep=tuple(c for c in bare.columns if c != t))
    text = F.col("kept").cast("string")
    whole = F.coalesce(F.try_validate_utf8(text), F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    return _worded(_as_before(out, docs.columns, whole))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("suffix_array", passages),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL can't express its stages; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
