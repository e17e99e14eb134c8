"""Ingest rule: numeric and boolean columns become doubles, other columns are dropped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALAR = "x"


def numeric(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The numeric and boolean columns as doubles (NULL: a missing key), and the `keep` columns as they are under a prefix."""
    kinds = (T.NumericType, T.BooleanType)
    kept = [F.col(f"`{c}`").alias(f"_key_{c}") for c in keep]
    return df.select(*kept, *[F.col(f"`{f.name}`").cast("double").alias(f.name) for f in df.schema.fields if isinstance(f.dataType, kinds)])


def from_items(spark: SparkSession, items: Iterable) -> tuple[DataFrame, bool]:
    """(rows with `_key_seq`, whether the items are scalars) from numbers or dicts of numbers.

    Dict values that aren't numbers are dropped; a bare item that isn't one raises ValueError. Dicts have the union of their keys.
    """
    rows = list(items)
    scalars = [not isinstance(r, dict) for r in rows]
    if any(scalars) and not all(scalars):
        raise ValueError("a stream holds numbers or dicts, not both")
    if any(scalars):
        for r in rows:
            if isinstance(r, str | bytes) or not hasattr(r, "__float__") and not hasattr(r, "__index__"):
                raise ValueError(f"{r!r} is neither a number nor a dict")
        data = [(n, float(r)) for n, r in enumerate(rows)]
        return spark.createDataFrame(data, f"_key_seq long, {SCALAR} double"), True
    clean = [{k: float(v) for k, v in r.items() if isinstance(k, str) and not isinstance(v, str | bytes) and hasattr(v, "__float__")} for r in rows]
    names = list(dict.fromkeys(k for r in clean for k in r))
    schema = T.StructType([T.StructField("_key_seq", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    return spark.createDataFrame([(n, *[r.get(k) for k in names]) for n, r in enumerate(clean)], schema), False
