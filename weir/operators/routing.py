"""Deterministic routing of messages to shards, as an explicit shard column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.ordering import with_position

STRATEGIES = ("round_robin", "hash", "broadcast")


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a of a binary column, as a LONG."""
    bytes_of = F.filter(F.split(F.decode(key, "ISO-8859-1"), ""), lambda c: c != "")  # a character for each byte
    return F.aggregate(bytes_of, F.lit(2166136261).cast("long"), lambda h, b: h.bitwiseXOR(F.ascii(b).cast("long")) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long"))


def route_round_robin(df: DataFrame, shards: int, order_by: str, producer: str | None = None) -> DataFrame:
    """shard = position modulo shards, counted for each producer."""
    rows = with_position(df, order_by, "_turn", [producer] if producer else None)
    return rows.withColumn("shard", F.pmod("_turn", F.lit(shards)).cast("int")).drop("_turn")


def route_hash(df: DataFrame, shards: int, key: str) -> DataFrame:
    """shard by FNV-1a of the key's bytes: equal keys meet, and keep their order."""
    return df.withColumn("shard", F.pmod(fnv1a32(F.col(key).cast("binary")), F.lit(shards)).cast("int"))


def route_broadcast(df: DataFrame, shards: int) -> DataFrame:
    """A copy of each row for every shard."""
    return df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def route(df: DataFrame, strategy: str, shards: int, order_by: str | None = None, key: str | None = None, producer: str | None = None) -> DataFrame:
    if shards < 1:
        raise ValueError("at least one shard")
    if strategy == "round_robin":
        if not order_by:
            raise ValueError("round_robin needs order_by")
        return route_round_robin(df, shards, order_by, producer)
    if strategy == "hash":
        return route_hash(df, shards, key or "payload")
    if strategy == "broadcast":
        return route_broadcast(df, shards)
    raise ValueError(f"strategy is one of {STRATEGIES}")


def shard(df: DataFrame, index: int) -> DataFrame:
    """The rows of one shard."""
    if isinstance(index, bool) or not isinstance(index, int) or index < 0:
        raise IndexError(index)
    return df.where(F.col("shard") == index)


def receive_any(df: DataFrame, order_by: str) -> DataFrame:
    """Rows with `turn`: the order in which a reader that polls the shards in rotation gets them."""
    rows = with_position(df, order_by, "_at", ["shard"])
    turn = Window.partitionBy("_at").orderBy("shard")  # at most a row per shard
    width = rows.select(F.max("shard")).first()[0] or 0
    return rows.withColumn("turn", F.col("_at") * (width + 1) + F.row_number().over(turn) - 1).drop("_at")


def shard_stats(df: DataFrame, payload: str = "payload") -> DataFrame:
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("queue_depth"), F.sum(F.octet_length(payload)).alias("payload_bytes"))
