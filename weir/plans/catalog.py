"""Named queries over the driver tables and the DuckDB SQL each must agree with.

A query takes (spark, sf_dir) and covers its whole table. The SQL is written for itself, not derived from the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators import messages as M
from weir.operators import routing as R
from weir.plans.pipeline import Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EPS = "2.220446049250313e-16"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- expressions ---


@query("SELECT coalesce(l_extendedprice * (1 - l_discount) + l_tax, 'nan'::DOUBLE) AS x FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def filter_map_expr(spark, d):
    """The flagship: filter and map, one whole-stage-codegen stage with both conjuncts pushed to the scan."""
    p = Pipeline().filter_expr("l_quantity > 25 and l_discount < 0.05").map_expr("l_extendedprice * (1 - l_discount) + l_tax")
    return p.apply(table(spark, d, "lineitem"))


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_tax FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_tax < 0.04")
def filter_expr_conj(spark, d):
    p = Pipeline().filter_expr("l_quantity >= 10 and l_quantity <= 20 and l_tax < 0.04").select("l_orderkey", "l_quantity", "l_tax")
    return p.apply(table(spark, d, "lineitem"))


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_discount FROM lineitem WHERE l_quantity > 45 OR (CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) > 0.5")
def filter_expr_or_not(spark, d):
    """`not` binds tighter than the comparison."""
    p = Pipeline().filter_expr("l_quantity > 45 or not l_discount > 0.5").select("l_orderkey", "l_discount")
    return p.apply(table(spark, d, "lineitem"))


@query("SELECT l_extendedprice / nullif(l_quantity, 0) AS x FROM lineitem WHERE l_quantity <> 0")
def map_expr_div(spark, d):
    return Pipeline().filter_expr("l_quantity > 0").map_expr("l_extendedprice / l_quantity").apply(table(spark, d, "lineitem"))


@query("SELECT value AS x FROM events WHERE false")
def filter_div_by_zero(spark, d):
    """A zero divisor is a missing value, and `or` doesn't save the row."""
    return Pipeline().filter_expr("1 or value / 0").map_expr("value").apply(table(spark, d, "events"))


@query("SELECT value FROM events WHERE false")
def filter_missing_column(spark, d):
    return Pipeline().filter_expr("nonexistent > 1 or value > 0").select("value").apply(table(spark, d, "events"))


@query("SELECT v * v - 0.5 AS x FROM (SELECT value / 10 AS v FROM events) WHERE v > 2 AND v * v > 10")
def map_chain_scalar(spark, d):
    p = Pipeline().map_expr("value / 10").filter_expr("x > 2").filter_expr("x * x > 10").map_expr("x * x - 0.5")
    return p.apply(table(spark, d, "events"))


@query(f"SELECT l_orderkey::DOUBLE AS l_orderkey, l_discount, l_tax FROM lineitem WHERE abs(l_discount - l_tax) < {EPS}")
def eq_epsilon(spark, d):
    return Pipeline().filter_expr("l_discount == l_tax").select("l_orderkey", "l_discount", "l_tax").apply(table(spark, d, "lineitem"))


@query(f"SELECT CASE WHEN abs(l_discount - l_tax) >= {EPS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM lineitem")
def neq_epsilon(spark, d):
    return Pipeline().map_expr("l_discount != l_tax").apply(table(spark, d, "lineitem"))


@query("SELECT CASE WHEN s_acctbal < 0 THEN -(-s_acctbal) ELSE -s_acctbal END * CASE WHEN s_acctbal < 0 THEN 1 ELSE -1 END AS x FROM supplier")
def unary_minus(spark, d):
    """Prefix operators repeat."""
    return Pipeline().map_expr("--s_acctbal").apply(table(spark, d, "supplier"))


@query("SELECT (CASE WHEN p_size > 25 AND p_retailprice < 1500 THEN 1 ELSE 0 END + CASE WHEN p_size <= 5 OR p_size >= 45 THEN 1 ELSE 0 END)::DOUBLE AS x FROM part")
def boolean_values(spark, d):
    return Pipeline().map_expr("(p_size > 25 and p_retailprice < 1500) + (p_size <= 5 or p_size >= 45)").apply(table(spark, d, "part"))


# --- columns, functions, batches ---


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders")
def select_cols(spark, d):
    """Unknown and non-numeric columns are left out."""
    return Pipeline().select("o_orderkey", "o_totalprice", "o_orderstatus", "unknown").apply(table(spark, d, "orders"))


@query("SELECT c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey, c_acctbal FROM customer")
def ingest_numeric(spark, d):
    return Pipeline.identity().apply(table(spark, d, "customer"))


@query("SELECT list(value ORDER BY event_id)::VARCHAR AS items FROM (SELECT event_id, value::DECIMAL(18, 2) AS value, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS b FROM events WHERE value > 50) GROUP BY b")
def batch_64(spark, d):
    """Batches of 64 in event order after a filter."""
    rows = Pipeline().filter_expr("value > 50").map_expr("value").batch(64).apply(table(spark, d, "events"), "event_id")
    return rows.select(F.concat(F.lit("["), F.array_join(F.transform("items", lambda v: v.cast("decimal(18,2)").cast("string")), ", "), F.lit("]")).alias("items"))


@query("SELECT n, count(*)::BIGINT AS batches FROM (SELECT count(*)::INT AS n FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 16 AS b FROM events WHERE value > 30) GROUP BY b) GROUP BY n")
def batch_sizes(spark, d):
    rows = Pipeline().filter_expr("value > 30").map_expr("value").batch(16).apply(table(spark, d, "events"), "event_id")
    return rows.groupBy(F.size("items").alias("n")).agg(F.count(F.lit(1)).alias("batches"))


@query("SELECT value * 2 + 1 AS x FROM events WHERE value > 20")
def map_py(spark, d):
    p = Pipeline().select("value").filter_py(lambda r: r["value"] > 20).map_py(lambda r: r["value"] * 2 + 1)
    return p.apply(table(spark, d, "events"))


@query("SELECT event_id::DOUBLE AS event_id, value FROM events WHERE value > 90")
def filter_py(spark, d):
    return Pipeline().select("event_id", "value").filter_py(lambda r: r["value"] > 90).apply(table(spark, d, "events"))


@query("SELECT value + 1 AS a, value * 3 AS b FROM events")
def map_py_dict(spark, d):
    p = Pipeline().select("value").map_py(lambda r: {"a": r["value"] + 1, "b": r["value"] * 3}, columns=["a", "b"])
    return p.apply(table(spark, d, "events"))


@query("SELECT v AS x FROM (SELECT value * 10 AS v FROM events) WHERE v > 500")
def map_filter_py_batch(spark, d):
    """Element functions inside batches of 32; the oracle compares their elements."""
    p = Pipeline().map_expr("value").batch(32).map_py_batch(lambda x: x * 10).filter_py_batch(lambda x: x > 500)
    return p.apply(table(spark, d, "events"), "event_id").select(F.explode("items").alias("x"))


@query("SELECT round(sum(v), 6) AS total, count(*)::BIGINT AS batches FROM (SELECT sum(value) AS v FROM (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 3 AS b FROM events) GROUP BY b)")
def batch_sum_py(spark, d):
    rows = Pipeline().map_expr("value").batch(3).map_py(sum).apply(table(spark, d, "events"), "event_id")
    return rows.agg(F.round(F.sum("x"), 6).alias("total"), F.count(F.lit(1)).alias("batches"))


@query("SELECT unnest([value, -value]) AS x FROM events")
def flat_map(spark, d):
    return Pipeline().flat_map(lambda c: F.array(c["value"], -c["value"])).apply(table(spark, d, "events"))


# --- routing ---


def _messages(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("producer"), F.col("event_type").alias("key"), F.encode("props", "UTF-8").alias("payload"))


@query("SELECT event_id AS seq, ((row_number() OVER (ORDER BY event_id) - 1) % 4)::INT AS shard FROM events")
def route_round_robin(spark, d):
    return R.route_round_robin(_messages(spark, d), 4, "seq").select("seq", "shard")


@query("SELECT event_id AS seq, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3)::INT AS shard FROM events")
def route_round_robin_producers(spark, d):
    return R.route_round_robin(_messages(spark, d), 3, "seq", "producer").select("seq", "shard")


@query("SELECT event_id AS seq, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(event_type) + 1), lambda i: ord(event_type[i])::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 4)::INT AS shard FROM events")
def route_hash(spark, d):
    return R.route_hash(_messages(spark, d), 4, "key").select("seq", "shard")


@query("SELECT event_id AS seq, s::INT AS shard FROM events, range(3) t(s)")
def route_broadcast(spark, d):
    return R.route_broadcast(_messages(spark, d), 3).select("seq", "shard")


@query("SELECT s::INT AS shard, count(*)::BIGINT AS queue_depth, sum(strlen(props))::BIGINT AS payload_bytes FROM (SELECT props, (row_number() OVER (ORDER BY event_id) - 1) % 4 AS s FROM events) GROUP BY s")
def shard_stats(spark, d):
    return R.shard_stats(R.route_round_robin(_messages(spark, d), 4, "seq"))


@query("SELECT event_id AS seq, (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS turn FROM events")
def receive_any(spark, d):
    """Shards filled in rotation are read back in the order they were sent."""
    return R.receive_any(R.route_round_robin(_messages(spark, d), 4, "seq"), "seq").select("seq", "turn")


# --- message tables ---


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("payload"))


_PLAN = "CASE WHEN strlen(text) <= 1024 THEN 1 ELSE ceil(strlen(text) / 982.0) END"


@query(f"SELECT doc_id AS seq, ({_PLAN})::BIGINT AS n_slots, ({_PLAN}) > 16 AS too_large FROM documents")
def chunk_plan(spark, d):
    return M.chunk_plan(_texts(spark, d), 1024, 16).select("seq", "n_slots", "too_large")


@query(
    "SELECT doc_id AS seq, i::INT AS chunk_index, n::INT AS chunk_total, size::BIGINT AS message_len, least(step, size - i * step)::BIGINT AS chunk_len FROM "
    "(SELECT doc_id, strlen(text) AS size, CASE WHEN strlen(text) <= 4096 THEN 1 ELSE ceil(strlen(text) / 4054.0)::INT END AS n, CASE WHEN strlen(text) <= 4096 THEN strlen(text) ELSE 4054 END AS step FROM documents), unnest(range(n)) t(i)"
)
def chunk_split(spark, d):
    rows = M.chunk_split(_texts(spark, d), 4096)
    return rows.select("seq", "chunk_index", "chunk_total", F.col("message_len").cast("long").alias("message_len"), F.length("chunk").cast("long").alias("chunk_len"))


@query("SELECT doc_id AS seq, sha256(text) AS payload_sha256, true AS valid FROM documents")
def chunk_roundtrip(spark, d):
    rows = M.chunk_join(M.chunk_split(_texts(spark, d), 1024))
    return rows.select("seq", F.sha2("payload", 256).alias("payload_sha256"), "valid")


@query("SELECT 4096::BIGINT AS slot_size, 64::BIGINT AS capacity, greatest(4096, 64 * (4096 - 42))::BIGINT AS max_message")
def message_limits(spark, d):
    return spark.range(1).select(F.lit(4096).cast("long").alias("slot_size"), F.lit(64).cast("long").alias("capacity"), F.lit(M.max_message(4096, 64)).cast("long").alias("max_message"))


@query("SELECT event_id AS seq FROM events ORDER BY event_id LIMIT 500")
def drop_newest(spark, d):
    """Capacity is the feature: the first 500 messages stay."""
    return M.drop_newest(_messages(spark, d), 500).select("seq")


@query("SELECT event_id AS seq FROM events ORDER BY event_id DESC LIMIT 500")
def drop_oldest(spark, d):
    return M.drop_oldest(_messages(spark, d), 500).select("seq")


@query(
    "SELECT doc_id AS seq FROM (SELECT doc_id, sum(n) OVER (ORDER BY doc_id DESC) AS used FROM (SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN 1 ELSE ceil(strlen(text) / 4054.0) END AS n FROM documents)) WHERE used <= 64"
)
def drop_oldest_chunked(spark, d):
    return M.drop_oldest(_texts(spark, d), 64, 4096).select("seq")


@query(
    "WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, (CASE WHEN strlen(text) <= 4096 THEN 1 ELSE ceil(strlen(text) / 4054.0) END)::BIGINT AS n FROM documents), "
    "f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS used, NULL::BIGINT AS seq UNION ALL SELECT m.r, CASE WHEN f.used + m.n <= 64 THEN f.used + m.n ELSE f.used END, CASE WHEN f.used + m.n <= 64 THEN m.doc_id END FROM f JOIN m ON m.r = f.r + 1) "
    "SELECT seq FROM f WHERE seq IS NOT NULL"
)
def drop_newest_chunked(spark, d):
    """Once a message finds no room, a later and smaller one still may."""
    return M.drop_newest(_texts(spark, d), 64, 4096).select("seq")


@query("SELECT prev + 1 AS expected, event_id AS seq, event_id - prev - 1 AS missing FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS prev FROM events WHERE event_type <> 'view') WHERE event_id - prev <> 1")
def seq_gap(spark, d):
    return M.sequence_gaps(_messages(spark, d).where("key <> 'view'"))


@query("SELECT count(*)::BIGINT AS queue_depth, (max(event_id) + 1)::BIGINT AS next_sequence, min(event_id)::BIGINT AS expected_recv_sequence, false AS empty FROM events")
def channel_stats(spark, d):
    return M.channel_stats(_messages(spark, d), 1 << 20, 4096).select("queue_depth", "next_sequence", "expected_recv_sequence", "empty")


@query("SELECT event_id AS seq, true AS good FROM events")
def checksum_verify(spark, d):
    good, bad = M.split_corrupted(_messages(spark, d).withColumn("checksum", F.crc32("payload")))
    return good.select("seq", F.lit(True).alias("good")).unionByName(bad.select("seq", F.lit(False).alias("good")))


@query("SELECT event_id AS seq, sha256(props) AS payload_sha256, NULL::VARCHAR AS error FROM events")
def frame_roundtrip(spark, d):
    rows = M.decode_frames(M.encode_frames(_messages(spark, d)))
    return rows.select("seq", F.sha2("payload", 256).alias("payload_sha256"), "error")


@query("SELECT event_id AS seq, props[3:7] AS middle, ord(props[1])::INT AS first_byte FROM events")
def byte_views(spark, d):
    p = F.col("payload")
    return _messages(spark, d).select("seq", F.decode(M.view(p, 2, 5), "UTF-8").alias("middle"), M.byte_at(p, 0).alias("first_byte"))


@query("SELECT event_id AS seq, 'XY' || props[3:] AS payload FROM events")
def write_buffer(spark, d):
    return _messages(spark, d).select("seq", F.decode(M.write_at(F.col("payload"), F.lit(b"XY")), "UTF-8").alias("payload"))


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS merged_seq, event_id FROM events")
def merge_producers(spark, d):
    rows = table(spark, d, "events").select("event_id")
    return M.merge_producers(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), order_by="event_id", name="merged_seq").select("merged_seq", "event_id")
