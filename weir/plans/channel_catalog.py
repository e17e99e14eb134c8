"""Named queries over channels, URLs and damaged messages, registered beside those of the catalog."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.errors import WeirError
from weir.operators import messages as M
from weir.plans.catalog import query, table
from weir.plans.pipeline import Pipeline
from weir.sources.channel import MessageChannel, ShardedChannel, decode_numbers
from weir.sources.urls import TransportUrl

WIDE = {"capacity": 1 << 30, "slot_size": 1 << 16}


def _base(spark: SparkSession) -> str:
    """A new folder for a query's channels: in spark.checkpoint.dir, else (local mode) in a temporary one, else in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = tempfile.mkdtemp(prefix="weir-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/channels-{uuid.uuid4().hex}"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.encode("props", "UTF-8").alias("payload"))


def _text(df: DataFrame) -> DataFrame:
    return df.select("seq", F.decode("payload", "UTF-8").alias("payload"))


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS seq, props AS payload FROM events")
def channel_take(spark, d):
    """A named channel: a whole table is sent in its order and taken out again."""
    c = MessageChannel.named(spark, "events", _base(spark), **WIDE)
    c.send_frame(_events(spark, d))
    return _text(c.take())


@query("SELECT (row_number() OVER (ORDER BY event_id % 2, event_id) - 1)::BIGINT AS seq, props AS payload FROM events")
def channel_reopened(spark, d):
    """A channel of a path, opened again for a second batch: numbers go on."""
    path = _base(spark)
    MessageChannel.create(spark, path, **WIDE).send_frame(_events(spark, d).where("seq % 2 = 0"))
    c = MessageChannel.open(spark, path, **WIDE)
    c.send_frame(_events(spark, d).where("seq % 2 = 1"))
    return _text(c.read())


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS seq, props AS payload FROM events ORDER BY event_id DESC LIMIT 300")
def channel_drop_oldest(spark, d):
    """Capacity is the feature: the last 300 messages stay, under their numbers."""
    c = MessageChannel.named(spark, "latest", _base(spark), capacity=300, backpressure="drop_oldest")
    c.send_frame(_events(spark, d))
    return _text(c.read())


@query("SELECT * FROM (VALUES ('block', 'BufferFullError'), ('raise', 'BufferFullError'), ('closed', 'ChannelClosedError'), ('empty', 'BufferEmptyError'), ('polled', 'none')) t(case_name, error)")
def channel_errors(spark, d):
    """A full channel, a closed one, an empty one, and a poll of an empty one."""
    base, out = _base(spark), []

    def tried(name, f):
        try:
            f()
            out.append((name, "none"))
        except WeirError as e:
            out.append((name, type(e).__name__))

    for policy in ("block", "raise"):
        c = MessageChannel.named(spark, policy, base, capacity=10, backpressure=policy)
        tried(policy, lambda c=c: c.send_frame(_events(spark, d)))
    c.close()
    tried("closed", lambda: c.send(b"late"))
    c = MessageChannel.named(spark, "empty", base)
    tried("empty", c.recv)
    tried("polled", c.try_recv)
    return spark.createDataFrame(out, "case_name string, error string")


@query("SELECT count(*)::BIGINT AS sent, count(*)::BIGINT AS next_sequence, count(*)::BIGINT AS expected_recv_sequence, 0::BIGINT AS left_over FROM events")
def channel_counters(spark, d):
    """What was accepted, and the counters after everything was taken."""
    c = MessageChannel.named(spark, "counted", _base(spark), **WIDE)
    sent = c.send_frame(_events(spark, d))
    c.take()
    stats = c.stats()
    return spark.createDataFrame([(sent, stats["next_sequence"], stats["expected_recv_sequence"], len(c))], "sent long, next_sequence long, expected_recv_sequence long, left_over long")


@query("SELECT value * 2 AS x FROM events WHERE value > 50")
def url_source_and_sink(spark, d):
    """From a URL's channel through a pipeline into another URL's channel, numbers as text in both."""
    a, b = f"file://{_base(spark)}?capacity=1000000000", f"file://{_base(spark)}?capacity=1000000000"
    numbers = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.encode(F.col("value").cast("string"), "UTF-8").alias("payload"))
    MessageChannel.open_url(spark, a).send_frame(numbers)
    Pipeline().from_transport(a).filter_expr("x > 50").map_expr("x * 2").sink(b).run(spark=spark)
    return decode_numbers(MessageChannel.open_url(spark, b).read()).select("x")


@query("SELECT n_name AS target, 'shm:' || n_name AS label, (n_nationkey + 1)::BIGINT AS capacity, 4096::BIGINT AS slot_size, 'shm://' || n_name || '?capacity=' || (n_nationkey + 1) || '&capacity=7' AS url FROM nation")
def url_grammar(spark, d):
    """The first value of a key counts; the text is that of the URL."""
    out = []
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # a fixed table of nations
        u = TransportUrl.parse(f"shm://{r.n_name}?capacity={r.n_nationkey + 1}&capacity=7")
        out.append((u.target, u.label, u.number("capacity", 64), u.number("slot_size", 4096), str(u)))
    return spark.createDataFrame(out, "target string, label string, capacity long, slot_size long, url string")


@query("SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN value WHEN event_id % 5 = 3 THEN 'inf'::DOUBLE END AS x FROM events WHERE event_id % 5 <> 1")
def payload_numbers(spark, d):
    """Empty payloads are skipped; text that is no number (JSON, blanks, suffixes) gives a missing value."""
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, "").when(kind == 2, F.col("props")).when(kind == 3, "Infinity").otherwise(" 1d")
    return decode_numbers(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.encode(text, "UTF-8").alias("payload"))).select("seq", "x")


@query("SELECT s AS shard, (row_number() OVER (PARTITION BY s ORDER BY event_id) - 1)::BIGINT AS seq, props AS payload FROM (SELECT *, ((row_number() OVER (ORDER BY event_id) - 1) % 3)::INT AS s FROM events)")
def sharded_channel(spark, d):
    """A frame routed over three channels, each read for itself."""
    c = ShardedChannel(spark, "sharded", 3, base=_base(spark), **WIDE)
    c.send_frame(_events(spark, d))
    parts = [_text(c.shard(i).read()).select(F.lit(i).alias("shard"), "seq", "payload") for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id AS seq, event_id % 7 <> 0 AS good FROM events")
def checksum_damaged(spark, d):
    """Every seventh payload is cut by a byte after its checksum was taken."""
    rows = _events(spark, d).withColumn("checksum", F.crc32("payload"))
    cut = F.when(F.col("seq") % 7 == 0, F.substring("payload", F.lit(2), F.octet_length("payload") - 1)).otherwise(F.col("payload"))
    good, bad = M.split_corrupted(rows.withColumn("payload", cut))
    return good.select("seq", F.lit(True).alias("good")).unionByName(bad.select("seq", F.lit(False).alias("good")))


@query("SELECT doc_id AS seq, NOT (strlen(text) > 1024 AND doc_id % 3 = 0) AS valid FROM documents")
def chunks_lost(spark, d):
    """The second chunk of every third message is lost where there is one; such messages don't come together."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("payload"))
    chunks = M.chunk_split(docs, 1024).where("not (chunk_index = 1 and seq % 3 = 0)")
    return M.chunk_join(chunks).select("seq", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("SELECT event_id::DOUBLE AS event_id, value FROM events WHERE event_id % 2 = 1 AND value > 20")
def filter_div_some(spark, d):
    """Where the divisor is zero the value is missing and the row goes."""
    rows = table(spark, d, "events").withColumn("odd", F.col("event_id") % 2)
    return Pipeline().filter_expr("value / odd > 20").select("event_id", "value").apply(rows)


@query("SELECT 'nan'::DOUBLE AS x FROM events")
def map_missing_column(spark, d):
    """A column that isn't there is a missing value, and that is NaN when mapped."""
    return Pipeline().map_expr("nonexistent + value").apply(table(spark, d, "events"))


@query("SELECT count(*) FILTER (WHERE value > 95)::BIGINT AS n FROM (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 8 AS b FROM events) GROUP BY b")
def filter_py_batch_empty(spark, d):
    """Batches stay when nothing is left in them."""
    rows = Pipeline().map_expr("value").batch(8).filter_py_batch(lambda x: x > 95).apply(table(spark, d, "events"), "event_id")
    return rows.select(F.size("items").cast("long").alias("n"))


@query("SELECT i * 2.5 - 1 AS x FROM (SELECT i::DOUBLE AS i FROM range(1000) t(i)) WHERE i > 600")
def collect_items(spark, d):
    """Python numbers in, Python numbers out."""
    out = Pipeline().filter_expr("x > 600").map_expr("x * 2.5 - 1").collect(range(1000), spark)
    return spark.createDataFrame([(x,) for x in out], "x double")
