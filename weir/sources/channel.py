"""Channels as message tables: a Parquet folder of (seq, producer, payload, checksum) rows, appended to in batches.

A received message is one below the read mark, a small table beside the messages; nothing is rewritten. Readers and
writers may be on any machine that sees the folder. Structured Streaming reads the same folder (see weir.streaming).
"""

from __future__ import annotations

import time
import uuid
import zlib
from contextlib import contextmanager, nullcontext

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.errors import BufferEmptyError, BufferFullError, ChannelClosedError, CorruptedMessageError, SequenceMismatchError
from weir.operators import messages as M
from weir.operators.ordering import with_position
from weir.operators.routing import fnv1a32, route
from weir.sources.urls import TransportUrl

SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("producer", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("checksum", T.LongType())]
)
#: The file of the producer that writes.
TURN = "producer"
_MARK = T.StructType([T.StructField("next", T.LongType())])
# What Rust-style float parsing takes for a number.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"


def region_name(name: str) -> str:
    """The folder of a named channel: a function of its name alone."""
    if not name.strip():
        raise ValueError("a channel's name isn't blank")
    return f"weir-{zlib.crc32(name.encode()):08x}"


def decode_numbers(messages: DataFrame) -> DataFrame:
    """messages with x: payloads as numbers. Empty payloads are skipped; other text than numbers gives a missing x."""
    text = F.decode("payload", "UTF-8")
    rows = messages.where(F.octet_length("payload") > 0)
    return rows.withColumn("x", F.when(text.rlike(NUMBER), text.try_cast("double")))


class MessageChannel:
    """A bounded, ordered channel of byte messages over a message table."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = 1024, slot_size: int = 4096, backpressure: str = "block", timeout: float | None = None, multi_producer: bool = False, name: str | None = None):
        if capacity < 1 or slot_size < 1:
            raise ValueError("capacity and slot_size are above 0")
        if timeout is not None and timeout < 0:
            raise ValueError("timeout isn't negative")
        if backpressure not in M.POLICIES:
            raise ValueError(f"backpressure is one of {M.POLICIES}")
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.capacity, self.slot_size, self.backpressure, self.timeout, self.multi_producer = capacity, slot_size, backpressure, timeout, multi_producer
        self.closed = False
        self._messages, self._marks = f"{self.path}/messages", f"{self.path}/marks"
        if not self._exists(self._messages):
            spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(self._messages)
            spark.createDataFrame([], _MARK).write.mode("ignore").parquet(self._marks)

    @classmethod
    def named(cls, spark: SparkSession, name: str, base: str | None = None, **options) -> MessageChannel:
        base = base or spark.conf.get("spark.sql.warehouse.dir")
        return cls(spark, f"{base.rstrip('/')}/{region_name(name)}", name=name, **options)

    @classmethod
    def create(cls, spark: SparkSession, path: str, **options) -> MessageChannel:
        return cls(spark, path, **{"backpressure": "raise", **options})

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> MessageChannel:
        """An existing channel of a path."""
        probe = cls.__new__(cls)
        probe.spark = spark
        if not probe._exists(f"{path.rstrip('/')}/messages"):
            raise FileNotFoundError(path)
        return cls.create(spark, path, **options)

    @classmethod
    def open_url(cls, spark: SparkSession, url: str) -> MessageChannel:
        u = TransportUrl.parse(url)
        options = {"capacity": u.number("capacity", 64), "slot_size": u.number("slot_size", 4096), "multi_producer": u.flag("multi_producer")}
        if u.scheme == "shm":
            return cls.named(spark, u.target, **options)
        if u.scheme == "file":
            return cls.create(spark, u.target, **options)
        raise ValueError(f"{u.scheme} has no channel")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    # --- reading ---

    def _all(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self._messages)

    def _mark(self) -> int:
        return self.spark.read.schema(_MARK).parquet(self._marks).agg(F.max("next")).first()[0] or 0

    def read(self) -> DataFrame:
        """What is queued: (seq, payload), unordered as any DataFrame; the filter on seq reaches the scan."""
        rows = self._all().where(F.col("seq") >= self._mark())
        if self.backpressure == "drop_oldest":
            rows = M.drop_oldest(rows, self.capacity, self.slot_size)
        return rows

    def take(self) -> DataFrame:
        """All that is queued, and mark it as received; corrupted rows are left out (see rejected)."""
        last = self.read().agg(F.max("seq")).first()[0]
        rows = self.read()
        if last is not None:
            rows = rows.where(F.col("seq") <= last)
            self._advance(last + 1)
        return M.split_corrupted(rows)[0].select("seq", "payload")

    def rejected(self) -> DataFrame:
        """Messages whose checksum is wrong."""
        return M.split_corrupted(self._all())[1]

    def _advance(self, mark: int) -> None:
        self.spark.createDataFrame([(mark,)], _MARK).write.mode("append").parquet(self._marks)

    def recv_with_seq(self) -> tuple[int, bytes]:
        """The next message. One receiver enforces the sequence unless several producers send or old messages may go."""
        mark = self._mark()
        row = self.read().orderBy("seq").limit(1).collect()
        if not row:
            raise ChannelClosedError("closed and empty") if self.closed else BufferEmptyError("nothing queued")
        r = row[0]
        self._advance(r.seq + 1)
        if not self.multi_producer and self.backpressure != "drop_oldest" and r.seq != mark:
            raise SequenceMismatchError(f"expected {mark}, got {r.seq}")
        if r.checksum != zlib.crc32(r.payload):
            raise CorruptedMessageError(f"message {r.seq}")
        return r.seq, bytes(r.payload)

    def recv(self) -> bytes:
        return self.recv_with_seq()[1]

    def try_recv(self) -> bytes | None:
        try:
            return self.recv()
        except BufferEmptyError:
            return None

    # --- writing ---

    def send(self, *payloads: bytes) -> int:
        """Send messages as one batch, in order."""
        rows = [(n, bytes(p)) for n, p in enumerate(payloads)]
        return self.send_frame(self.spark.createDataFrame(rows, "seq long, payload binary"))

    def send_frame(self, df: DataFrame, order_by: str = "seq", producer: str | None = None) -> int:
        """Append the payloads of df in the order of order_by; how many were accepted. A failed write leaves no rows:
        Spark commits a batch's files together. Several producers take turns, so none gets another one's numbers."""
        if self.closed:
            raise ChannelClosedError("closed")
        with self._alone() if self.multi_producer else nullcontext():
            used, top = self._depth()
            start = max(self._mark(), top)
            if self.backpressure == "drop_oldest":  # evicted messages leave gaps in the sequence
                rows = M.admit(with_position(df, order_by, "_pos"), self.backpressure, self.capacity, self.slot_size, order_by)
            else:
                rows = with_position(M.admit(df, self.backpressure, self.capacity, self.slot_size, order_by, queued=used), order_by, "_pos")
            rows = rows.select((F.col("_pos") + start).cast("long").alias("seq"), F.lit(producer).cast("string").alias("producer"), F.col("payload"), F.crc32("payload").alias("checksum"))
            sent = Observation()
            rows.observe(sent, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self._messages)
            return sent.get.get("n", 0)

    @contextmanager
    def _alone(self):
        """A producer's turn: a file that only one of them can create. Waits `timeout` seconds (30 if there is none); the
        file of a producer that died is removed by `python -m weir tables cleanup`."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{TURN}")
        fs = path.getFileSystem(conf)
        until = time.monotonic() + (30 if self.timeout is None else self.timeout)

        def ours() -> bool:
            if fs.getUri().getScheme() == "file":  # Hadoop's own create looks first and creates then
                return jvm.java.io.File(path.toUri().getPath()).createNewFile()
            try:
                fs.create(path, False).close()
            except Py4JJavaError:
                if fs.exists(path):
                    return False
                raise
            return True

        while not ours():
            if time.monotonic() >= until:
                raise BufferFullError("another producer is writing")
            time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(path, False)

    def _depth(self) -> tuple[int, int]:
        r = self._all().agg(F.sum(F.when(F.col("seq") >= self._mark(), M.slots(F.octet_length("payload"), self.slot_size))), F.max("seq") + 1).first()
        return r[0] or 0, r[1] or 0

    def close(self) -> None:
        """This handle sends no more; queued messages can still be received."""
        self.closed = True

    def __enter__(self) -> MessageChannel:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __len__(self) -> int:
        return self.read().count()

    @property
    def empty(self) -> bool:
        return not self.read().limit(1).count()

    def stats(self) -> dict:
        row = M.channel_stats(self.read(), self.capacity, self.slot_size).first().asDict()
        mark = self._mark()
        row |= {"next_sequence": max(self._depth()[1], mark), "expected_recv_sequence": mark, "last_received_sequence": mark - 1 if mark else None, "closed": self.closed, "multi_producer": self.multi_producer, "backend": "parquet", "path": self.path}
        return row | ({"name": self.name} if self.name else {})


class ShardedChannel:
    """Several channels behind a router."""

    def __init__(self, spark: SparkSession, name: str, shards: int = 4, strategy: str = "round_robin", base: str | None = None, **options):
        if shards < 1 or isinstance(shards, bool):
            raise ValueError("at least one shard")
        if strategy not in ("round_robin", "hash", "broadcast"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.spark, self.strategy = spark, strategy
        self._channels = [MessageChannel.named(spark, f"{name}#shard{i}", base, **{"capacity": 64, **options}) for i in range(shards)]
        self._turn = self._next = 0

    def send(self, payload: bytes, key: bytes | None = None) -> int:
        """Send one message; how many shards got it."""
        n = len(self._channels)
        if self.strategy == "broadcast":
            return sum(c.send(payload) for c in self._channels)
        if self.strategy == "hash":
            code = self.spark.range(1).select(fnv1a32(F.lit(bytes(payload if key is None else key)))).first()[0]
            return self._channels[code % n].send(payload)
        at, self._turn = self._turn, (self._turn + 1) % n
        return self._channels[at].send(payload)

    def send_frame(self, df: DataFrame, order_by: str = "seq", key: str | None = None) -> int:
        """Route a whole frame of messages in one plan."""
        routed = route(df, self.strategy, len(self._channels), order_by, key)
        folder = f"{self._channels[0].path}/routed-{uuid.uuid4().hex}"  # written once, a folder for each shard
        routed.write.partitionBy("shard").parquet(folder)
        try:
            rows = self.spark.read.schema(routed.schema).parquet(folder)
            return sum(c.send_frame(rows.where(F.col("shard") == i).drop("shard"), order_by) for i, c in enumerate(self._channels))
        finally:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def shard(self, i: int) -> MessageChannel:
        if isinstance(i, bool) or not isinstance(i, int) or not 0 <= i < len(self._channels):
            raise IndexError(i)
        return self._channels[i]

    def shards(self) -> list[MessageChannel]:
        return list(self._channels)

    def recv_any(self) -> tuple[int, bytes] | None:
        """Poll each shard once, from one after the last that gave something."""
        n = len(self._channels)
        for k in range(n):
            i = (self._next + k) % n
            payload = self._channels[i].try_recv()
            if payload is not None:
                self._next = (i + 1) % n
                return i, payload
        return None

    def stats(self) -> list[dict]:
        return [c.stats() for c in self._channels]

    def close(self) -> None:
        for c in self._channels:
            c.close()

    def __enter__(self) -> ShardedChannel:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __len__(self) -> int:
        return len(self._channels)

