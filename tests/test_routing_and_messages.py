"""Routing, chunking, capacity policies, frames, views, and positions in an order."""

import zlib

import pytest
from pyspark.sql import functions as F

from weir.errors import BufferFullError, CorruptedMessageError, MessageTooLargeError
from weir.operators import messages as M
from weir.operators import routing as R
from weir.operators.ordering import with_position


def frame(spark, payloads, start=0):
    return spark.createDataFrame([(start + n, p) for n, p in enumerate(payloads)], "seq long, payload binary")


def fnv(data):
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


@pytest.mark.parametrize("per_task", [3, 1000])
def test_positions(spark, per_task):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("k"), (F.col("id") % 3).alias("g"))
    assert [r._pos for r in with_position(df, "k", per_task=per_task).orderBy("k").collect()] == list(range(100))
    seen = {}
    for r in with_position(df, "k", by=["g"], per_task=per_task).orderBy("k").collect():
        assert r._pos == seen.setdefault(r.g, 0)
        seen[r.g] += 1
    assert with_position(df.limit(0), "k", per_task=per_task).count() == 0
    ties = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert sorted(r._pos for r in with_position(ties, "k", per_task=2).collect()) == [0, 1, 2, 3]


def test_routes(spark):
    keys = [b"", b"a", b"key-1", b"\xff\x00\x80", b"user" * 20]
    df = frame(spark, keys)
    assert {r.seq: r.shard for r in R.route_hash(df, 4, "payload").collect()} == {n: fnv(k) % 4 for n, k in enumerate(keys)}
    assert [r.shard for r in R.route_round_robin(df, 3, "seq").orderBy("seq").collect()] == [0, 1, 2, 0, 1]
    assert R.route_broadcast(df, 3).count() == 15
    two = df.withColumn("p", F.col("seq") % 2)
    assert [r.shard for r in R.route_round_robin(two, 2, "seq", "p").orderBy("seq").collect()] == [0, 0, 1, 1, 0]
    assert R.shard(R.route(df, "round_robin", 2, "seq"), 1).count() == 2
    for bad in (dict(strategy="x", shards=2), dict(strategy="hash", shards=0), dict(strategy="round_robin", shards=2)):
        with pytest.raises(ValueError):
            R.route(df, **bad)
    with pytest.raises(IndexError):
        R.shard(df, -1)


def test_receive_any(spark):
    routed = R.route_round_robin(frame(spark, [b"x"] * 9), 3, "seq")
    assert [r.seq for r in R.receive_any(routed, "seq").orderBy("turn").collect()] == list(range(9))


def test_chunks(spark):
    sizes = [0, 1, 64, 65, 200, 1000]
    payloads = [bytes(i % 251 for i in range(n)) for n in sizes]
    df = frame(spark, payloads)
    chunks = M.chunk_split(df, 64)
    want = {n: 1 if s <= 64 else -(-s // (64 - 42)) for n, s in enumerate(sizes)}
    assert {r.seq: r["count"] for r in chunks.groupBy("seq").count().collect()} == want
    assert {r.seq: (bytes(r.payload), r.valid) for r in M.chunk_join(chunks).collect()} == {n: (p, True) for n, p in enumerate(payloads)}
    assert {r.seq: r.n_slots for r in M.chunk_plan(df, 64, 10).collect()} == want
    assert [r.seq for r in M.chunk_plan(df, 64, 10).where("too_large").collect()] == [5]
    broken = chunks.where("not (seq = 4 and chunk_index = 1)")
    assert {r.seq for r in M.chunk_join(broken).where("not valid").collect()} == {4}
    flipped = chunks.withColumn("chunk", F.when((F.col("seq") == 4) & (F.col("chunk_index") == 0), F.lit(b"x" * 22)).otherwise(F.col("chunk")))
    assert {r.seq for r in M.chunk_join(flipped).where("not valid").collect()} == {4}
    assert M.max_message(4096, 64) == 64 * 4054 and M.max_message(10, 5) == 10


def test_integrity(spark):
    df = frame(spark, [b"a", b"b", None]).withColumn("checksum", F.when(F.col("seq") == 1, F.lit(5)).otherwise(F.crc32("payload")))
    good, bad = M.split_corrupted(df)
    assert [r.seq for r in good.collect()] == [0] and sorted(r.seq for r in bad.collect()) == [1, 2]
    gaps = M.sequence_gaps(spark.createDataFrame([(s,) for s in (0, 1, 5, 6, 2**20 + 3, 2**21)], "seq long")).orderBy("seq").collect()
    assert [tuple(r) for r in gaps] == [(2, 5, 3), (7, 2**20 + 3, 2**20 - 4), (2**20 + 4, 2**21, 2**20 - 4)]


def fold(sizes, capacity):
    used, kept = 0, []
    for n, s in enumerate(sizes):
        if used + s <= capacity:
            used += s
            kept.append(n)
    return kept


def test_capacity_policies(spark):
    lengths = [10, 200, 10, 500, 300, 10, 10, 90, 10, 64]
    df = frame(spark, [b"x" * n for n in lengths])
    slots = [1 if n <= 64 else -(-n // 22) for n in lengths]
    for capacity in (1, 5, 12, 30, 100):
        fits = [(n, s) for n, s in enumerate(slots) if s <= capacity]
        want = [fits[k][0] for k in fold([s for _, s in fits], capacity)]
        assert sorted(r.seq for r in M.drop_newest(df, capacity, 64).collect()) == want
    assert [r.seq for r in M.drop_newest(df, 3).collect()] == [0, 1, 2]
    assert sorted(r.seq for r in M.drop_oldest(df, 3).collect()) == [7, 8, 9]
    with pytest.raises(BufferFullError):
        M.admit(df, "raise", 30, 64)
    with pytest.raises(MessageTooLargeError):
        M.admit(df, "drop_oldest", 10, 64)
    assert M.admit(df, "block", 1000, 64).count() == 10


def test_frames(spark):
    df = frame(spark, [b"", b"hello", b"\x00" * 100], start=7)
    back = M.decode_frames(M.encode_frames(df))
    assert sorted((r.seq, bytes(r.payload), r.kind, r.error) for r in back.collect()) == [(7, b"", 1, None), (8, b"hello", 1, None), (9, b"\x00" * 100, 1, None)]
    good = bytes(M.encode_frames(df).where("seq = 8").first().frame)
    fields = df.where("seq = 8").withColumn("fields", F.expr("array(named_struct('ty', 3, 'value', cast('v' as binary)))"))
    assert M.decode_frame(bytes(M.encode_frames(fields).first().frame))["fields"] == [{"ty": 3, "value": b"v"}]
    for bad in (b"", good[:-1], b"X" + good[1:], good[:-1] + b"!", good + b"x"):
        with pytest.raises(CorruptedMessageError):
            M.decode_frame(bad)
    odd = spark.createDataFrame([(good,), (good[:-1],), (None,)], "frame binary")
    assert sorted(r.error is None for r in M.decode_frames(odd).collect()) == [False, False, True]


def test_views(spark):
    df = frame(spark, [b"abcdef"])
    p = F.col("payload")
    r = df.select(M.view(p, 2, 3).alias("v"), M.view(p, 4).alias("t"), M.byte_at(p, 0).alias("b"), M.byte_at(p, 99).alias("n"), M.write_at(p, F.lit(b"XY"), 1).alias("w"), M.write_at(p, F.lit(b"long one"), 1).alias("o")).first()
    assert (bytes(r.v), bytes(r.t), r.b, r.n, bytes(r.w), r.o) == (b"cde", b"ef", 97, None, b"aXYdef", None)
    with pytest.raises(ValueError):
        M.view(p, -1)


def test_stats_and_merge(spark):
    df = frame(spark, [b"x" * 10, b"x" * 100], start=5)
    s = M.channel_stats(df, 8, 64).first()
    assert (s.queue_depth, s.next_sequence, s.expected_recv_sequence, s.empty, s.chunk_payload_size) == (6, 7, 5, False, 22)
    assert M.channel_stats(df.limit(0), 8, 64).first().empty
    merged = M.merge_producers(spark.range(0, 10, 2), spark.range(1, 10, 2), order_by="id")
    assert [(r.id, r.seq) for r in merged.orderBy("id").collect()] == [(n, n) for n in range(10)]
    assert zlib.crc32(b"x") == spark.range(1).select(F.crc32(F.lit(b"x"))).first()[0]
