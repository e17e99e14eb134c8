"""Channels over message tables, transport URLs, streaming, and the command line."""

import json

import pytest

from weir import __main__ as cli
from weir.errors import BufferEmptyError, BufferFullError, ChannelClosedError, CorruptedMessageError, MessageTooLargeError, PipelineBuildError, UrlError
from weir.plans.pipeline import Pipeline
from weir.sources.channel import SCHEMA, MessageChannel, ShardedChannel, region_name
from weir.sources.urls import TransportUrl, parse_transport_url
from weir.streaming.run import numbers, read_stream, run_available


def test_send_and_receive(spark, tmp_path):
    c = MessageChannel(spark, str(tmp_path / "c"), capacity=8, slot_size=64)
    assert c.empty and len(c) == 0 and c.try_recv() is None
    with pytest.raises(BufferEmptyError):
        c.recv()
    assert c.send(b"one", b"two") == 2 and len(c) == 2
    assert c.recv_with_seq() == (0, b"one") and c.recv() == b"two"
    assert c.stats()["expected_recv_sequence"] == 2 and c.stats()["next_sequence"] == 2
    c.send(b"x" * 100)
    assert c.stats()["queue_depth"] == 5 and c.recv() == b"x" * 100
    with pytest.raises(MessageTooLargeError):
        c.send(b"x" * 1000)
    with pytest.raises(BufferFullError):
        c.send(*[b"m"] * 9)
    with c:
        c.send(b"last")
    with pytest.raises(ChannelClosedError):
        c.send(b"more")
    assert c.recv() == b"last"
    with pytest.raises(ChannelClosedError):
        c.recv()


def test_policies(spark, tmp_path):
    c = MessageChannel(spark, str(tmp_path / "n"), capacity=2, backpressure="drop_newest")
    assert c.send(b"a", b"b", b"c") == 2 and [c.recv(), c.recv(), c.try_recv()] == [b"a", b"b", None]
    c = MessageChannel(spark, str(tmp_path / "o"), capacity=2, backpressure="drop_oldest")
    c.send(b"a", b"b", b"c")
    assert [c.recv_with_seq(), c.recv_with_seq()] == [(1, b"b"), (2, b"c")]
    for bad in (dict(capacity=0), dict(timeout=-1), dict(backpressure="x"), dict(slot_size=0)):
        with pytest.raises(ValueError):
            MessageChannel(spark, str(tmp_path / "bad"), **bad)


def test_open_and_names(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        MessageChannel.open(spark, str(tmp_path / "none"))
    MessageChannel.create(spark, str(tmp_path / "f")).send(b"kept")
    assert MessageChannel.open(spark, str(tmp_path / "f")).recv() == b"kept"
    assert region_name("a") == region_name("a") != region_name("b")
    with pytest.raises(ValueError):
        region_name(" ")
    assert MessageChannel.named(spark, "a", str(tmp_path)).stats()["name"] == "a"


def test_corruption(spark, tmp_path):
    c = MessageChannel(spark, str(tmp_path / "c"))
    spark.createDataFrame([(0, None, b"bad", 1)], SCHEMA).write.mode("append").parquet(f"{c.path}/messages")
    c.send(b"good")
    assert c.rejected().count() == 1
    with pytest.raises(CorruptedMessageError):
        c.recv()
    assert c.recv() == b"good"


def test_sharded(spark, tmp_path):
    with ShardedChannel(spark, "s", 2, base=str(tmp_path)) as s:
        assert [s.send(p) for p in (b"a", b"b", b"c")] == [1, 1, 1] and len(s) == 2
        assert [s.recv_any() for _ in range(4)] == [(0, b"a"), (1, b"b"), (0, b"c"), None]
        assert [x["empty"] for x in s.stats()] == [True, True]
        with pytest.raises(IndexError):
            s.shard(2)
    b = ShardedChannel(spark, "b", 2, "broadcast", base=str(tmp_path))
    assert b.send(b"x") == 2
    h = ShardedChannel(spark, "h", 3, "hash", base=str(tmp_path))
    df = spark.createDataFrame([(n, f"k{n % 2}", str(n).encode()) for n in range(6)], "seq long, key string, payload binary")
    assert h.send_frame(df, key="key") == 6
    assert sorted(len(c) for c in h.shards())[-1] >= 3
    with pytest.raises(ValueError):
        ShardedChannel(spark, "z", 0, base=str(tmp_path))


@pytest.mark.parametrize("url,reason", [("", "empty"), ("abc", "missing scheme"), ("ftp://x", "unsupported scheme"), ("shm://", "missing target"), ("tcp://h", "invalid port"), ("tcp://h:70000", "invalid port"), ("shm://a?b", "invalid query"), ("shm://a?=1", "invalid query")])
def test_bad_urls(url, reason):
    with pytest.raises(UrlError) as e:
        TransportUrl.parse(url)
    assert e.value.reason == reason


def test_urls():
    u = TransportUrl.parse("shm://name?capacity=8&&capacity=9&multi_producer=yes")
    assert u.param("capacity") == "8" and u.number("capacity", 1) == 8 and u.number("slot_size", 4096) == 4096 and u.flag("multi_producer")
    assert str(TransportUrl.parse("tcp://h:80/p?a=1")) == "tcp://h:80/p?a=1" and u.label == "shm:name"
    assert parse_transport_url("file:///tmp/x?a=1&a=2") == ("file", "/tmp/x", {"a": "1"})
    assert Pipeline.parse_transport_url("shm://a?capacity=4") == ("shm", "a", {"capacity": "4"})
    with pytest.raises(UrlError):
        TransportUrl.parse("shm://a?capacity=x").number("capacity", 1)


def test_from_transport_to_sink(spark, tmp_path):
    source, sink = f"file://{tmp_path}/in?capacity=100", f"file://{tmp_path}/out?capacity=100"
    MessageChannel.open_url(spark, source).send(b"20", b"", b"30.5", b"1e1")
    p = Pipeline().select("gone").from_transport(source).filter_expr("x > 15").map_expr("x * 2").sink(sink)
    assert p.run(spark=spark) == 2
    out = MessageChannel.open_url(spark, sink)
    assert [out.recv(), out.recv()] == [b"40.0", b"61.0"]
    with pytest.raises(RuntimeError):
        Pipeline().run([1], spark)
    with pytest.raises(ValueError):
        Pipeline().sink("tcp://h:1")
    with pytest.raises(PipelineBuildError):
        Pipeline().from_transport("tcp://h:1")


def test_send_to_and_receive_from(spark, tmp_path):
    c = MessageChannel(spark, str(tmp_path / "c"))
    assert Pipeline().map_expr("x + 1").send_to([1, 2], c) == 2
    assert Pipeline().filter_expr("x > 2").receive_from(c) == [3.0] and c.empty
    assert Pipeline().batch(2).send_to([{"a": 1}, {"a": 2}], c) == 1 and c.recv() == b"[{'a': 1.0}, {'a': 2.0}]"


def test_streaming(spark, tmp_path):
    c = MessageChannel(spark, str(tmp_path / "c"), capacity=100)
    c.send(b"1", b"2", b"3")
    p = Pipeline().filter_expr("x > 1").map_expr("x * 10")

    def go():
        q = run_available(p, numbers(read_stream(spark, c.path)).select("x"), str(tmp_path / "out"), str(tmp_path / "mark"))
        q.awaitTermination(120)
        return sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go() == [20.0, 30.0]
    c.send(b"4")
    assert go() == [20.0, 30.0, 40.0]  # goes on where it was
    batched = Pipeline().map_expr("x").batch(3)
    q = run_available(batched, numbers(read_stream(spark, c.path)), str(tmp_path / "b"), str(tmp_path / "m2"), "seq")
    q.awaitTermination(120)
    assert sorted(r["items"] for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [[1.0, 2.0, 3.0], [4.0]]


def test_command_line(spark, tmp_path, capsys):
    cli.main(["info", "--json"])
    assert json.loads(capsys.readouterr().out)["name"] == "weir"
    MessageChannel(spark, str(tmp_path / "x" / "c")).send(b"a")
    cli.main(["tables", "stats", str(tmp_path / "x")])
    assert json.loads(capsys.readouterr().out)["queue_depth"] == 1
    cli.main(["bench", "pipeline", "--count", "1000"])
    rows = [json.loads(x) for x in capsys.readouterr().out.split("\n") if x]
    assert [(r["backend"], r["batch_size"]) for r in rows] == [("expr", 1), ("py", 1), ("py_batch", 64), ("py_batch", 256), ("py_batch", 1024)] and all(r["throughput_msg_s"] > 0 for r in rows)
    cli.main(["bench", "channel", "--count", "100", "--message-size", "64"])
    assert "throughput_gib_s" in capsys.readouterr().out
    cli.main(["tables", "remove", str(tmp_path / "x")])
    cli.main(["tables", "list", str(tmp_path / "x")])


def test_producers_take_turns(spark, tmp_path):
    import threading

    path = str(tmp_path / "many")
    sent = []

    def produce(n):
        c = MessageChannel.create(spark, path, multi_producer=True)
        sent.append(c.send_frame(spark.createDataFrame([(i, f"{n}-{i}".encode()) for i in range(5)], "seq long, payload binary"), producer=str(n)))

    MessageChannel.create(spark, path)
    threads = [threading.Thread(target=produce, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = MessageChannel.open(spark, path, multi_producer=True).read().collect()
    assert sent == [5] * 4 and sorted(r.seq for r in rows) == list(range(20))
    for n in range(4):  # each producer's messages keep their order
        assert [r.payload for r in sorted(rows, key=lambda r: r.seq) if r.producer == str(n)] == [f"{n}-{i}".encode() for i in range(5)]


def test_cleanup_and_inspect(spark, tmp_path):
    from weir.__main__ import tables

    c = MessageChannel.create(spark, str(tmp_path / "a"), multi_producer=True, timeout=0.1)
    c.send(b"1", b"2")
    (row,) = tables(spark, "inspect", str(tmp_path))
    assert row["queue_depth"] == 2 and row["rejected"] == 0 and row["files"] > 0 and row["idle_s"] >= 0
    assert tables(spark, "cleanup", str(tmp_path), 3600) == []
    (tmp_path / "a" / "producer").write_bytes(b"")  # of a producer that died
    with pytest.raises(BufferFullError):
        c.send(b"3")
    assert len(tables(spark, "list", str(tmp_path))) == 1
    assert len(tables(spark, "cleanup", str(tmp_path), 0)) == 1
    assert tables(spark, "list", str(tmp_path)) == []
