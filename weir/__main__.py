"""python -m weir info [--json] | tables list|stats|inspect|cleanup|remove DIR [--older-than SECONDS] | bench [pipeline|channel] [--count N]"""

from __future__ import annotations

import argparse
import json
import platform
import time
import uuid

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weir.operators.routing import STRATEGIES
from weir.plans.pipeline import Pipeline
from weir.sources.channel import TURN, MessageChannel


def info() -> dict:
    return {"name": "weir", "spark": pyspark.__version__, "python": platform.python_version(), "platform": platform.platform(), "backends": ["parquet"], "strategies": list(STRATEGIES)}


def record(benchmark: str, backend: str, count: int, elapsed: float, size: int = 0, batch: int = 1) -> dict:
    return {
        "benchmark": benchmark,
        "backend": backend,
        "count": count,
        "message_size": size,
        "batch_size": batch,
        "elapsed_s": elapsed,
        "throughput_msg_s": count / elapsed,
        "throughput_gib_s": count * size / elapsed / 2**30,
        "platform": platform.platform(),
        "python": platform.python_version(),
    }


def bench_pipeline(spark: SparkSession, count: int, batches: tuple[int, ...] = (64, 256, 1024)) -> list[dict]:
    """The filter and map of the sensor stream: as native columns, as Python functions, and as such over batches."""
    i = F.col("id")
    df = spark.range(count).select("id", (20 + i % 30).cast("double").alias("temperature"), (50 + i % 40).cast("double").alias("humidity"))
    warm, convert = lambda r: r["temperature"] > 25 and r["humidity"] < 80, lambda r: r["temperature"] * 1.8 + 32
    plans = {
        ("expr", 1): Pipeline().filter_expr("temperature > 25 and humidity < 80").map_expr("temperature * 1.8 + 32"),
        ("py", 1): Pipeline().filter_py(warm).map_py(convert),
        **{("py_batch", n): Pipeline().batch(n).filter_py_batch(warm).map_py_batch(convert) for n in batches},
    }
    out = []
    for (name, n), p in plans.items():
        began = time.perf_counter()
        p.apply(df, "id").write.format("noop").mode("overwrite").save()
        out.append(record("pipeline", name, count, time.perf_counter() - began, batch=n))
    return out


def bench_channel(spark: SparkSession, count: int, size: int) -> list[dict]:
    """Messages through a channel in the warehouse, which all executors see."""
    name = f"bench-{uuid.uuid4().hex}"
    channel = MessageChannel.named(spark, name, capacity=count, slot_size=size)
    try:
        df = spark.range(count).select(F.col("id").alias("seq"), F.encode(F.repeat(F.lit("x"), size), "UTF-8").alias("payload"))
        began = time.perf_counter()
        channel.send_frame(df)
        channel.take().write.format("noop").mode("overwrite").save()
        return [record("channel", "parquet", count, time.perf_counter() - began, size)]
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(channel.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tables(spark: SparkSession, action: str, path: str, older_than: float = 24 * 3600) -> list[dict]:
    """Message tables below a folder: their paths, counters, contents (inspect), or their removal: all of them, or (cleanup)
    those that nothing was sent to or received from for so many seconds. cleanup also ends the turns of dead producers."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def below(p, *names):
        return jvm.org.apache.hadoop.fs.Path(p, "/".join(names))

    def age(p) -> float:
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and fs.exists(below(s.getPath(), "messages"))]
    if action == "stats":
        return [MessageChannel(spark, p.toString()).stats() for p in found]
    if action == "inspect":
        out = []
        for p in found:
            channel = MessageChannel(spark, p.toString())
            files = fs.getContentSummary(p)
            out.append(channel.stats() | {"rejected": channel.rejected().count(), "files": files.getFileCount(), "bytes": files.getLength(), "idle_s": min(age(below(p, d)) for d in ("messages", "marks"))})
        return out
    if action == "cleanup":
        for p in found:
            turn = below(p, TURN)
            if fs.exists(turn) and age(turn) >= older_than:
                fs.delete(turn, False)
        found = [p for p in found if min(age(below(p, d)) for d in ("messages", "marks")) >= older_than]
    if action in ("remove", "cleanup"):
        for p in found:
            fs.delete(p, True)
    return [{"path": p.toString()} for p in found]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weir", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("info").add_argument("--json", action="store_true")
    t = sub.add_parser("tables")
    t.add_argument("action", choices=["list", "stats", "inspect", "cleanup", "remove"])
    t.add_argument("dir")
    t.add_argument("--older-than", type=float, default=24 * 3600, help="seconds, for cleanup")
    b = sub.add_parser("bench")
    b.add_argument("what", choices=["pipeline", "channel"])
    b.add_argument("--count", type=int, default=100_000)
    b.add_argument("--message-size", type=int, default=4096)
    args = parser.parse_args(argv)
    if args.command == "info":
        print(json.dumps(info()) if args.json else "\n".join(f"{k}: {v}" for k, v in info().items()))
        return
    spark = SparkSession.builder.getOrCreate()
    if args.command == "tables":
        rows = tables(spark, args.action, args.dir, args.older_than)
    else:
        rows = bench_pipeline(spark, args.count) if args.what == "pipeline" else bench_channel(spark, args.count, args.message_size)
    for r in rows:
        print(json.dumps(r))


if __name__ == "__main__":
    main()
