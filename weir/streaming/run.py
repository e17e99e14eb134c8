"""Pipelines over Structured Streaming: the message table as an unbounded source, checkpoints for recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.operators import specs as S
from weir.plans.pipeline import Pipeline
from weir.sources.channel import SCHEMA, decode_numbers


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A channel's messages as a stream; max_files bounds what a trigger admits (backpressure)."""
    reader = spark.readStream.schema(SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path.rstrip('/')}/messages")


def run_available(pipeline: Pipeline, source: DataFrame, sink: str, checkpoint: str, order_by: str | None = None, keep: tuple[str, ...] = ()) -> StreamingQuery:
    """Run over what is there and stop; a further call with the same checkpoint goes on after it.

    Operators without memory run as one streaming plan. With batch(), each trigger's rows are a bounded frame, batched
    in order with its own last partial batch; a stream has no other end at which to emit one.
    """
    if any(isinstance(s, S.Batch) for s in pipeline._specs):

        def write(df: DataFrame, epoch: int) -> None:
            out = pipeline.apply(df, order_by, keep).withColumn("epoch", F.lit(epoch))
            out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")  # the same epoch again replaces its own rows

        writer = source.writeStream.foreachBatch(write)
    else:
        writer = pipeline.apply(source, order_by, keep).writeStream.format("parquet").option("path", sink)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbers(source: DataFrame) -> DataFrame:
    """(seq, x) of a message stream."""
    return decode_numbers(source).select("seq", "x")
