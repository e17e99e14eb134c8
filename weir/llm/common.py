"""What the corpus operators share: the shared folder, written tables, ranks and text batches."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where driver and executor are one
    process, an unset one is set to a folder of our own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="weir-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weir-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, amount: int, per_part: int) -> int:
    """So many parts that each has about per_part of amount, and the cluster is busy."""
    return max(2 * shuffle_parts(spark), -(-int(amount) // per_part))


def evenly_grown(total: int, size: int, most: int = 256 << 20) -> int:
    """Bytes for a group of documents: `size` up to a gigabyte in all, then growing with the root of the total, so that
    groups times parts grow in proportion with the data. `most` is what a task of a few gigabytes can hold."""
    return min(most, int(size * max(1.0, (total / (1 << 30)) ** 0.5)))


def rank_parts(rows: int) -> int:
    """Parts for a rank of so many rows: as many as a part then has rows, but no smaller than 1000."""
    return max(1, -(-rows // max(1000, math.isqrt(rows))))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """df with a gapless rank from 0 within by, whose largest group has so many rows, about. Rows are dealt over hashed
    parts, ranked in each, and shifted by the counts of the parts before, so no group (not even all rows) meets in one
    task."""
    n = rank_parts(rows)
    own = [F.col(c) for c in by]
    part = F.pmod(F.xxhash64(*order), F.lit(n)).alias("_part")
    df = df.select("*", part)
    counts = df.groupBy(*own, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*own, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*own, "_part").orderBy(*order)
    df = df.withColumn("_at", F.row_number().over(inside))
    return df.join(counts, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_before", "_at")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# --- text batches ------------------------------------------------------------------------------

#: Bytes handled at once by the array kernels; longer texts are their own slice.
SLICE = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[offs[0] : offs[-1]] if len(offs) else data[:0]), (offs - offs[0] if len(offs) else np.zeros(1, np.int64))


def slices(offs: np.ndarray, most: int = SLICE):
    """Row ranges of at most `most` bytes each, or of one row."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and their inverses."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray, weight: np.ndarray = _BYTE) -> np.ndarray:
    """P with (P[b] - P[a]) * inverse_power[a] a polynomial hash of data[a:b]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(weight[data] * up[:-1], out=out[1:])
    return out


def span_hash(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return mix((p[b] - p[a]) * down[a] + (b - a).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of each row."""
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = word
    end[1:-1] &= ~word[1:]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    start[edge] = word[edge]
    end[edge[1:]] |= word[edge[1:] - 1]
    return np.flatnonzero(start), np.flatnonzero(end)


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each row, ascending, and the rows' offsets into them. A-Z count as
    a-z; a row with fewer words has its whole sequence as one shingle; one without words has none."""
    low = _LOWER[data]
    a, b = word_spans(low, offs)
    h = span_hash(prefix_hash(low), a, b)
    first = np.searchsorted(a, offs)  # words before each row
    n = np.diff(first)
    folded = h * np.uint64(0xC2B2AE3D27D4EB4F)
    out, ends = [], [0]
    lanes = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        full += h[j : j + len(full)] * lanes[j]
    full = mix(full)
    for at, m in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if m >= k:
            s = np.sort(full[at : at + m - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif m:
            with np.errstate(over="ignore"):
                out.append(mix((folded[at : at + m] * lanes[:m]).sum(keepdims=True) + np.uint64(m)))
        ends.append(ends[-1] + (len(out[-1]) if m else 0))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(ends)
