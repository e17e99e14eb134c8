"""Packing: window recipes by non-negative least squares against the length histogram, rounded; residuals greedily.

A piece is a whole document, or one window's worth of a longer one and its rest. Piece lengths are counted in
classes of 1 to `step` tokens, finer for short pieces so that rounding up wastes little of any; a recipe is a shallow
combination of classes that fills a window, and least squares with non-negative repeat counts fits the recipes to the
histogram. Only the histogram (a few more than window / step numbers) reaches the driver; pieces find their sequence by joining their class and their rank in it with the recipes' rank ranges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import ranked, stash


def cut_pieces(tokens: DataFrame, window: int, end_id: int | None = None) -> DataFrame:
    """(id, ids) -> (id, start, length, ids_crc32, doc_tokens): cut at multiples of the window; ids are little-endian
    unsigned 32-bit. With end_id, that id is appended to each document. A document without ids gives no piece."""
    ids = F.col("ids") if end_id is None else F.concat("ids", F.lit(int(end_id).to_bytes(4, "little")))
    t = tokens.select("id", ids.alias("ids")).withColumn("n", (F.length("ids") / 4).cast("int")).where("n > 0")
    t = t.select("id", "ids", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(window))).alias("start"))
    length = F.least(F.lit(window), F.col("n") - F.col("start"))
    return t.select(
        "id",
        F.col("start").cast("long").alias("start"),
        length.cast("long").alias("length"),
        F.crc32(F.substring("ids", F.col("start") * 4 + 1, length * 4)).alias("ids_crc32"),
        F.col("n").cast("long").alias("doc_tokens"),
    )


def size_class(length: Column, step: int) -> Column:
    """length rounded up to its class: exact up to 4 * step, then to multiples that double with each doubling, up to step."""
    bits = F.length(F.bin(length - 1)) - step.bit_length() - 1
    width = F.element_at(F.array(*[F.lit(1 << n) for n in range(step.bit_length())]), F.greatest(F.lit(0), F.least(bits, F.lit(step.bit_length() - 1))) + 1)
    return (F.ceil(length / width) * width).cast("int")


def class_sizes(window: int, step: int) -> np.ndarray:
    """All values of size_class up to the window, from 0 on."""
    out, size = [0], 0
    while size < window:
        size += 1 << max(0, min(size.bit_length() - step.bit_length() - 1, step.bit_length() - 1))
        out.append(size)
    return np.array(out)


def recipes(window: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """Shallow combinations of classes that fill a window but for 1/256 of it at most: repeats of one or two classes, and
    three different ones of a sixteenth of the window or more. A row per recipe, a column per class (column 0 unused)."""
    sizes = np.arange(window + 1) if sizes is None else sizes
    waste, found = window // 256, set()

    def below(room: int) -> int:
        return int(np.searchsorted(sizes, room, side="right")) - 1

    for i in range(1, len(sizes)):
        most = window // int(sizes[i])
        for a in {*range(1, min(most, 12) + 1), *(n for n in (most, most // 2, most // 4, most // 8) if n)}:
            rest = window - a * int(sizes[i])
            if rest <= waste:
                found.add(((i, a),))
            for b in range(1, 4):
                j = below(rest // b)
                if j and j != i and rest - b * int(sizes[j]) <= waste:
                    found.add(tuple(sorted(((i, a), (j, b)))))
    for i in range(below(window // 16), len(sizes)):
        for j in range(i + 1, len(sizes)):
            k = below(window - int(sizes[i] + sizes[j]))
            if k <= j:
                break
            if i and sizes[i] + sizes[j] + sizes[k] >= window - waste:
                found.add(((i, 1), (j, 1), (k, 1)))
    out = np.zeros((len(found), len(sizes)), np.float32)
    for n, recipe in enumerate(sorted(found)):
        for c, a in recipe:
            out[n, c] += a
    return out


def nnls(columns: np.ndarray, goal: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |columns.T x - goal| small: accelerated projected gradient, deterministic."""
    x = y = np.zeros(len(columns))
    if not goal.any() or not len(columns):
        return x
    v = np.ones(columns.shape[1])
    for _ in range(30):  # the largest singular value bounds the step
        v = columns.T @ (columns @ v)
        v /= np.linalg.norm(v)
    bound, t = np.linalg.norm(columns.T @ (columns @ v)) * 1.01, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - columns @ (columns.T @ y - goal) / bound)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def plan(histogram: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[dict[int, int], int]]:
    """(pieces by class, repeats) that use up the histogram (counts by class) exactly. The last class fills a window;
    without sizes, a class's number is its size."""
    sizes = np.arange(len(histogram)) if sizes is None else sizes
    window, left = int(sizes[-1]), histogram.astype(np.int64).copy()
    out = []
    table = recipes(window, sizes)
    table = table[~(table[:, left == 0] > 0).any(axis=1)]  # only those that the histogram can serve
    x = nnls(table.astype(np.float64), left.astype(np.float64))
    for n in np.argsort(-x, kind="stable"):
        if x[n] < 0.5:
            break
        need = {int(c): int(table[n, c]) for c in np.flatnonzero(table[n])}
        repeats = min(int(round(x[n])), *(int(left[c]) // a for c, a in need.items()))
        if repeats:
            out.append((need, repeats))
            for c, a in need.items():
                left[c] -= a * repeats
    while left.any():  # residuals: the largest class first, then always the largest that still fits
        need: dict[int, int] = {}
        room = window
        for c in np.flatnonzero(left)[::-1].tolist():
            a = min(int(left[c]), room // int(sizes[c]))
            if a:
                need[c] = a
                room -= a * int(sizes[c])
        repeats = min(int(left[c]) // a for c, a in need.items())
        out.append((need, repeats))
        for c, a in need.items():
            left[c] -= a * repeats
    return out


def pack(pieces: DataFrame, window: int, step: int = 16) -> DataFrame:
    """pieces with sequence_id and offset: every piece in one sequence, no sequence longer than the window, offsets
    gapless from 0. window must be a multiple of step, and step a power of two. Empty input: no rows; ties in length go by id and start."""
    sizes = class_sizes(window, step)
    pieces = stash(pieces.withColumn("class", size_class(F.col("length"), step)), "pieces")
    counts = dict(pieces.groupBy("class").count().collect())  # at most a row for each size
    histogram = np.array([counts.get(n, 0) for n in sizes.tolist()], np.int64)
    base, used, rows = 0, np.zeros(len(sizes), np.int64), []
    for need, repeats in plan(histogram, sizes):
        slot = 0
        for c in sorted(need, reverse=True):
            rows.append((int(sizes[c]), int(used[c]), int(used[c] + need[c] * repeats), repeats, base, slot))
            used[c] += need[c] * repeats
            slot += need[c]
        base += repeats
    spark = pieces.sparkSession
    ranges = spark.createDataFrame(rows, "class int, lo long, hi long, repeats long, base long, slot int")  # a few for each class
    placed = ranked(pieces, ["class"], ["id", "start"], "rank", int(histogram.max(initial=0)))
    placed = placed.join(F.broadcast(ranges), "class").where("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.col("base") + (F.col("rank") - F.col("lo")) % F.col("repeats"))
    placed = placed.withColumn("slot", F.col("slot") + F.expr("(rank - lo) div repeats"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.drop("class", "rank", "lo", "hi", "repeats", "base", "slot")
