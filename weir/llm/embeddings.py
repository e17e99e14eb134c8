"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by its nearest reference points, in order. Inverted lists hold, for each label and reference
point, the vectors that have it first (those live there) and those that have it among their next ones (those ask there).
Pairs of one that lives in a list and another that lives or asks there and share enough reference points are candidates
and are verified by cosine; a pair that would meet in both lists counts in one. Lists are worked off in blocks and give
link counts and a spanning set of links, so a group of many near copies makes no row per pair.

The number of reference points grows with the root of the number of vectors, so the lists, which give the work per
vector, do too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import stash
from weir.llm.components import components

#: Reference points for n vectors: PER_ROOT times the root of n, between these bounds.
PER_ROOT, FEWEST, PIVOTS = 2.3, 64, 8192
#: How many reference points describe a vector, in how many lists it asks or lives, how many a candidate pair shares.
NEAREST, LISTS, SHARED = 8, 6, 2
#: Vectors of a block: those that live in a list, and those that ask there.
BLOCK, ASKING = 1024, 4096
#: Reference points come from a sample by hash of so many times their number, and none has a cosine of APART to another,
#: so a group of near copies owns one or a few of them, which its members share, however large it is.
DRAWN, APART = 4, 0.8


def reference_points(sample: np.ndarray, most: int, batch: int = 512) -> np.ndarray:
    """The first rows of sample (of length 1), at most so many, without those near one taken before."""
    out = np.zeros((0, sample.shape[1]), sample.dtype)
    for at in range(0, len(sample), batch):
        rows = sample[at : at + batch]
        if len(out):
            rows = rows[(rows @ out.T).max(axis=1) < APART]
        near, taken = rows @ rows.T >= APART, []
        for n in range(len(rows)):
            if not near[n, taken].any():
                taken.append(n)
        out = np.concatenate([out, rows[taken]])[:most]
        if len(out) == most:
            break
    return out


def _vectors(column: pa.ChunkedArray | pa.Array, kind: str) -> list[np.ndarray]:
    """The rows of a column of lists without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, ends = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _labels(n: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least reachable of n nodes under links u-w."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[w])
        np.minimum.at(new, w, label[u])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many reference points each row of a has in common with each of b."""
    used = np.unique(a)
    sides = []
    for rows in (a, b):
        at = np.minimum(np.searchsorted(used, rows), len(used) - 1)
        has = np.zeros((len(rows), len(used)), np.float32)
        n, k = np.nonzero(used[at] == rows)
        has[n, at[n, k]] = 1
        sides.append(has)
    return sides[0] @ sides[1].T


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id): other vectors of the same label with cosine >= least, and the least id reachable.

    Vectors that are null, zero, or hold null or non-finite components, those with a null label and those with a null id
    link with nothing (and a null id's component is null). Only vectors of one length are compared. Equal vectors are one
    entry of the index with their number; rows with equal ids count as rows, in one component. No link below `least` is
    given; of those above, the index finds nearly all (tests measure it against all pairs).
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    v = F.col(vector_col) if kind == "<f4" else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    counts = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    own = own.withColumn("counts", F.coalesce(counts, F.lit(False)))
    valid = own.where("counts")
    entries = stash(valid.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("entry", F.monotonically_increasing_id()), "entries")
    n_entries = entries.count()
    if pivots is None:
        pivots = int(min(PIVOTS, max(FEWEST, PER_ROOT * n_entries**0.5)))
    sample = entries.select("v").orderBy(F.xxhash64("id", "label")).limit(DRAWN * pivots)
    sample = _vectors(sample.toArrow().column("v"), kind)  # so many vectors at most
    width = max(map(len, sample), default=1)
    points = np.zeros((len(sample), width), np.float32)
    for n, x in enumerate(sample):
        points[n, : len(x)] = np.array(x) / np.abs(x).max()
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-30)
    points = reference_points(points, pivots)

    def describe(batches):
        for b in batches:
            rows = _vectors(b.column("v"), kind)
            if not rows:
                continue
            short = np.zeros((len(rows), width), np.float32)
            for n, x in enumerate(rows):
                short[n, : len(x)] = x[:width] / np.abs(x).max()
            near = np.argsort(-(short @ points.T), axis=1, kind="stable")[:, :NEAREST]
            yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("label"), b.column("id"), b.column("copies"), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["entry", "label", "id", "copies", "v", "near"])

    index = stash(entries.select("entry", "label", "id", "copies", "v").mapInArrow(describe, "entry long, label string, id long, copies long, v binary, near array<int>"), "index")
    keys = ["label", "width", "pivot"]
    lists = index.select("*", F.length("v").alias("width"), F.posexplode(F.slice("near", 1, LISTS)).alias("place", "pivot")).withColumn("lives", F.col("place") == 0)
    sizes = lists.groupBy(*keys).agg(F.ceil(F.count_if("lives") / block).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("lives")) / ASKING).cast("int").alias("asking"))
    lists = lists.join(sizes.where("homes > 0"), keys)  # where nothing lives nothing is found
    own_block = F.when(F.col("lives"), F.pmod(F.xxhash64("entry"), F.col("homes"))).otherwise(F.pmod(F.xxhash64("entry"), F.greatest("asking", F.lit(1)))).cast("int")
    lists = lists.withColumn("block", own_block)
    # a block of those that live here meets itself, the later ones, and all that ask; the first of these come along
    home, b = F.sequence(F.lit(0), F.col("homes") - 1), F.col("block")
    other = F.transform(home, lambda h: F.struct(F.least(h, b).alias("lo"), F.greatest(h, b).alias("hi")))
    later = F.when(F.col("asking") > 1, F.transform(F.sequence(F.lit(1), F.col("asking") - 1), lambda j: F.struct(b.alias("lo"), (F.col("homes") + j).alias("hi"))))
    asked = F.transform(home, lambda h: F.struct(h.alias("lo"), F.when(b == 0, h).otherwise(F.col("homes") + b).alias("hi")))
    places = F.when(F.col("lives"), F.concat(other, F.coalesce(later, F.slice(other, 1, 0)))).otherwise(asked)
    tasks = lists.select(*keys, "entry", "copies", "v", "near", "lives", "block", F.inline(places))

    def verify(table: pa.Table) -> pa.Table:
        p, lo, hi = (table.column(k)[0].as_py() for k in ("pivot", "lo", "hi"))
        table = table.sort_by("entry")
        ids, copies = table.column("entry").to_numpy(), table.column("copies").to_numpy()
        lives, block = table.column("lives").to_numpy(zero_copy_only=False), table.column("block").to_numpy()
        near = np.array(table.column("near").to_pylist(), np.int32)
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        here = lives & (block == lo)
        a = np.flatnonzero(here)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for b in (a if lo == hi else a[:0], np.flatnonzero(~here)):
            if not len(a) or not len(b):
                continue
            ok = shared_counts(near[a], near[b]) >= min(SHARED, len(points))
            # what asks here meets a also in its own list if that is one of a's: the pair counts in the lower one
            both = (near[b][:, 0] != p) & (near[b][:, 0] < p)
            ok &= ~(both[None, :] & (near[a][:, :LISTS, None] == near[b][:, 0]).any(axis=1))
            u, w = np.nonzero(ok)
            if 8 * len(u) < ok.size:
                good = np.concatenate([(x[a[u[k : k + 65536]]] * x[b[w[k : k + 65536]]]).sum(axis=1) for k in range(0, len(u), 65536)] or [np.zeros(0)]) / (norm[a[u]] * norm[b[w]]) >= least
            else:
                good = ((x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= least)[u, w]
            u, w = a[u[good]], b[w[good]]
            if b is a:
                u, w = u[u != w], w[u != w]
            links += np.bincount(u, copies[w], len(ids)).astype(np.int64)
            if b is not a:
                links += np.bincount(w, copies[u], len(ids)).astype(np.int64)
            # links that connect what this task connects
            label = _labels(len(ids), np.concatenate([u, np.arange(len(ids))]), np.concatenate([w, label]))
        some = links > 0
        return pa.table({"entry": pa.array(ids[some]), "links": pa.array(links[some]), "to": pa.array(ids[label[some]])})

    found = stash(tasks.groupBy(*keys, "lo", "hi").applyInArrow(verify, "entry long, links long, to long"), "links")
    groups = components(found.select(F.col("entry").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("entry").agg(F.sum("links").alias("links"))
    entry = index.select("entry", "id", "copies").join(counts, "entry", "left").join(groups, F.col("entry") == F.col("node"), "left")
    entry = stash(entry.select("entry", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "entry").alias("group")), "groups")
    first = entry.groupBy("group").agg(F.min("id").alias("component_id"))
    entry = entry.join(first, "group").select("entry", "n_links", "component_id")
    member = valid.join(entries.select("label", "v", "entry"), ["label", "v"]).select("id", "entry").join(entry, "entry").select("id", "n_links", "component_id")
    alone = own.where("not counts").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return member.unionByName(alone)
