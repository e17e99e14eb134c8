"""N-gram Jaccard join by vertical partitioning of the global shingle order.

The global order is that of the shingles' 64-bit hashes. Sets are put into size classes so that linked sets are in the
same or in adjacent ones; for a class the order is cut into twice as many fragments as linked sets can have differences, so two
linked sets agree on many whole fragments. Only sets that share so many of theirs stay. Of these each keeps its rarest
fragments, one more than a linked set can lack; sets that share one of those are candidates (exact; nothing is sampled).
For verification the order is cut into a few wide fragments: a task for each one counts the partial overlaps of candidates
in it, and the counts of all fragments are summed per pair. Candidates are compared in blocks of bounded size; partial
counts travel as one matrix for each block and fragment, so copies make no row per pair. A cluster of candidates larger
than a block first links each block and a few leaders; then only the sets outside its largest component meet the other
blocks, so that a large group of near copies costs in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import mix, parts_for, shingles, slices, stash, utf8
from weir.llm.components import components
from weir.llm.exchange import frequencies, frequency

WORDS = 5
BLOCK, LEADERS, COLUMNS = 400, 8, 4096
#: Wide fragments of the order for verification: powers of two.
WIDE = 4

# Size classes [BOUNDS[c], BOUNDS[c + 1]): a set linked at four fifths is at most a quarter larger.
BOUNDS = [1]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(BOUNDS[-1] * 5 // 4 + 1)
BOUNDS = np.array(BOUNDS)
#: Differences that linked sets of a class (the smaller may be of the class below) can have, and fragments.
DIFFERENCES = (2 * (BOUNDS[1:] - 1)) // 9
FRAGMENTS = 2 * (DIFFERENCES + 1)


def set_ids(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, by content and size; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(ends)
    return np.where(n > 0, mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64)), 0)


def fragments(hashes: np.ndarray, ends: np.ndarray, up: int) -> tuple[np.ndarray, ...]:
    """Non-empty fragments of the sets under their class (up 0) or the next one (up 1): where each begins in hashes, its
    set's number, its place in the order, and the classes by set."""
    n = np.diff(ends)
    c = np.maximum(np.searchsorted(BOUNDS, n, "right") - 1, 0) + up
    frag = ((hashes >> np.uint64(32)) * np.repeat(FRAGMENTS[c], n).astype(np.uint64)) >> np.uint64(32)
    of = np.repeat(np.arange(len(n)), n)
    head = np.flatnonzero(np.concatenate([[True], (frag[1:] != frag[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.zeros(0, np.int64)
    return head, of[head], frag[head], c


def differences(n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Differences that sets of n elements can have from sets linked with them, under class c."""
    return np.minimum(n // 4, DIFFERENCES[c])


def spare(hashes: np.ndarray, ends: np.ndarray, up: int) -> np.ndarray:
    """How many of a set's fragments a linked set of that class has too, at least; 1 where it may be an empty one."""
    _, who, _, c = fragments(hashes, ends, up)
    n = np.diff(ends)
    return np.maximum(1, np.bincount(who, minlength=len(n)) - differences(n, c))


def signatures(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, up): one for each non-empty fragment of each set, under its class and the next.

    A difference spoils one fragment at most. If both of two linked sets have no more non-empty fragments than they may
    have differences, the agreeing ones can all be empty; such sets give their empty fragments too.
    """
    n = np.diff(ends)
    mixed = mix(hashes)
    out = []
    for up in (0, 1):
        head, who, frag, c = fragments(hashes, ends, up)
        tag = mix((c[who].astype(np.uint64) << np.uint64(40)) + frag + np.uint64(1))
        sums = np.add.reduceat(mixed, head) if len(head) else mixed
        out.append((mix(sums ^ tag), who, np.full(len(who), up, np.uint8)))
        few = np.flatnonzero((np.bincount(who, minlength=len(n)) <= DIFFERENCES[c]) & (n > 0))
        for s in few.tolist():
            empty = np.setdiff1d(np.arange(FRAGMENTS[c[s]]), frag[who == s].astype(np.int64)).astype(np.uint64)
            empty = mix(~mix((np.uint64(c[s]) << np.uint64(40)) + empty + np.uint64(1)))
            out.append((empty, np.full(len(empty), s), np.full(len(empty), up, np.uint8)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def rarest(hashes: np.ndarray, ends: np.ndarray, sig: np.ndarray, who: np.ndarray, up: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Places of the signatures that find all links. A set has one signature more than a linked set can lack, taken in one
    order for all sets, the rarest first: as two linked sets have enough in common, they have one of those in common.
    Sets whose empty fragments count keep all. What only one set has finds nothing."""
    n, few = np.diff(ends), []
    for u in (0, 1):
        _, of, _, c = fragments(hashes, ends, u)
        few.append((np.bincount(of, minlength=len(n)) <= DIFFERENCES[c], differences(n, c)))
    order = np.lexsort((sig, times, up, who))
    w, u = who[order], up[order]
    head = np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])]) if len(w) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(w)), 0)) if len(w) else np.zeros(0, np.int64)
    most = np.where(u == 0, few[0][1][w], few[1][1][w])
    every = np.where(u == 0, few[0][0][w], few[1][0][w])
    return order[((np.arange(len(w)) - start <= most) | every) & (times[order] > 1)]


def deal(sig: np.ndarray, parts: int, **columns: np.ndarray) -> pa.RecordBatch | None:
    """Signatures dealt over the parts: a row per part with their 32-bit keys and the other columns, as bytes."""
    if not len(sig):
        return None
    part = (sig % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cut)).tolist()
    columns = {"keys": (sig >> np.uint64(32)).astype(np.uint32), **columns}
    values = [pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary()) for x in (x[order] for x in columns.values())]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *values], ["p", *columns])


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


def agreeing(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries whose key two names or more have, and the least of those names."""
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], names[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(head, len(keys)))
    least, most = np.minimum.reduceat(names, head), np.maximum.reduceat(names, head)
    pick = np.repeat(least != most, size)
    return order[pick], np.repeat(least, size)[pick]


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Matrix of the overlaps of ascending distinct hashes, row by row."""
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    both, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.diag([len(x) for x in rows]).astype(np.int64)
    several = times > 1  # what one row has alone is in no overlap
    place, keep = np.cumsum(several) - 1, several[at]
    at, row = place[at[keep]], row[keep]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    shared = np.zeros((len(rows), len(rows)), np.int64)
    for lo in range(0, int(several.sum()), COLUMNS):
        cut = slice(*np.searchsorted(at, [lo, lo + COLUMNS]))
        m = np.zeros((len(rows), COLUMNS), np.float32)
        m[row[cut], at[cut] - lo] = 1
        shared += (m @ m.T).astype(np.int64)  # counts below 2^24 are exact
    np.fill_diagonal(shared, 0)
    return out + shared


def linked(sizes: np.ndarray, inter: np.ndarray) -> np.ndarray:
    """Whether 100 * |a & b| >= 80 * |a | b|, as a matrix."""
    return 100 * inter >= 80 * (sizes[:, None] + sizes[None, :] - inter)


_LINK = "a long, b long"


def _links(ids: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links in ok: each component's first member with the others found from it."""
    label = _labels(len(ids), *np.nonzero(np.triu(ok, 1)))
    other = np.flatnonzero(label != np.arange(len(label)))
    return ids[label[other]], ids[other]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable node of each of n nodes under links i-j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _table(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]


UNIT = ("cluster", "query", "block")
_PARTIAL = "bucket int, " + ", ".join(f"{k} long" for k in UNIT) + ", ids binary, counts binary"


def verified_links(units: DataFrame, buckets: int) -> DataFrame:
    """units (UNIT, id, hashes), a bounded number of sets in each -> a spanning set (a, b) of the links inside each unit.

    A row for each set and wide fragment goes to the fragment's tasks, which count overlaps in it; the counts of a unit
    meet in one task and are summed per pair.
    """
    shift = np.uint64(64 - (WIDE - 1).bit_length())

    def cut(batches):
        for b in batches:
            columns = {k: [] for k in ("row", "fragment", "segment")}
            for n, x in enumerate(b.column("hashes").to_pylist()):
                h = np.frombuffer(x, np.uint64)
                at = np.searchsorted(h >> shift, np.arange(WIDE + 1)).tolist()
                for f in range(WIDE):
                    if at[f] < at[f + 1]:
                        columns["row"].append(n)
                        columns["fragment"].append(f)
                        columns["segment"].append(x[8 * at[f] : 8 * at[f + 1]])
            rows = b.select(["bucket", *UNIT, "id"]).take(pa.array(columns["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(columns["fragment"], pa.int32()), pa.array(columns["segment"], pa.binary())], [*rows.schema.names, "fragment", "segment"])

    def runs(table: pa.Table):
        table = table.sort_by([(k, "ascending") for k in UNIT])
        keys = np.stack([table.column(k).to_numpy() for k in UNIT], 1)
        edge = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])), len(keys)).tolist()
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            yield keys[x].tolist(), table.slice(x, y - x)

    def partial(table: pa.Table) -> pa.Table:
        out = []
        for key, own in runs(table):
            ids, first = np.unique(own.column("id").to_numpy(), return_index=True)
            segments = own.column("segment").to_pylist()
            counts = overlaps([np.frombuffer(segments[n], np.uint64) for n in first])
            counts = counts[np.triu_indices(len(ids))].astype(np.uint32).tobytes()
            out.append([*key, ids.astype(np.int64).tobytes(), zstandard.ZstdCompressor(1).compress(counts)])
        columns = list(zip(*out, strict=True))
        return pa.table({"bucket": table.column("bucket").slice(0, 1).take([0] * len(out)), **{k: pa.array(c, pa.int64() if k in UNIT else pa.binary()) for k, c in zip((*UNIT, "ids", "counts"), columns, strict=True)}})

    def total(table: pa.Table) -> pa.Table:
        found = []
        for _, own in runs(table):
            parts = [(np.frombuffer(i, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32)) for i, c in zip(own.column("ids").to_pylist(), own.column("counts").to_pylist(), strict=True)]
            ids = np.unique(np.concatenate([i for i, _ in parts]))
            inter = np.zeros((len(ids), len(ids)), np.int64)
            for i, c in parts:
                at, (u, v) = np.searchsorted(ids, i), np.triu_indices(len(i))
                inter[at[u], at[v]] += c
            inter = np.maximum(inter, inter.T)
            found.append(_links(ids, linked(np.diag(inter), inter)))
        return _table(found)

    bucket = F.pmod(F.xxhash64(*UNIT), F.lit(buckets)).cast("int").alias("bucket")
    rows = units.select(bucket, *[F.col(k).cast("long").alias(k) for k in UNIT], "id", "hashes")
    schema = "bucket int, " + ", ".join(f"{k} long" for k in UNIT) + ", id long, fragment int, segment binary"
    counts = rows.mapInArrow(cut, schema).groupBy("bucket", "fragment").applyInArrow(partial, _PARTIAL)
    return counts.groupBy("bucket").applyInArrow(total, _LINK)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id): distinct five-word shingles and the least id reachable by links of 0.8.

    A row for each row of docs. Rows with equal ids are rows like others; those with a null id link with nothing and have
    no component. A text of fewer words is one shingle; null and empty texts and those without words have none and link
    with nothing. Equal sets are one candidate, whatever their number.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession

    def measure(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            n, sets, spares = [], [], []
            for lo, hi in slices(offs):
                h, ends = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], WORDS)
                n.append(np.diff(ends))
                sets.append(set_ids(h, ends))
                spares.append([spare(h, ends, up) for up in (0, 1)])
            if n:
                arrays = [np.concatenate(n), np.concatenate(sets).view(np.int64), *(np.concatenate([x[up] for x in spares]) for up in (0, 1))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in arrays)], ["id", "n", "set", "least0", "least1"])

    measured = stash(own.mapInArrow(measure, "id long, n long, set long, least0 long, least1 long"), "sets")
    reps = measured.where("n > 0 and id is not null").groupBy("set").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("least0").alias("least0"), F.max("least1").alias("least1"))
    parts = parts_for(spark, measured.agg(F.sum("n")).first()[0] or 0, 2_000_000)

    def sign(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            for lo, hi in slices(offs, 8 << 20):
                h, ends = [], [np.zeros(1, np.int64)]
                for x, y in slices(offs[lo : hi + 1] - offs[lo]):
                    x, y = x + lo, y + lo
                    hs, es = shingles(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], WORDS)
                    h.append(hs)
                    ends.append(es[1:] + ends[-1][-1])
                h, ends = np.concatenate(h), np.concatenate(ends)
                ids = set_ids(h, ends)
                first = np.zeros(len(ids), bool)  # a set once
                first[np.unique(ids, return_index=True)[1]] = True
                first &= ids != 0
                h = h[np.repeat(first, np.diff(ends))]
                sig, who, up = signatures(h, np.concatenate([[0], np.cumsum(np.where(first, np.diff(ends), 0))]))
                name = ids[who]
                rest = ((name >> np.uint64(32)) & np.uint64(127)).astype(np.uint8)
                out = deal(sig, parts, low=name.astype(np.uint32), high=rest * np.uint8(2) + up)
                if out is not None:
                    yield out

    def count(table: pa.Table) -> pa.Table:
        """How many of a set's fragments others have; sets go by 39 bits of their ids, and if two share those, both counts
        grow, which drops neither."""
        high = _column(table, "high", np.uint8)
        names = _column(table, "low", np.uint32).astype(np.int64) + ((high >> 1).astype(np.int64) << 32)
        at, _ = agreeing(_column(table, "keys", np.uint32), names)
        both, times = np.unique(names[at] * 2 + (high[at] & 1), return_counts=True)
        return pa.table({"name": pa.array(both >> 1), "up": pa.array((both & 1).astype(np.int32)), "c": pa.array(times, pa.int64())})

    counts = own.mapInArrow(sign, "p int, keys binary, low binary, high binary").groupBy("p").applyInArrow(count, "name long, up int, c long")
    counts = counts.groupBy("name").agg(F.sum(F.when(F.col("up") == 0, F.col("c"))).alias("c0"), F.sum(F.when(F.col("up") == 1, F.col("c"))).alias("c1"))
    named = reps.withColumn("name", F.col("set").bitwiseAND(F.lit((1 << 39) - 1)))
    stay = named.join(counts, "name").where("c0 >= least0 or c1 >= least1").select(F.col("rep").alias("_rep"))

    def gather(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            out, names = [], [np.zeros(0, np.uint64)]
            for lo, hi in slices(offs):
                h, ends = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], WORDS)
                out += [h[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                names.append(set_ids(h, ends))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(out, pa.binary())], ["id", "hashes"])

    # from here on sets go by their own ids
    sets = stash(own.join(stay, F.col("id") == F.col("_rep"), "left_semi").mapInArrow(gather, "id long, hashes binary"), "near")

    groups = parts_for(spark, sets.agg(F.sum(F.length("hashes"))).first()[0] or 0, 4 << 20)
    grouped = sets.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).groupBy("g")

    def signed(table: pa.Table) -> tuple[np.ndarray, ...]:
        """Ids, hashes and ends of a group's sets, and their signatures."""
        table = table.sort_by("id")
        rows = _sets(table)
        h, ends = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return table.column("id").to_numpy(), h, ends, *signatures(h, ends)

    def choose(table: pa.Table, answers: pa.Table) -> pa.Table:
        if len(table):
            ids, h, ends, sig, who, up = signed(table)
            at = rarest(h, ends, sig, who, up, frequency(sig, answers, parts))
            out = deal(sig[at], parts, names=ids[who[at]])
            if out is not None:
                return pa.Table.from_batches([out])
        return pa.table({"p": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "names": pa.array([], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        """Sets with equal fragments: each with the least of them."""
        names = _column(table, "names", np.int64)
        at, least = agreeing(_column(table, "keys", np.uint32), names)
        pair = np.unique(np.stack([least, names[at]], 1)[least != names[at]], axis=0)
        return _table([(pair[:, 0], pair[:, 1])])

    times = frequencies(grouped, lambda t: signed(t)[3], parts)
    chosen = grouped.cogroup(times.groupBy("g")).applyInArrow(choose, "p int, keys binary, names binary")
    clusters = components(chosen.groupBy("p").applyInArrow(meet, _LINK))
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = clusters.join(sizes, "component").select("node", F.col("component").alias("cluster"), "size")
    near = stash(sets.join(members, F.col("id") == F.col("node")).select("id", "cluster", "size", "hashes"), "clusters")
    n_near = near.count()

    zero = F.lit(0)
    inside = near.where(F.col("size") <= block).select("cluster", zero.alias("query"), zero.alias("block"), "id", "hashes")

    large = near.where(F.col("size") > block).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    # the leaders: those of the first hash values, about LEADERS in a cluster
    leads = large.where(F.pmod(F.xxhash64("id", F.lit(2)), F.ceil(F.col("size") / LEADERS)) == 0)
    spread = leads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = large.unionByName(spread).select("cluster", zero.alias("query"), (F.col("block") + 1).alias("block"), "id", "hashes")
    buckets = parts_for(spark, n_near, 300)
    first = stash(verified_links(inside.unionByName(dealt), buckets), "links")
    if large.limit(1).count():
        found = components(first)
        state = large.join(found, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id"))
        count = state.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("n"))
        main = count.groupBy("cluster").agg(F.max(F.struct("n", "c")).alias("m")).select("cluster", F.col("m.c").alias("main"))
        rest = state.join(main, "cluster").where(F.col("c") != F.col("main")).select(*near.columns, "blocks")
        count = rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("r"))
        rest = rest.join(count, "cluster").withColumn("queries", F.ceil(F.col("r") / block).cast("int"))
        rest = stash(rest.withColumn("query", F.pmod(F.xxhash64("id", F.lit(3)), F.col("queries")).cast("int")), "rest")
        asked = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        every = large.join(rest.select("cluster", "queries").distinct(), "cluster").withColumn("query", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)))

        met = asked.select(*UNIT, "id", "hashes").unionByName(every.select(*UNIT, "id", "hashes"))
        first = first.unionByName(verified_links(met, buckets))
    linked_sets = components(first)
    least = linked_sets.join(reps, F.col("node") == F.col("set")).groupBy("component").agg(F.min("rep").alias("least"))
    least = reps.join(linked_sets.join(least, "component"), F.col("set") == F.col("node"), "left").select("set", F.coalesce("least", "rep").alias("least"))
    named = measured.select("id", "n", "set").join(least, "set", "left")
    return named.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id"))
