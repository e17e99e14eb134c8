"""Repeated byte strings by suffix arrays, built shard by shard with induced sorting.

How shards come about: of the `grams` byte k-grams inside any `span`-byte string, the one with the least hash is its
anchor. Equal strings have equal anchors at equal places, so all strings go to shards by anchor, and each shard decides
alone which of its strings occur in which document. Anchors that only one document has are dropped first: each group of
documents sends the distinct hashes of its anchors to the parts of the hash range and gets back which of them other
groups have too. What is left travels as snippets (all windows of one anchor in a row), once per group and content.

In a shard, the distinct snippets are concatenated, suffixes are classified, leftmost-smaller substrings sorted by
induction and named (the string of names is ordered by doubling ranks), the array is induced from them, and permuted
common prefixes tell which neighbours in the array share `span` bytes. The least document of such a run owns the string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import evenly_grown, mix, parts_for, powers, prefix_hash
from weir.llm.exchange import shared, shared_bits

SPAN, GRAM = 50, 26
_LOW = np.uint64((1 << 20) - 1)
#: Bytes scanned at once: arrays of eight times that stay in cache, and positions fit in 20 bits.
_SCAN = 1 << 17


# --- one shard's array ---------------------------------------------------------------------------


def _deal(entries: np.ndarray, s: np.ndarray, kind: np.ndarray, want: bool, into: list[list]) -> None:
    """Append the predecessors of entries that have the wanted kind to their buckets, in order."""
    j = entries - 1
    j = j[j >= 0]
    j = j[kind[j] == want]
    if not len(j):
        return
    c = s[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    at = 0
    for to in [*cuts.tolist(), len(j)]:
        into[c[at]].append(j[at:to])
        at = to


def _induce(s: np.ndarray, kind: np.ndarray, seeds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(larger, smaller) suffixes by first symbol, from leftmost-smaller suffixes in the order given."""
    size, none = int(s.max()) + 1, np.zeros(0, np.int64)
    first = s[seeds]
    order = np.argsort(first, kind="stable")
    seeds = seeds[order]
    bounds = np.searchsorted(first[order], np.arange(size + 1))
    left: list[list] = [[] for _ in range(size)]
    larger = [none] * size
    for c in range(size):
        done = 0
        while done < len(left[c]):  # suffixes induced inside the bucket come after those before them
            wave = np.concatenate(left[c][done:])
            done = len(left[c])
            _deal(wave, s, kind, False, left)
        if left[c]:
            larger[c] = np.concatenate(left[c])
        if bounds[c] < bounds[c + 1]:
            _deal(seeds[bounds[c] : bounds[c + 1]], s, kind, False, left)
    right: list[list] = [[] for _ in range(size)]
    smaller = [none] * size
    for c in range(size - 1, -1, -1):
        done = 0
        while done < len(right[c]):
            wave = np.concatenate(right[c][done:])
            done = len(right[c])
            _deal(wave, s, kind, True, right)
        if right[c]:
            smaller[c] = np.concatenate(right[c])[::-1]
        _deal(larger[c][::-1], s, kind, True, right)
    smaller[0] = np.array([len(s) - 1], np.int64)
    return list(zip(larger, smaller, strict=True))


def _order_names(names: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of the string of names in the order of its suffixes, as far as `symbols` names decide."""
    rank, n, reach = names.astype(np.int64), len(names), 1
    order = np.argsort(rank, kind="stable")
    while reach < symbols:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank, reach = new, 2 * reach
        if rank[order[-1]] == n - 1:
            break
    return order


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (its last symbol is a 0 of its own) in order, as far as their first `depth` symbols decide."""
    n = len(s)
    step = s[1:].astype(np.int32) - s[:-1]
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    kind = np.ones(n, bool)  # smaller than the suffix to its right
    kind[:-1] = np.append(step, 1)[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = np.concatenate([b for _, b in _induce(s, kind, lms)])
    order = order[is_lms[order]]
    # names: equal for equal substrings from one leftmost-smaller suffix to the next
    until = np.zeros(n, np.int64)
    until[lms] = np.append(lms[1:], n - 1) - lms + 1
    a, b = order[:-1], order[1:]
    same = until[a] == until[b]
    live, off = np.flatnonzero(same), 0
    while len(live):
        eq = s[a[live] + off] == s[b[live] + off]
        same[live[~eq]] = False
        off += 1
        live = live[eq]
        live = live[until[a[live]] > off]
    names_by_order = np.concatenate([[0], np.cumsum(~same)])
    if names_by_order[-1] < len(order) - 1:
        names = np.empty(n, np.int64)
        names[order] = names_by_order
        order = lms[_order_names(names[lms], depth // 2 + 1)]
    return np.concatenate([x for pair in _induce(s, kind, order) for x in pair])


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each text position, the bytes it shares with its left neighbour in the array, at most `most`."""
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(most + 8, data.dtype)])
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(phi >= 0)
    for off in range(0, most, 8):
        a, b = live + off, phi[live] + off
        alive = np.ones(len(live), bool)
        for j in range(min(8, most - off)):
            ok = (padded[a + j] == padded[b + j]) & alive
            out[live[ok]] += 1
            alive = ok
            if not alive.any():
                break
        live = live[alive]
    return out


def owners(bodies: list[bytes], ids: np.ndarray, span: int) -> list[np.ndarray]:
    """For each body and each span-byte window in it, the least id of a body that holds the same window."""
    if not bodies:
        return []
    lens = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    s = np.zeros(int(lens.sum()) + len(bodies) + 1, np.uint16)
    joined = np.frombuffer(b"\0".join(bodies), np.uint8)
    s[: len(joined)] = joined.astype(np.uint16) + 2
    s[starts + lens] = 1  # a mark after each body, the end after all
    sa = suffix_array(s, span)
    prefixes = permuted_prefixes(s, sa, span)
    body = np.repeat(np.arange(len(bodies)), lens + 1)
    room = (starts + lens)[body] - np.arange(len(body))  # bytes from here to the body's end
    sa = sa[sa < len(body)]
    sa = sa[room[sa] >= span]
    head = np.flatnonzero(prefixes[sa] < span)
    if not len(head) or head[0] != 0:
        head = np.concatenate([[0], head])
    least = np.minimum.reduceat(ids[body[sa]], head)
    owner = np.empty(len(body), np.int64)
    owner[sa] = np.repeat(least, np.diff(np.append(head, len(sa))))
    return [owner[a : a + n - span + 1] for a, n in zip(starts.tolist(), lens.tolist(), strict=True)]


# --- anchors -------------------------------------------------------------------------------------


def snippets(texts: list[bytes], span: int = SPAN, gram: int = GRAM):
    """(row, start, length, anchor hash) of the snippets of texts: maximal runs of windows with one anchor."""
    pieces = [(n, at) for n, t in enumerate(texts) for at in range(0, max(0, len(t) - span + 1), _SCAN // 2)]
    out = []
    at = 0
    while at < len(pieces):
        batch, size = [], 0
        while at < len(pieces):
            n, off = pieces[at]
            part = texts[n][off : off + _SCAN // 2 + span - 1]
            if batch and size + len(part) > _SCAN:
                break
            batch.append((n, off, part))
            size += len(part)
            at += 1
        out.append(_scan(batch, span, gram))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(batch: list[tuple[int, int, bytes]], span: int, gram: int):
    data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    lens = np.array([len(p) for _, _, p in batch])
    ends = np.cumsum(lens)
    p = prefix_hash(data)
    h = mix((p[gram:] - p[:-gram]) * powers(len(p))[1][: len(p) - gram])
    key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))  # the last of equal ones wins
    width, least = span - gram + 1, key
    have = 1
    while have < width:  # least of `have` keys from here, doubled until the window is full
        more = min(have, width - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    piece = np.repeat(np.arange(len(batch)), lens)
    start = np.arange(len(least))
    ok = start + span <= ends[piece[: len(least)]]
    start, least = start[ok], least[ok]
    anchor = (_LOW - (least & _LOW)).astype(np.int64)
    piece = piece[start]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.append(head[1:], len(start)) - 1
    rows, offs = np.array([n for n, _, _ in batch]), np.array([o for _, o, _ in batch])
    where = piece[head]
    begin = start[head] - (ends - lens)[where] + offs[where]
    return rows[where], begin, start[last] - start[head] + span, h[anchor[head]]


def _several(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each snippet's place among them, and which of them two rows or more have."""
    distinct, place = np.unique(h, return_inverse=True)
    lo, hi = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), -1)
    np.minimum.at(lo, place, row)
    np.maximum.at(hi, place, row)
    return distinct, place, lo < hi


def _pack(rows: list[tuple[int, int, int, int, bytes]]) -> bytes:
    """(anchor, id, row, start, body) rows, columns one after another, compressed."""
    anchors, ids, places, starts, bodies = zip(*rows, strict=True)
    columns = np.array([len(rows)], np.uint32), np.array([len(b) for b in bodies], np.uint16), np.array(ids, np.int64), np.array(places, np.int32), np.array(starts, np.int64), np.array(anchors, np.uint32)
    return zstandard.ZstdCompressor(1).compress(b"".join([*(c.tobytes() for c in columns), *bodies]))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(anchors, ids, rows, starts, bodies) of _pack."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    out, at = [], 4
    for kind in (np.uint16, np.int64, np.int32, np.int64, np.uint32):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    ends = (at + np.cumsum(out[0], dtype=np.int64)).tolist()
    return out[4], out[1], out[2], out[3], [data[a:b] for a, b in zip([at, *ends[:-1]], ends, strict=True)]


def _documents(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A group's rows in an order that is the same each time, their ids and their bytes."""
    table = table.sort_by([("id", "ascending"), ("data", "ascending")])
    return table, table.column("id").to_numpy(), table.column("data").to_pylist()


# --- the job -------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, and the columns of `keep`): per row, what is left of its UTF-8 bytes when
    each byte covered by a `span`-byte string that also starts in a document with a smaller id is taken out.

    Rows with equal ids are not smaller than one another, so they lose nothing to each other; rows with a null id are
    neither smaller nor larger than any, so they stay whole and take nothing from others. Null texts are empty; texts
    shorter than the span stay. Strings never cross documents, and a string repeated inside one document alone stays.
    """
    passed = [F.col(c).alias(f"_kept{n}") for n, c in enumerate(keep)]
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("data"), *passed)
    spark = docs.sparkSession
    total = own.agg(F.sum(F.length("data"))).first()[0] or 0
    nameless, own = own.where("id is null"), own.where("id is not null")
    size = evenly_grown(total, 3 << 20)
    groups, parts = parts_for(spark, total, size), parts_for(spark, total, 4 * size)
    names = [f.name for f in own.schema.fields[2:]]
    own = own.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), "id", "data", *names)

    def anchors(table: pa.Table) -> np.ndarray:
        return np.unique(snippets(_documents(table)[2], span)[3])

    def send(docs: pa.Table, bits: pa.Table) -> pa.Table:
        """Snippets at shared anchors, each content from its first place in the group only."""
        shards: dict[int, list] = {}
        if len(docs):
            g = docs.column("g")[0].as_py()
            _, ids, texts = _documents(docs)
            row, start, length, h = snippets(texts, span)
            distinct, place, several = _several(h, row)
            seen: set[bytes] = set()
            pick = np.flatnonzero((several | shared(distinct, bits, parts))[place])
            shard = (h[pick] >> np.uint64(8)) % np.uint64(groups)
            anchor = (h[pick] >> np.uint64(32)).tolist()
            for r, s, n, k, a in zip(row[pick].tolist(), start[pick].tolist(), length[pick].tolist(), shard.tolist(), anchor, strict=True):
                body = texts[r][s : s + n]
                if body not in seen:
                    seen.add(body)
                    shards.setdefault(k, []).append((a, int(ids[r]), r, s, body))
        else:
            g = 0
        order = sorted(shards)
        return pa.table({"shard": pa.array(order, pa.int32()), "g": pa.array([g] * len(order), pa.int32()), "rows": pa.array([_pack(shards[k]) for k in order], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        """Removed ranges of the snippets of a shard, counted from where the snippet begins."""
        parts = [_unpack(x) for x in table.column("rows").to_pylist()]
        groups = np.repeat(table.column("g").to_numpy(), [len(p[4]) for p in parts])
        anchors, ids, row, begin = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 3))
        bodies = [b for p in parts for b in p[4]]
        order = np.lexsort((begin, row, ids))
        groups, anchors, ids, row, begin, bodies = groups[order], anchors[order], ids[order], row[order], begin[order], [bodies[n] for n in order.tolist()]
        first: dict[bytes, int] = {}
        for n, b in enumerate(bodies):
            first.setdefault(b, n)
        own = np.fromiter(first.values(), np.int64, len(first))
        out = []
        # windows of a snippet that is its anchor's only content stand nowhere else
        _, place, contents = np.unique(anchors[own], return_inverse=True, return_counts=True)
        own = own[contents[place] > 1]
        for n, owner in zip(own.tolist(), owners([bodies[n] for n in own.tolist()], ids[own], span), strict=True):
            lost = np.concatenate([[False], owner < ids[n], [False]])
            if lost.any():
                edge = np.flatnonzero(lost[1:] != lost[:-1])
                out += [(n, int(a), int(b - 1 + span)) for a, b in edge.reshape(-1, 2)]
        out += [(n, 0, len(b)) for n, b in enumerate(bodies) if ids[first[b]] < ids[n]]
        pick = np.array([x[0] for x in out], np.int64)
        columns = {"g": groups[pick].astype(np.int32), "row": row[pick], "begin": begin[pick]}
        return pa.table({**{k: pa.array(v) for k, v in columns.items()}, "start": pa.array([x[1] for x in out], pa.int64()), "stop": pa.array([x[2] for x in out], pa.int64())})

    def clear(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        """Take out the ranges found by the shards, wherever their content stands in the same document, and what a
        smaller document of the group holds in full."""
        docs, ids, texts = _documents(docs) if len(docs) else (docs, np.zeros(0, np.int64), [])
        row, start, length, h = snippets(texts, span)
        found: dict[tuple[int, int], list] = {}
        for r, s, a, b in zip(*(ranges.column(k).to_pylist() for k in ("row", "begin", "start", "stop")), strict=True):
            found.setdefault((r, s), []).append((a, b))
        # what was sent has several rows in the group, or ranges; other contents stand for themselves
        _, place, several = _several(h, row)
        asked = np.zeros(int(place.max()) + 1 if len(place) else 0, bool)
        spot = np.array([(r << 34) + s for r, s in found], np.int64)
        asked[place[np.searchsorted((row << 34) + start, spot)]] = True  # snippets come in this order
        pick = np.flatnonzero((several | asked)[place])
        lost: dict[int, list] = {}
        first: dict[bytes, tuple[int, int]] = {}
        for r, s, n in zip(row[pick].tolist(), start[pick].tolist(), length[pick].tolist(), strict=True):
            origin = first.setdefault(texts[r][s : s + n], (r, s))
            if ids[origin[0]] < ids[r]:
                lost.setdefault(r, []).append((s, s + n))
            elif origin in found:
                lost.setdefault(r, []).extend((s + a, s + b) for a, b in found[origin])
        out = {"id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for r, t in enumerate(texts):
            at, runs, kept = 0, 0, []
            stop = -1
            for a, b in sorted(lost.get(r, ())):
                if a > stop:
                    kept.append(t[max(at, 0) : a])
                    runs += 1
                stop = at = max(stop, b)
            kept.append(t[at:])
            body = b"".join(kept)
            for k, v in zip(("n_bytes", "n_removed", "n_spans", "kept"), (len(t), len(t) - len(body), runs, body), strict=True):
                out[k].append(v)
        kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        done = pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})
        for name in names:
            done = done.append_column(name, docs.column(name))
        return done

    by_group = own.groupBy("g")
    bits = shared_bits(by_group, anchors, parts)
    sent = by_group.cogroup(bits.groupBy("g")).applyInArrow(send, "shard int, g int, rows binary")
    ranges = sent.groupBy("shard").applyInArrow(judge, "g int, row int, begin long, start long, stop long")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())] + nameless.schema.fields[2:])
    done = by_group.cogroup(ranges.groupBy("g")).applyInArrow(clear, schema)
    whole = nameless.select("id", F.length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("data").alias("kept"), *names)
    out = done.unionByName(whole)
    return out.select("id", "n_bytes", "n_removed", "n_spans", "kept", *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])
