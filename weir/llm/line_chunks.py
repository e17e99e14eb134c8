"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines of a document decides where a chunk ends, once it has two lines with
something in them, so inserted or removed lines move boundaries only nearby. Chunks of several lines that stand elsewhere
too, byte by byte, are removed; the first one (least id, then place) stays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import evenly_grown, parts_for
from weir.llm.exchange import shared, shared_bits

#: Lines that the rolling hash sees, and one in how many of its values ends a chunk.
ROLL, MEAN = 2, 2
#: A name that no table has.
GROUP = "_weir_group"
_M64 = (1 << 64) - 1
_TURN = 0x9E3779B97F4A7C15


def chunks(text: str) -> list[list[str]]:
    """Lines of text (split at \\n) in content-defined chunks of two non-blank lines or more (the last one is joined to
    the one before it if it has fewer); the text is their lines joined by \\n."""
    lines = text.split("\n")
    out, now, before, full = [], [], None, 0
    for line in lines:
        now.append(line)
        full += bool(line) and not line.isspace()
        h = xxhash.xxh3_64_intdigest(line)
        if before is not None and full >= 2 and (((before * _TURN + h) & _M64) >> 20) % MEAN == 0:
            out.append(now)
            now, full = [], 0
        before = h
    if full < 2 and out:
        out[-1] += now
    elif now:
        out.append(now)
    return out


def _several(chunk: list[str]) -> bool:
    """Chunks count from two lines with something in them."""
    return sum(1 for x in chunk if x and not x.isspace()) >= 2


def kept_text(text: str | None, gone) -> tuple[str | None, int]:
    """text without the chunks whose places are in gone, and how many lines went."""
    if text is None or gone is None or not len(gone):
        return text, 0
    gone, parts, lines = set(gone), [], 0
    for n, chunk in enumerate(chunks(text)):
        if n in gone:
            lines += len(chunk)
        else:
            parts.append("\n".join(chunk))
    return "\n".join(parts), lines


def _hash(body: str) -> int:
    return xxhash.xxh3_64_intdigest(body)


def _documents(table: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, list, list]:
    """A group's rows by id, the rows that take part (with an id and a text), and their chunks."""
    table = table.sort_by([(id_col, "ascending"), (text_col, "ascending")])
    ids, texts = table.column(id_col).to_pylist(), table.column(text_col).to_pylist()
    rows = [r for r, (i, t) in enumerate(zip(ids, texts, strict=True)) if i is not None and t is not None]
    return table, rows, [["\n".join(c) if _several(c) else None for c in chunks(texts[r])] for r in rows]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text column cleared of repeated multi-line chunks, and lines_removed (long).

    Documents travel once, in groups. Groups learn which of their chunks' hashes other groups have; such chunks, and
    those that a group has twice, are sent with their bytes, each once a group, and equal ones tell each other their
    least id: first among some of the groups, then the least of those among all, so a chunk that all have is no task of
    its own. All but the first of equal chunks go.

    Documents with a null id or text stay as they are. Rows with equal ids follow one another by their text. Texts of one
    line, and blank ones, are never removed; empty tables give no rows; other columns pass through, but for one called
    lines_removed, which is replaced.
    """
    docs = docs.drop("lines_removed")
    docs = docs.withColumns({id_col: F.col(id_col).cast("long"), text_col: F.col(text_col).cast("string")})
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    spark = docs.sparkSession
    size = evenly_grown(total, 3 << 20)
    groups, parts = parts_for(spark, total, size), parts_for(spark, total, 21 * size)
    salts = math.isqrt(groups) + 1
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).otherwise(F.xxhash64(text_col))
    grouped = docs.withColumn(GROUP, F.pmod(key, F.lit(groups)).cast("int")).groupBy(GROUP)

    def hashes(table: pa.Table) -> np.ndarray:
        _, _, cut = _documents(table, id_col, text_col)
        return np.unique(np.array([_hash(b) for c in cut for b in c if b is not None], np.uint64))

    def send(table: pa.Table, bits: pa.Table) -> pa.Table:
        """(shard, g, id, place, body) of the group's first of each chunk that may be repeated."""
        out = {"shard": [], "g": [], "id": [], "place": [], "body": []}
        if len(table):
            g = table.column(GROUP)[0].as_py()
            table, rows, cut = _documents(table, id_col, text_col)
            ids = table.column(id_col).to_pylist()
            first: dict[str, list] = {}
            for r, c in zip(rows, cut, strict=True):
                for n, b in enumerate(c):
                    if b is not None:
                        first.setdefault(b, [r, n, 0])[2] += 1
            hs = np.array([_hash(b) for b in first], np.uint64)
            distinct, at = np.unique(hs, return_inverse=True)
            elsewhere = shared(distinct, bits, parts)[at] if len(hs) else []
            for (b, (r, n, _)), h, x in zip(first.items(), hs.tolist(), elsewhere, strict=True):
                if x:
                    for k, v in zip(out, (h % groups, g, ids[r], n, b), strict=True):
                        out[k].append(v)
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)})

    def judge(table: pa.Table) -> pa.Table:
        """Rows as they came, but those whose chunk a row with a smaller id has lose their body: they are late."""
        ids, bodies = table.column("id").to_pylist(), table.column("body").to_pylist()
        least: dict[str, int] = {}
        for i, b in zip(ids, bodies, strict=True):
            if b is not None:
                least[b] = min(i, least.get(b, i))
        bodies = [None if b is None or least[b] < i else b for i, b in zip(ids, bodies, strict=True)]
        return pa.table({**{c: table.column(c) for c in ("shard", "g", "id", "place")}, "body": pa.array(bodies, pa.string())})

    names = [*docs.columns, "lines_removed"]

    def clear(table: pa.Table, late: pa.Table) -> pa.Table:
        removed = [0] * len(table)
        if len(table):
            table, rows, cut = _documents(table, id_col, text_col)
            ids, texts = table.column(id_col).to_pylist(), table.column(text_col).to_pylist()
            gone_at, seen = set(zip(late.column("id").to_pylist(), late.column("place").to_pylist(), strict=True)), set()
            gone_bodies = {c[n] for r, c in zip(rows, cut, strict=True) for n in range(len(c)) if c[n] is not None and (ids[r], n) in gone_at}
            for r, c in zip(rows, cut, strict=True):
                gone = []
                for n, b in enumerate(c):
                    if b is not None:
                        if b in gone_bodies or b in seen:
                            gone.append(n)
                        seen.add(b)
                texts[r], removed[r] = kept_text(texts[r], gone)
            at = table.column_names.index(text_col)
            table = table.set_column(at, text_col, pa.array(texts, table.column(text_col).type))
        return table.drop_columns([GROUP]).append_column("lines_removed", pa.array(removed, pa.int64())).select(names)

    bits = shared_bits(grouped, hashes, parts, GROUP)
    sent = grouped.cogroup(bits.groupBy("g")).applyInArrow(send, "shard int, g int, id long, place int, body string")
    judged = "shard int, g int, id long, place int, body string"
    some = sent.groupBy("shard", F.pmod("g", F.lit(salts))).applyInArrow(judge, judged)
    late = some.groupBy("shard").applyInArrow(judge, judged).where("body is null").select("g", "id", "place")
    schema = T.StructType([*docs.schema.fields, T.StructField("lines_removed", T.LongType())])
    return grouped.cogroup(late.groupBy("g")).applyInArrow(clear, schema)
