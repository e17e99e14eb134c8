"""BPE encoding and decoding with a public tokenizer file, long texts by tree concatenation.

Texts of at most `leaf` characters are encoded whole. A longer one is cut into leaves, wherever the cuts fall,
and the leaves are encoded in parallel tasks. Neighbours are then joined pairwise, level by level: the tokens
around the cut are encoded again in a window that grows until its first tokens agree with the left side's and
its last with the right side's. Agreement makes the joined sequence exact: pieces of the pre-tokenizer are
encoded independently, and inside one piece a sequence is the encoding if each pair of neighbouring tokens is.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import unicodedata
from functools import cached_property
from itertools import compress, pairwise
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm.common import stash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LEAF = 32_768
#: Bytes (about) of the pieces that a Python worker remembers, and of an entry beside its text and ids.
REMEMBERED, ENTRY = 64 << 20, 150
#: Bytes of the texts whose new pieces are encoded in one call.
TOGETHER = 500_000
#: Rows of a result batch.
ROWS = 500
_LOADED: dict[str, Bpe] = {}


#: The pre-tokenizer's pattern that cut_latin follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = [chr(c) for c in range(256)]
# Latin-1 in lower case, white space (as the pattern has it) as blanks.
_LOWERED = "".join(" " if c in "\t\n\x0b\x0c\r \x85\xa0" else c.lower() for c in _LATIN).encode("latin-1")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_SPACE if chr(c) == " " else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(c))[0], _OTHER) for c in _LOWERED], np.uint8)
# Whether a piece ends between two kinds that aren't white space: 4 * the first + the second.
_EDGE = np.array([bool(a and b and (a != b or b == _DIGIT)) for a in range(4) for b in range(4)])


def cut_latin(texts: list[bytes]) -> list[list[bytes]]:
    """The pieces of Latin-1 texts in lower case, by PATTERN."""
    data = np.frombuffer(b" ".join([*texts, b"   "]).translate(_LOWERED), np.uint8)  # blanks at the end: room for 'll
    kind = _KIND[data]
    edge = np.zeros(len(data), bool)
    edge[1:] = _EDGE[kind[:-1] * np.uint8(4) + kind[1:]]
    at = np.flatnonzero(data == ord("'"))
    at = at[(at == 0) | (kind[at - 1] != _OTHER)]  # within a run of others, none begins
    a, b = data[at + 1], data[at + 2]
    size = np.isin(a, list(b"stmd")) + 2 * ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l")))
    at, size = at[size > 0], size[size > 0]
    edge[at + 1] = False
    edge[at + 1 + size] = kind[at + 1 + size] != _SPACE
    edges = np.flatnonzero(edge)
    parted = np.insert(data, edges, ord(" ")).tobytes()
    cuts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = (cuts + np.searchsorted(edges, cuts)).tolist()
    return [parted[i:j].split() for i, j in pairwise(cuts)]


def _byte_level() -> str:
    """What a ByteLevel pre-tokenizer writes for each byte, but for blanks, which stay."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {c: chr(256 + n) for n, c in enumerate(c for c in range(256) if c not in plain)} | {0x20: " "}
    return "".join(others.get(c, chr(c)) for c in range(256))


_BYTE_LEVEL = _byte_level()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Bpe:
    """A tokenizers file: encode, decode, and the parts that a join needs."""

    def __init__(self, path: str):
        spec, self.path = self._spec(path), path
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.latin = self._latin(spec)
        self.pieces: dict[bytes, bytes] = {}  # Latin-1 in lower case -> its ids
        self.held = 0  # bytes of pieces, about
        size = max([*spec["model"]["vocab"].values(), *self.specials.values()]) + 1
        self.strings = [""] * size
        for s, i in [*spec["model"]["vocab"].items(), *self.specials.items()]:
            self.strings[i] = s
        self.plain = spec["decoder"] is None
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.array([bool(suffix) and s.endswith(suffix) for s in self.strings])
        self.remembered = REMEMBERED

    @staticmethod
    def _spec(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            return json.load(f) | {"truncation": None, "padding": None}

    @cached_property
    def whole(self):
        """The tokenizer as it is in the file."""
        return Tokenizer.from_str(json.dumps(self._spec(self.path)))

    @cached_property
    def part(self):
        """For text that is already normalised and has no special tokens."""
        return Tokenizer.from_str(json.dumps(self._spec(self.path) | {"normalizer": None, "added_tokens": [], "post_processor": None}))

    @cached_property
    def inner(self):
        """Like part, for what ends inside a word."""
        spec = self._spec(self.path) | {"normalizer": None, "added_tokens": [], "post_processor": None}
        spec["model"]["end_of_word_suffix"] = None
        return Tokenizer.from_str(json.dumps(spec))

    @cached_property
    def words(self):
        """For pieces parted by blanks, their bytes written as the pre-tokenizer does."""
        spec = self._spec(self.path) | {"normalizer": None, "added_tokens": [], "post_processor": None}
        return Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))

    @cached_property
    def normalizer(self):
        return self.whole.normalizer

    @staticmethod
    def of(path: str) -> Bpe:
        if path not in _LOADED:
            _LOADED[path] = Bpe(path)
        return _LOADED[path]

    @staticmethod
    def _latin(spec: dict) -> bool:
        """Whether this file is of the shape whose steps are simple for Latin-1 texts: NFC (no effect), white space to a
        blank (never in a piece), lower case; pieces by PATTERN; bytes."""
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            return False
        if pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[1]["add_prefix_space"] or pre[1]["use_regex"]:
            return False
        return pre[0]["pattern"].get("Regex") == PATTERN

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, little-endian unsigned 32-bit."""
        out: list = [None] * len(texts)
        group, size = {}, 0
        for n, text in enumerate(texts):
            data = self.simple(text)
            if data is None:
                out[n] = _packed(self.whole.encode(text, add_special_tokens=False).ids)
                continue
            group[n] = data
            size += len(data)
            if size >= TOGETHER:
                self._remembered(group, out)
                group, size = {}, 0
        self._remembered(group, out)
        return out

    def simple(self, text: str) -> bytes | None:
        """The text in Latin-1 if its pieces can be cut and encoded each for itself, else None."""
        if not self.latin or self.split and self.split.search(text):
            return None
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def encode_part(self, text: str) -> bytes:
        """Ids of a text that is normalised and free of special tokens."""
        try:
            data = text.encode("latin-1") if self.latin else None
        except UnicodeEncodeError:
            data = None
        if data is None:
            return _packed(self.part.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        out = [b""]
        self._remembered({0: data}, out)
        return out[0]

    def _remembered(self, group: dict[int, bytes], out: list) -> None:
        """Each piece of the Latin-1 texts is encoded once and remembered."""
        known, new, open_ = self.pieces, set(), []
        cut = cut_latin(list(group.values()))
        if self.held > self.remembered:  # keep what is in use
            kept = {p: known[p] for p in set().union(*cut) & known.keys()}
            known.clear()
            self.held = 0
            self._remember(kept)
        for n, pieces in zip(group, cut, strict=True):
            ids = list(map(known.get, pieces))
            if all(ids):  # a piece has ids, so only None is false
                out[n] = b"".join(ids)
            else:
                new.update(compress(pieces, map(not_, ids)))
                open_.append((n, pieces, ids))
        self._remember(self._encoded(list(new)))
        for n, pieces, ids in open_:
            out[n] = b"".join([i or known[p] for p, i in zip(pieces, ids, strict=True)])

    def _remember(self, new: dict[bytes, bytes]) -> None:
        self.held += sum(map(len, new)) + sum(map(len, new.values())) + ENTRY * len(new)
        self.pieces.update(new)

    def _encoded(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces: all in one call, parted after the tokens that end a word."""
        if not pieces:
            return {}
        text = b" ".join(pieces).decode("latin-1")
        text = codecs.charmap_decode(text.encode(), "strict", _BYTE_LEVEL)[0]
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(pieces):
            return {p: _packed(e.ids) for p, e in zip(pieces, self.words.encode_batch_fast(text.split(" "), add_special_tokens=False), strict=True)}
        data = ids.astype("<u4").tobytes()
        return {p: data[4 * i : 4 * j] for p, i, j in zip(pieces, [0, *ends[:-1]], ends, strict=True)}

    def decode(self, ids: bytes) -> str:
        ids = np.frombuffer(ids, "<u4").tolist()
        if self.plain:
            return " ".join(map(self.strings.__getitem__, ids))
        return self.whole.decode(ids, skip_special_tokens=False)

    # --- tree ---

    def segments(self, text: str):
        """(special id or None, normalised text): special tokens stand alone, as in the library."""
        if self.simple(text) is not None:
            yield None, text.lower()
            return
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.specials:
                yield self.specials[piece], ""
            elif piece:
                yield None, self.normalizer.normalize_str(piece) if self.normalizer else piece

    def tokens(self, text: str, inner: bool = False) -> Tokens:
        return Tokens.of((self.inner if inner else self.part).encode(text, add_special_tokens=False))

    def edges(self, a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], m: int):
        """Tokens of a's end and of b's beginning, at least m characters each, cut at blanks (which part pieces)."""
        cut = a[0].rfind(" ", 0, max(0, len(a[0]) - m))
        s = max(0, cut)
        cut = b[0].find(" ", m)
        e = cut if cut >= 0 else len(b[0])
        return self.tokens(a[0][s:]).shifted(s), self.tokens(b[0][:e]).shifted(len(a[0])), s == 0, e == len(b[0])

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], least: int = 4, around: int = 256) -> tuple[str, np.ndarray]:
        """(text, ids) of the two texts put together: windows of `least` tokens on each side of the cut, doubled until
        both sides agree; if nothing agrees, the whole of both is encoded again."""
        text, k = left[0] + right[0], least

        def letters(p: int) -> bool:  # p is between two letters, whose runs every scan keeps together
            return 0 < p < len(text) and all(x.isalpha() and x < "ɐ" for x in text[p - 1 : p + 1])

        while True:
            a, b, from_start, to_end = self.edges(left, right, around)
            na, nb = len(a.ids), len(b.ids)
            while True:
                i, j = max(0, na - k), min(nb, k)
                while i and not (a.head[i] or a.start[i] == a.end[i - 1] and letters(a.start[i])):
                    i -= 1
                while j < nb and not (b.head[j] or b.start[j] == b.end[j - 1] and letters(b.start[j])):
                    j += 1
                s = int(a.start[i]) if i else (0 if from_start else int(a.start[0]) if na else None)
                e = int(b.start[j]) if j < nb else (len(text) if to_end else int(b.end[-1]) if nb else None)
                if s is None or e is None:
                    break
                w = self.tokens(text[s:e]).shifted(s)
                last = int(np.flatnonzero(w.head)[-1]) if len(w.ids) else 0
                agree = True
                if j < nb and not b.head[j]:  # the window ends inside a word
                    run = text[w.start[last] : e] if len(w.ids) else ""
                    agree = run.isalpha() and run < "ɐ"
                    if agree:
                        w = w.cut(0, last).plus(self.tokens(run, True).shifted(int(w.start[last])))
                        agree = w.ids[-1] == b.ids[j - 1] and w.start[-1] == b.start[j - 1]
                elif j < nb or not to_end:
                    mine = int(np.flatnonzero(b.head[:j])[-1])
                    agree = bool(len(w.ids)) and w.start[last] == b.start[mine] and np.array_equal(w.ids[last:], b.ids[mine:j])
                if i and not a.head[i] and agree:
                    agree = w.ids[0] == a.ids[i] and w.end[0] == a.end[i]
                if agree:
                    return text, np.concatenate([left[1][: len(left[1]) - na + i], w.ids, right[1][j:]])
                if i == 0 and j == nb:
                    break
                k *= 2
            if from_start and to_end:
                return text, self.tokens(text).ids
            around *= 4

    def tree(self, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Neighbours joined in pairs, level by level."""
        while len(leaves) > 1:
            pairs = [leaves[n : n + 2] for n in range(0, len(leaves), 2)]
            leaves = [self.join(*p) if len(p) == 2 else p[0] for p in pairs]
        return leaves[0][1]


class Tokens:
    """Tokens with their first and last character, and whether one begins a pre-tokenizer's piece."""

    def __init__(self, *arrays):
        self.ids, self.start, self.end, self.head = arrays

    @staticmethod
    def of(e) -> Tokens:
        spans, word = np.array(e.offsets, np.int64).reshape(-1, 2), np.array([-1, *e.word_ids], np.int64)
        return Tokens(np.array(e.ids, np.uint32), spans[:, 0], spans[:, 1], word[1:] != word[:-1])

    def cut(self, i: int, j: int) -> Tokens:
        return Tokens(*(x[i:j] for x in (self.ids, self.start, self.end, self.head)))

    def shifted(self, by: int) -> Tokens:
        return Tokens(self.ids, self.start + by, self.end + by, self.head)

    def plus(self, other: Tokens) -> Tokens:
        pairs = zip((self.ids, self.start, self.end, self.head), (other.ids, other.start, other.end, other.head), strict=True)
        return Tokens(*(np.concatenate(p) for p in pairs))


def _small(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode(docs: DataFrame, path: str, leaf: int = LEAF, remembered: int = REMEMBERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers, one row per row of docs.

    Null and empty texts have no ids. Null and repeated ids are passed on: rows are encoded for themselves, whatever
    their length. Leaves of long texts are written once with a number for their row, by which they are joined.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    length = F.length("text")

    def short(batches):
        bpe = Bpe.of(path)
        bpe.remembered = remembered
        for b in _small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.encode(b.column(1).to_pylist()), pa.binary())], ["id", "ids"])

    def leaves(batches):
        bpe = Bpe.of(path)
        for b in batches:
            for row, i, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                rows = []
                for seg, (special, t) in enumerate(bpe.segments(text)):
                    for n, at in enumerate(range(0, max(1, len(t)), leaf)):
                        rows.append({"row": row, "id": i, "seg": seg, "node": n, "special": special, "text": t[at : at + leaf]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    def encoded(batches):
        bpe = Bpe.of(path)
        for b in batches:
            ids = [_packed([s]) if s is not None else bpe.encode_part(t) for s, t in zip(b.column("special").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "seg", "node", "text")), pa.array(ids, pa.binary())], ["row", "id", "seg", "node", "text", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        bpe, segs = Bpe.of(path), {}
        for r in sorted(table.select(["seg", "node", "text", "ids"]).to_pylist(), key=lambda r: (r["seg"], r["node"])):
            segs.setdefault(r["seg"], []).append((r["text"], np.frombuffer(r["ids"], "<u4")))
        return pa.table({"id": table.column("id")[:1], "ids": pa.array([b"".join(bpe.tree(x).astype("<u4").tobytes() for x in segs.values())], pa.binary())})

    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("seg", pa.int32()), ("node", pa.int32()), ("special", pa.int64()), ("text", pa.string())])
    done = own.where(length <= leaf).mapInArrow(short, "id long, ids binary")
    long_rows = own.where(length > leaf).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    parts = stash(long_rows.mapInArrow(leaves, "row long, id long, seg int, node int, special long, text string"), "leaves")
    nodes = parts.repartition("row", "seg", "node").mapInArrow(encoded, "row long, id long, seg int, node int, text string, ids binary")
    return done.unionByName(nodes.groupBy("row").applyInArrow(joined, "id long, ids binary"))


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the library's decode(ids, skip_special_tokens=False); null ids give an empty text."""

    def text(batches):
        bpe = Bpe.of(path)
        for b in _small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["id", "ids", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(text, "id long, ids binary, text string")
