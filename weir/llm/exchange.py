"""Which of a group's hashes other groups have too, and how often: sent as 32-bit keys, answered with a bit or a byte each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _parts(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending hashes dealt over the parts: the order, and each part's end in it."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def among(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def shared_bits(grouped, hashes: Callable[[pa.Table], np.ndarray], parts: int, by: str = "g") -> DataFrame:
    """(g, p, bits) for documents grouped by the column `by`: hashes(table) gives a group's distinct ascending 64-bit hashes. A part's
    size is bounded by the number of groups times their keys in it; a hash that many documents have is sent once a group."""

    def ask(table: pa.Table) -> pa.Table:
        g, own = table.column(by)[0].as_py(), hashes(table)
        order, cut = _parts(own, parts)
        keys = (own[order] >> np.uint64(32)).astype(np.uint32)
        used = np.flatnonzero(np.diff(cut)).tolist()
        return pa.table({"p": pa.array(used, pa.int32()), "g": pa.array([g] * len(used), pa.int32()), "keys": pa.array([keys[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        every = np.sort(np.concatenate(keys))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        bits = [np.packbits(among(k, twice)).tobytes() for k in keys]
        return pa.table({"g": table.column("g"), "p": table.column("p"), "bits": pa.array(bits, pa.binary())})

    return grouped.applyInArrow(ask, "p int, g int, keys binary").groupBy("p").applyInArrow(answer, "g int, p int, bits binary")


def shared(hashes: np.ndarray, bits: pa.Table, parts: int) -> np.ndarray:
    """Whether other groups have the (distinct ascending) hashes, from a group's answers; equal keys of different hashes
    may say so too."""
    order, cut = _parts(hashes, parts)
    out = np.zeros(len(hashes), bool)
    for p, b in zip(bits.column("p").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        at = order[cut[p] : cut[p + 1]]
        out[at] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(at)).astype(bool)
    return out


def frequencies(grouped, hashes: Callable[[pa.Table], np.ndarray], parts: int, by: str = "g") -> DataFrame:
    """(g, p, counts) for documents grouped by the column `by`: hashes(table) gives a group's 64-bit hashes, in an order
    that is the same each time; counts say how often all groups together have each one's key, 255 for that and more."""

    def ask(table: pa.Table) -> pa.Table:
        g, own = table.column(by)[0].as_py(), hashes(table)
        order, cut = _parts(own, parts)
        keys = (own[order] >> np.uint64(32)).astype(np.uint32)
        used = np.flatnonzero(np.diff(cut)).tolist()
        return pa.table({"p": pa.array(used, pa.int32()), "g": pa.array([g] * len(used), pa.int32()), "keys": pa.array([keys[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        _, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        counts = np.minimum(times, 255).astype(np.uint8)[place]
        cut = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"g": table.column("g"), "p": table.column("p"), "counts": pa.array([c.tobytes() for c in np.split(counts, cut)], pa.binary())})

    return grouped.applyInArrow(ask, "p int, g int, keys binary").groupBy("p").applyInArrow(answer, "g int, p int, counts binary")


def frequency(hashes: np.ndarray, answers: pa.Table, parts: int) -> np.ndarray:
    """The counts of a group's hashes, in their order, from its answers."""
    order, cut = _parts(hashes, parts)
    out = np.zeros(len(hashes), np.uint8)
    for p, c in zip(answers.column("p").to_pylist(), answers.column("counts").to_pylist(), strict=True):
        out[order[cut[p] : cut[p + 1]]] = np.frombuffer(c, np.uint8)
    return out
