"""op5: links, counts and components against all pairs."""

import brute
import numpy as np
import pytest

from weir.llm import embedding_query
from weir.llm.embeddings import APART, PER_ROOT, near_vectors, reference_points


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").selectExpr("*", "1 as id", "'x' as v", "2 as copies")


def clustered(seed, n, width=24):
    rng, rows = np.random.default_rng(seed), []
    centres = rng.normal(size=(12, width))
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=width) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i * 3 + 1, "abc"[rng.integers(3)], (v * rng.choice([1, 7.5])).tolist()))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_clusters(spark, block):
    rows = clustered(block, 300)
    want, links = brute.near_vectors(rows)
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(table(spark, rows), block=block).collect()}
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * 2 * len(links)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", None), (4, None, [1.0, 0.0]), (5, "a", [0.0, 0.0]), (6, "a", [nan, 1.0]), (7, "a", [inf, 1.0]), (8, "b", [1.0, 0.0])]
    rows += [(9, "a", [1.0, None]), (10, "a", []), (11, "a", [1.0, 0.0]), (12, "a", [1.0, 0.0, 0.0]), (13, "a", [1e300, 1e280]), (14, "a", [-1.0, 0.0])]
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(table(spark, rows)).collect()}
    alone = {i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 14)}
    assert got == alone | {i: (3, 1) for i in (1, 2, 11, 13)}
    assert near_vectors(table(spark, rows).limit(0)).count() == 0
    named = near_vectors(spark.createDataFrame([(None, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (1, "a", [2.0, 0.1]), (1, None, [1.0, 0.0])], "vec_id long, label string, embedding array<double>"))
    assert sorted(map(tuple, named.collect()), key=str) == sorted([(None, 0, None), (1, 1, 1), (1, 1, 1), (1, 0, 1)], key=str)


def test_query_recall(spark, sf_dir):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows = [(i, None if lab is None else str(lab), None if v is None else list(v)) for i, lab, v in rows]
    want, links = brute.near_vectors(rows)
    got = {r.vec_id: r for r in embedding_query.query(spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert all(r.n_links <= want[i][0] and r.kept == (r.component_id == i) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(links)


def planted(n, width, hot, seed):
    """n vectors: a part of them near copies of one, then groups of five at cosines around 0.93 to 0.99, then noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    k = int(n * hot)
    x[:k] = x[0] + 0.2 * rng.normal(size=(k, width))
    for m in range(k, k + (n - k) // 2 - 5, 5):
        x[m : m + 5] = x[m] + rng.choice([0.1, 0.15, 0.2, 0.25]) * rng.normal(size=(5, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), k


@pytest.mark.parametrize("n,width,hot,kind", [(6000, 64, 1 / 3, "double"), (20_000, 64, 0.02, "float"), (20_000, 256, 0.0, "float"), (9000, 16, 0.0, "float")])
def test_recall(spark, n, width, hot, kind):
    """Far more vectors than reference points; also a third of them near copies of one."""
    x, k = planted(n, width, hot, n + width)
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(axis=1))
    links = np.concatenate([((y[a : a + 2000] @ y.T) / (norm[a : a + 2000, None] * norm) >= 0.93).sum(1) - 1 for a in range(0, n, 2000)])
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], f"vec_id long, label string, embedding array<{kind}>")
    got = {r.id: r for r in near_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(n)])
    assert PER_ROOT * n**0.5 < 512 and (found <= links).all()
    assert found[k:].sum() >= 0.97 * links[k:].sum() > 0
    if k:
        assert found[:k].sum() >= 0.97 * links[:k].sum() > 0 and len({got[i].component_id for i in range(k)}) == 1


def test_reference_points():
    x, _ = planted(700, 8, 0.3, 1)
    want = []
    for v in x:
        if len(want) < 90 and not any(v @ w >= APART for w in want):
            want.append(v)
    assert np.array_equal(reference_points(x, 90, 64), np.array(want))
