"""op10: the laws of packing, the plan, and the padding."""

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm import packing_query
from weir.llm.packing import class_sizes, cut_pieces, nnls, pack, plan, recipes, size_class


def test_recipes_fill_the_window():
    for classes in (4, 16, 64):
        table = recipes(classes)
        assert (table @ np.arange(classes + 1) == classes).all() and len(np.unique(table, axis=0)) == len(table)


def test_nnls_optimality():
    rng = np.random.default_rng(0)
    a, b = rng.random((30, 12)), rng.random(12) * 10
    x = nnls(a, b, 5000)
    gradient = a @ (a.T @ x - b)
    assert (x >= 0).all() and (gradient > -1e-2).all() and abs(gradient @ x) < 1e-1


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.concatenate([[0], rng.integers(0, 1 + 10 ** rng.integers(0, 4), 32)])
    left = histogram.copy()
    for need, repeats in plan(histogram):
        assert repeats > 0 and sum(c * a for c, a in need.items()) <= 32
        for c, a in need.items():
            left[c] -= a * repeats
    assert not left.any()
    assert plan(np.zeros(33, np.int64)) == []


def test_classes(spark):
    for window, step in ((4096, 16), (64, 4), (32, 1)):
        sizes = class_sizes(window, step)
        assert sizes[0] == 0 and sizes[-1] == window
        got = spark.range(1, window + 1).select("id", size_class(F.col("id"), step)).collect()
        assert all(u == sizes[np.searchsorted(sizes, n)] and u - n < step for n, u in got)


@pytest.mark.parametrize("length", [1, 17, 33, 50, 100, 300, 700])
def test_documents_of_one_length_leave_little_padding(length):
    sizes = class_sizes(4096, 16)
    histogram = np.zeros(len(sizes), np.int64)
    histogram[np.searchsorted(sizes, length)] = 1_000_000
    windows = sum(repeats for _, repeats in plan(histogram, sizes))
    whole = -(-1_000_000 // (4096 // length))  # no plan that leaves documents whole has fewer
    assert windows <= 1.03 * whole


def test_random_documents(spark):
    rng = np.random.default_rng(1)
    ids_of = {i: rng.integers(0, 1000, int(rng.choice([1, 2, 15, 64, 65, 130, 300]))).tolist() for i in range(120)}
    df = spark.createDataFrame([(i, brute.packed(x)) for i, x in ids_of.items()], "id long, ids binary")
    rows = pack(cut_pieces(df, 64), 64, 4).withColumnRenamed("id", "doc_id").collect()
    assert brute.check_packing(rows, ids_of, 64) > 0.8
    ended = pack(cut_pieces(spark.createDataFrame([(1, b""), (2, None)], "id long, ids binary"), 64, 2), 64, 4).collect()
    assert [(r.id, r.length) for r in ended][:1] == [(1, 1)]
    assert pack(cut_pieces(df.limit(0), 64), 64, 4).count() == 0


def test_query(spark, sf_dir, documents):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.no_truncation(), whole.no_padding()
    ids_of = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in documents.items()}
    rows = packing_query.query(spark, sf_dir).collect()
    assert brute.check_packing(rows, ids_of) > 0.9
