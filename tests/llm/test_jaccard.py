"""op4: near-duplicate groups against all pairs."""

import random

import brute
import numpy as np
import pytest

from weir.llm import jaccard_query
from weir.llm.jaccard import jaccard_groups, overlaps


def copies(rng, n):
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choices(words, k=rng.choice([3, 5, 6, 9, 12, 25, 60, 300]))
        for _ in range(rng.randrange(1, 5)):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text) if rng.random() < 0.8 else " ".join(text).upper())
    return texts


def check(df, documents, **options):
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_groups(df, **options).collect()}
    want = brute.jaccard(documents)
    assert got == want


@pytest.mark.parametrize("block", [400, 3])
def test_random_copies(frame, block):
    texts = copies(random.Random(block), 40)
    check(frame(texts, 5), {5 + n: t for n, t in enumerate(texts)}, block=block)


def test_a_large_group(frame):
    """A group larger than a block, whose members differ from one another more than they may, linked in a chain."""
    rng = random.Random(1)
    text, texts = [f"a{k}" for k in range(80)], []
    for n in range(60):
        text = list(text)
        text[rng.randrange(len(text))] = f"b{n}"
        texts.append(" ".join(text))
    texts += ["same words in every one of these copies here"] * 30
    rng.shuffle(texts)
    check(frame(texts), dict(enumerate(texts)), block=8)


def test_odd_texts(frame, odd_texts):
    texts = odd_texts + ["Five words are one shingle", "five WORDS are one shingle", "five words are one Shingles", "one two three four", None]
    check(frame(texts), dict(enumerate(texts)))


def test_repeated_and_null_ids(spark):
    a, b, c = ("a b c d e f g h i j", "a b c d e f g h i j k", "other words that stand in no other text")
    rows = [(None, a), (2, a), (2, c), (2, c), (3, b), (None, None), (4, None), (5, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "3 as component_id", "4 as set")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()), key=str)
    assert got == sorted([(None, 6, None), (2, 6, 2), (2, 4, 2), (2, 4, 2), (3, 7, 2), (None, 0, None), (4, 0, 4), (5, 4, 2)], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_partial_counts_sum_up(seed):
    """Overlaps by wide fragments of the order, summed, are those of the whole sets."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, 300, np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 120), replace=False)) for _ in range(30)]
    top = [x >> np.uint64(62) for x in sets]
    whole = sum(overlaps([x[t == np.uint64(f)] for x, t in zip(sets, top, strict=True)]) for f in range(4))
    assert whole.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]


def test_empty_table(frame):
    assert jaccard_groups(frame(["x"]).limit(0)).count() == 0


def test_query(spark, sf_dir, documents):
    rows = jaccard_query.query(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard(documents)
    assert len({r.component_id for r in rows}) < len(rows) and np.isfinite(len(rows))
