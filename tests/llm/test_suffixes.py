"""op6: suffix arrays and repeated byte strings against plain versions."""

import random

import brute
import numpy as np
import pytest

from weir.llm import suffix_query
from weir.llm.suffixes import owners, permuted_prefixes, remove_repeats, suffix_array


@pytest.mark.parametrize("letters", [2, 3, 20])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 10, 50, 300):
        s = np.append(rng.integers(1, letters + 1, n), 0).astype(np.uint16)
        sa = suffix_array(s, n + 1)
        want = sorted(range(n + 1), key=lambda i: s[i:].tolist())
        assert sa.tolist() == want
        prefixes = permuted_prefixes(s, sa, 20)
        for a, b in zip(want[:-1], want[1:], strict=True):
            same = 0
            while same < 20 and max(a, b) + same <= n and s[a + same] == s[b + same]:
                same += 1
            assert prefixes[b] == same


def test_owners():
    bodies = [b"abcdefgh", b"xxabcdexx", b"abcdefgh", b"ab"]
    got = owners(bodies, np.array([5, 3, 9, 1]), 4)
    first = {}
    for i, b in sorted(zip([5, 3, 9, 1], bodies, strict=True)):
        for a in range(len(b) - 3):
            first.setdefault(b[a : a + 4], i)
    assert [x.tolist() for x in got] == [[first[b[a : a + 4]] for a in range(len(b) - 3)] for b in bodies]
    assert owners([], np.zeros(0, np.int64), 4) == []


def check(df, documents):
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df).collect()}
    assert got == brute.repeats(documents)


def test_random_passages(frame):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.choice([12, 15, 30, 80]))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(10)) for _ in range(rng.randrange(5))]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    check(frame(texts, 3), {3 + n: t for n, t in enumerate(texts)})


def test_repeats_inside_documents(frame):
    """A snippet that a document holds twice goes in both places where a smaller document has it, in part or whole."""
    own, shared, other = "o" * 40 + "w" * 60, "shared bytes of both documents, " * 2 + "seventy", "n" * 100
    texts = [f"start {shared} end"] + [f"{n:03}{own}{shared}{other}\n{n:03}{own}{shared}{other}\n{n:03}" for n in range(40)]
    check(frame(texts, 7), {7 + n: t for n, t in enumerate(texts)})


@pytest.mark.parametrize("seed", range(6))
def test_repeated_lines(frame, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    lines = [" ".join(word() for _ in range(rng.choice([3, 8, 15, 40]))) for _ in range(15)]
    texts = []
    for _ in range(40):
        own = [" ".join(word() for _ in range(rng.choice([4, 12, 30]))) for _ in range(2)]
        mixed = [f"{own[0]} {rng.choice(lines)} {own[1]}"]
        texts.append("\n".join(rng.choice(mixed * 2 + own + lines) for _ in range(rng.randrange(12))))
    check(frame(texts), dict(enumerate(texts)))


def test_repeated_and_null_ids(spark):
    a, b = "A passage that is long enough to be removed when it comes again " * 2, "One more passage, which only the rows of one id hold, comes here " * 2
    rows = [(1, a), (2, a + b), (2, a + b), (2, b), (None, a), (None, a), (3, "x" + a), (3, "x" + a + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as id", "'k' as kept", "1 as n_bytes", "2 as g", "3 as data")
    got = sorted((str(r.id), r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in remove_repeats(df).collect())
    n, m = len(a), len(b)
    want = [("1", n, 0, a), ("2", n + m, n, b), ("2", n + m, n, b), ("2", m, 0, b), ("None", n, 0, a), ("None", n, 0, a), ("3", n + 1, n, "x"), ("3", n + 2, n, "xy")]
    assert got == sorted(want)
    passed = remove_repeats(df, keep=("id", "n_bytes", "g"))
    assert passed.columns == ["id", "n_bytes", "n_removed", "n_spans", "kept", "id", "n_bytes", "g"]
    assert {(r[0], r[5], r[6], r[7]) for r in passed.collect()} == {(i, i, 1, 2) for i in (1, 2, 3, None)}


def test_odd_texts(frame, odd_texts):
    texts = odd_texts + ["x" * 120, "ab" * 40, "ab" * 60, "漢" * 40, "字漢" * 20 + "漢" * 30, "x" * 49, "x" * 50]
    check(frame(texts), dict(enumerate(texts)))


def test_empty_table(frame):
    assert remove_repeats(frame(["x"]).limit(0)).count() == 0


def test_query(spark, sf_dir, documents):
    want = brute.repeats(documents)
    rows = suffix_query.query(spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, brute.sha(kept))
