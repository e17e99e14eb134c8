"""op2: statistics against a plain version, estimates against numpy, clean and broken documents."""

import math
import random
import re

import brute
import numpy as np
import pytest

from weir.llm import quality, quality_query
from weir.llm.quality import FLOORS, UNITS, chi2, document_statistics, quality_rules, truncation

WORDS = "the of and to in is was for on that with as by at from his it an were which are this also be had has first one their its".split()


def prose(rng, n):
    return "".join(f"{rng.choice(WORDS)}{rng.choice([' '] * 9 + [chr(10)])}" for _ in range(n))


def test_statistics(spark, frame, odd_texts):
    rng = random.Random(0)
    texts = odd_texts + ["a b c d e a b c d e", "a b c d e f a b c d e", "x\nx\n\n x\nx ", "#*$ %&|<> plain"] + [prose(rng, n) for n in (0, 5, 30, 200)]
    rows = document_statistics(frame(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.word_statistics(texts[r.id]), texts[r.id]


def features(s, n_lines):
    n, chars, symbols, dup, rep = s
    return [math.log((chars + 250) / (n + 50)), math.log((symbols + 2) / (chars + 200)), dup / (n_lines + 5), rep / (n + 50)]


FLOOR = np.diag([(u * f) ** 2 for u, f in zip(UNITS, FLOORS, strict=True)])


def covariance(x):
    return np.cov(x.T, bias=True).reshape(4, 4) if len(x) > 1 else np.zeros((4, 4))


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + FLOOR), x - mean)


def concentrated(x, mean, cov, share):
    """(mean, covariance, log determinant) when the determinant falls no more."""
    last = math.inf
    while True:
        near = np.floor(16 * np.log2(distances(x, mean, cov) + 0.01))
        keep = near <= np.sort(near)[math.ceil(share * len(x)) - 1]
        m, c = x[keep].mean(0), covariance(x[keep]) * truncation(share)
        det = np.linalg.slogdet(c + FLOOR)[1]
        if not det < last - 1e-9:
            return mean, cov, last
        mean, cov, last = m, c, det


def plain_estimate(x, share=0.75, inner=0.975):
    q = np.percentile(x, [25, 50, 75], axis=0)
    var = ((q[2] - q[0]) / 1.349) ** 2 + np.diag(FLOOR)
    z = (x - q[1]) / np.sqrt(var)
    far = (z**2).sum(1)
    out = far > 0
    signs = (z[out] / far[out, None]).T @ z[out] / max(1, out.sum()) * 4
    starts = [(q[1], np.diag(var) - FLOOR), (x.mean(0), covariance(x)), (q[1], signs * np.sqrt(np.outer(var, var)))]
    mean, cov, _ = min((concentrated(x, m, c, share) for m, c in starts), key=lambda r: r[2])
    inside = distances(x, mean, cov) <= chi2(inner)
    return x[inside].mean(0), covariance(x[inside]) * truncation(inner)


def plain_distances(texts, langs, sources, prior=60):
    """Squared distances by position: estimates of all, of languages and of sources, each drawn towards the one before."""
    stats = [brute.word_statistics(t) for t in texts]
    lines = [sum(bool(re.search(brute.SPACE, x)) for x in (t or "").split("\n")) for t in texts]
    x = np.array([features(s, n) for s, n in zip(stats, lines, strict=True)]) * UNITS
    x = np.sign(x) * np.floor(np.abs(x) + 0.5)  # halves away from zero
    failed = np.array([brute.base_failed(s) for s in stats])
    keys = [("", "", "")] * len(texts), [(g or "", "", "x") for g in langs], [(g or "", h or "", "y") for g, h in zip(langs, sources, strict=True)]
    out, levels = np.full(len(texts), np.nan), [{}, {}, {}]
    for found, key in zip(levels, keys, strict=True):
        for k in set(key):
            rows = x[[n for n, own in enumerate(key) if own == k and not failed[n]]]
            if len(rows):
                found[k] = (len(rows), *plain_estimate(rows))
    for n in range(len(texts)):
        mean = cov = None
        for found, key in zip(levels, keys, strict=True):
            if key[n] in found:
                size, m, c = found[key[n]]
                w = 1 if mean is None else size / (size + prior)
                mean, cov = (m, c) if mean is None else (w * m + (1 - w) * mean, w * c + (1 - w) * cov)
        if mean is not None:
            out[n] = distances(x[n : n + 1], mean, cov)[0]
    return out, failed


def test_distances_are_those_of_numpy(spark, frame):
    """Groups from one document to a hundred, a large group of copies, broken texts among them."""
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(30, 200)) for _ in range(120)] + ["#$% " * 50 + prose(rng, 30) for _ in range(6)] + [prose(rng, 40)] * 60
    parts = [frame(texts), frame([prose(rng, 50) for _ in range(7)] + ["w" * 900 + " a b c d e f g h i j k"], 1000, source="small"), frame([prose(rng, 60)], 2000, lang="fr"), frame([prose(rng, 60), None, "x"], 3000, lang=None, source=None)]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    want, failed = plain_distances([r.text for r in rows], [r.lang for r in rows], [r.source for r in rows])
    out = {r.id: r for r in quality_rules(document_statistics(df)).collect()}
    assert np.allclose([out[r.doc_id].distance for r in rows], want, rtol=1e-6)
    assert [out[r.doc_id].kept for r in rows] == [bool(not f and d <= chi2(0.9999)) for f, d in zip(failed, want, strict=True)]
    assert not any(out[n].kept for n in range(120, 126)) and all(out[n].kept for n in range(120)) and not out[1007].kept


def test_many_groups_are_salted(frame, monkeypatch):
    rng = random.Random(7)
    df = frame([prose(rng, rng.randrange(30, 90)) for _ in range(40)] + ["#$% " * 40 + prose(rng, 30)])
    want = sorted((r.id, r.distance) for r in quality_rules(document_statistics(df)).collect())
    monkeypatch.setattr(quality, "FEW", 0)
    assert sorted((r.id, r.distance) for r in quality_rules(document_statistics(df)).collect()) == want


def test_steps_join_by_one_number(frame, monkeypatch):
    """Estimates are broadcast by one long: by several columns each of them takes a whole page of an executor's memory."""
    plans, written = [], quality.stash

    def stash(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(quality, "stash", stash)
    rng = random.Random(9)
    quality_rules(document_statistics(frame([prose(rng, rng.randrange(30, 90)) for _ in range(40)])))
    steps = [re.findall(r"HashedRelationBroadcastMode\(List\((.*?)\),", p) for name, p in plans if name in ("classes", "inside")]
    assert len(steps) > 2 and all(s and all(re.fullmatch(r"input\[\d+, bigint, \w+\]", k) for k in s) for s in steps)


def test_several_starts_can_differ():
    """The determinants decide: of two clusters the narrower majority wins, wherever the mean lies."""
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal([1600, -600, 0, 0], [30, 30, 1, 1], (80, 4)), rng.normal([4000, -50, 500, 150], [9, 5, 9, 9], (20, 4))]))
    mean, cov = plain_estimate(x)
    assert (distances(x[80:], mean, cov) > 100).all() and (distances(x[:80], mean, cov) < 25).all()


def test_huge_texts(spark):
    """Sums of squares of very long texts stay within 64 bits."""
    rows = [(n, "en", "web", 12, 400_000_000, 3, 0, 0, 2) for n in range(30)] + [(n, "en", "web", 2_000_000_000 // (n % 7 + 5), 2_100_000_000, 2_100_000_000, n, 5, n) for n in range(30, 60)]
    df = spark.createDataFrame(rows, "id long, g0 string, g1 string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    out = quality_rules(df).collect()
    assert len(out) == 60 and all(math.isfinite(r.distance) for r in out)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_tiny_tables(frame, n):
    out = quality_rules(document_statistics(frame(["ten words are enough for a text to be kept here"] * n or ["x"]).limit(n))).collect()
    assert len(out) == n and all(r.kept for r in out)


def test_nothing_passes(spark):
    """Base rules that nothing passes leave no estimate; repeated rows and null ids are rows like others."""
    df = spark.createDataFrame([(None, "x", None, "s"), (None, "x", None, "s"), (1, None, "en", None)], "doc_id long, text string, lang string, source string").selectExpr("*", "1 as level", "2 as w", "'k' as kept")
    out = quality_rules(document_statistics(df)).collect()
    assert [(r.base_failed, r.kept, r.distance) for r in out] == [(True, False, None)] * 3


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_kept_on_the_table(spark, sf_dir, size):
    at = f"{sf_dir}/../{size}"
    docs = spark.read.parquet(f"{at}/documents.parquet").orderBy("doc_id").collect()
    want, failed = plain_distances([r.text for r in docs], [r.lang for r in docs], [r.source for r in docs])
    out = {r.doc_id: r.kept for r in quality_query.query(spark, at).collect()}
    assert [out[r.doc_id] for r in docs] == [bool(not f and d <= chi2(0.9999)) for f, d in zip(failed, want, strict=True)]


def test_query(spark, sf_dir, documents):
    rows = quality_query.query(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        s = brute.word_statistics(documents[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == brute.base_failed(s) and not (r.kept and r.base_failed)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_kept_against_labels(spark, sf_dir, size):
    """Outliers go and clean documents stay, in languages and sources of any size."""
    at = f"{sf_dir}/../{size}"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    judged = [(labels.get(r.doc_id), r.kept) for r in quality_query.query(spark, at).where("not base_failed").collect()]
    assert [kept for q, kept in judged if q == 0].count(True) <= 0.1 * sum(q == 0 for q, _ in judged)
    assert [kept for q, kept in judged if q == 1].count(False) == 0
