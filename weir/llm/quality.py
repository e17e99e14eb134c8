"""Quality rules: word statistics, and robust multivariate outliers by minimum-covariance-determinant estimates.

Statistics are transformed, scaled to whole numbers, and summed as integers, so that estimates do not depend on the
order of rows. Documents with equal vectors are counted together first. An estimate is found from several starts by
concentration steps: distances under the last estimate are counted in fine classes, the classes that hold the nearest
three quarters of the documents give the next mean and covariance, until no determinant falls any more; the start with
the least determinant wins and is reweighted. One step is one aggregation with a row per estimate and distance class; no
group meets in one task. There are estimates for each language and source, each language, and all documents; those of
small groups are drawn towards the next wider one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import stash

SYMBOLS = b"#*$%&|<>"
FEATURES = ("f1", "f2", "f3", "f4")
#: Whole units of each feature. Squares summed over 10^12 documents stay below 2^63.
UNITS = (1000, 100, 1000, 1000)
#: Standard deviations added to each feature's spread, which keeps covariances regular: most texts repeat nothing at all.
FLOORS = (0.03, 0.15, 0.05, 0.03)
PAIRS = [(a, b) for a in range(len(FEATURES)) for b in range(a, len(FEATURES))]
GROUP = ("level", "g0", "g1")
#: A group's number: one long to group and join by. It is meant to keep broadcast tables small; its effect on an executor's
#: peak is not shown (see README).
KEY = ("key",)
#: Estimates that are broadcast at most (a few MB), and tasks that share a group beyond that.
FEW, SALTS = 10_000, 32
#: Documents' worth of the wider estimate that go into a narrower one.
PRIOR = 60


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words that lie in a k-word window found twice or more in the text, the first included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key, size = ids[:n], len(seen)
    for j in range(1, k):
        if size * len(seen) >= 2**62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * len(seen) + ids[j : j + n], size * len(seen)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    again = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + k, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines); null has none of anything."""
    data = (text or "").encode()
    words = data.split()
    chars = len(text or "") - sum(data.count(c) for c in b" \t\n\x0b\x0c\r")
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, sum(data.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, g0, g1, ..., and STATS as longs), one row per row of docs."""
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"g{n}") for n, c in enumerate(group_cols)]
    own = docs.select(F.col(id_col).alias("id"), *groups, F.col(text_col).cast("string").alias("text"))
    keep = own.drop("text").schema

    def f(batches):
        for b in batches:
            rows = np.array([statistics(t) for t in b.column(b.num_columns - 1).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(rows[:, j]) for j in range(len(STATS)))], names)

    names = [*keep.names, *STATS]
    schema = keep
    for s in STATS:
        schema = schema.add(s, "long")
    return own.mapInArrow(f, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _features() -> list[Column]:
    """Log word length (drawn to that of 50 words of 5), log share of symbols, shares of repeated lines and words."""
    f1 = F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50))
    f2 = F.log((F.col("n_symbols") + 2) / (F.col("word_chars") + 200))
    f3 = F.col("n_dup_lines") / (F.col("n_lines") + 5)
    f4 = F.col("n_repeat_words") / (F.col("n_words") + 50)
    return [F.round(x * unit).cast("long").alias(n) for n, x, unit in zip(FEATURES, (f1, f2, f3, f4), UNITS, strict=True)]


def _below(x: float) -> float:
    """Share of the chi-square law with four degrees of freedom below x."""
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def chi2(q: float) -> float:
    """Quantile of the chi-square law with four degrees of freedom."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if _below(x) < q else (lo, x)
    return lo


def truncation(share: float) -> float:
    """By how much the covariance of a normal sample's nearest share is too small."""
    x = chi2(share)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _floor() -> np.ndarray:
    return np.diag([(unit * x) ** 2 for unit, x in zip(UNITS, FLOORS, strict=True)])


def _matrix(values) -> np.ndarray:
    out = np.zeros((len(FEATURES),) * 2)
    for (a, b), x in zip(PAIRS, values, strict=True):
        out[a, b] = out[b, a] = x
    return out


def _flat(m: np.ndarray) -> list[float]:
    return [float(m[a, b]) for a, b in PAIRS]


_MEAN, _INVERSE = [f"m{a}" for a in range(len(FEATURES))], [f"i{a}{b}" for a, b in PAIRS]
_SUMS = ["n", *(f"s{a}" for a in range(len(FEATURES))), *(f"p{a}{b}" for a, b in PAIRS)]
_ESTIMATE = "key long, start int, n long, " + ", ".join(f"{x} double" for x in _MEAN + _INVERSE) + ", cov array<double>, det double"
_NAMES = [*KEY, "start", "n", *_MEAN, *_INVERSE, "cov", "det"]


def _estimate(key: list, n: int, mean: np.ndarray, cov: np.ndarray, det: float | None = None) -> list:
    """A row of _ESTIMATE: distances use the covariance with the floors, and so does the determinant (its logarithm)."""
    whole = cov + _floor()
    return [*key, int(n), *mean.tolist(), *_flat(np.linalg.inv(whole)), _flat(cov), float(np.linalg.slogdet(whole)[1]) if det is None else det]


def _met(cells: DataFrame, estimates: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """cells with their group's estimates (a written table). Few of them are broadcast; many are dealt out once a salt, so
    that a large group is joined and summed in many tasks either way."""
    if estimates.count() <= FEW:
        return cells.join(F.broadcast(estimates), list(by))
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return cells.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS).cast("bigint"))).join(salted, [*by, "salt"]).drop("salt")


def _from_sums(sums: DataFrame, factor: float) -> DataFrame:
    """Sums by KEY and start -> the estimates they give."""

    def f(frames):
        for d in frames:
            rows = []
            for r in d.itertuples(index=False):
                mean = np.array([getattr(r, f"s{a}") / r.n for a in range(len(FEATURES))])
                cov = _matrix([getattr(r, f"p{a}{b}") / r.n - mean[a] * mean[b] for a, b in PAIRS])
                rows.append(_estimate([r.key, r.start], r.n, mean, cov * factor))
            yield pd.DataFrame(rows, columns=_NAMES)

    return sums.select(*KEY, "start", *_SUMS).mapInPandas(f, _ESTIMATE)


def _starts(cells: DataFrame) -> DataFrame:
    """Three estimates to start from, by KEY: medians with the spreads of the middle halves; mean and covariance; medians
    with the covariance of the directions from them."""
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    middle = cells.groupBy(*KEY).agg(*[F.percentile(f, quarters, F.col("w")).alias(f"q{a}") for a, f in enumerate(FEATURES)])
    floors = np.diag(_floor())
    middle = middle.select(*KEY, *[F.col(f"q{a}")[1].alias(f"med{a}") for a in range(4)], *[(F.pow((F.col(f"q{a}")[2] - F.col(f"q{a}")[0]) / 1.349, F.lit(2)) + floors[a]).alias(f"var{a}") for a in range(4)])
    middle = stash(middle, "middle")
    z = [(F.col(f) - F.col(f"med{a}")) / F.sqrt(f"var{a}") for a, f in enumerate(FEATURES)]
    far = sum((x * x for x in z[1:]), z[0] * z[0])
    turn = [F.sum(F.when(far > 0, F.round(z[a] * z[b] / far * 1_000_000).cast("long") * F.col("w"))).alias(f"d{a}{b}") for a, b in PAIRS]
    sums = _met(cells, middle).groupBy(*KEY, *[x for a in range(4) for x in (f"med{a}", f"var{a}")])
    sums = sums.agg(*_moments(), F.coalesce(F.sum(F.when(far > 0, F.col("w"))), F.lit(0)).alias("away"), *turn)

    def f(frames):
        for d in frames:
            rows = []
            for r in d.itertuples(index=False):
                med, var = (np.array([getattr(r, f"{k}{a}") for a in range(len(FEATURES))], float) for k in ("med", "var"))
                mean = np.array([getattr(r, f"s{a}") / r.n for a in range(len(FEATURES))])
                cov = _matrix([getattr(r, f"p{a}{b}") / r.n - mean[a] * mean[b] for a, b in PAIRS])
                signs = _matrix([getattr(r, f"d{a}{b}") / 1e6 / r.away * len(FEATURES) if r.away else 0.0 for a, b in PAIRS])
                for start, (m, c) in enumerate([(med, np.diag(var - floors)), (mean, cov), (med, signs * np.sqrt(np.outer(var, var)))]):
                    rows.append(_estimate([r.key, start], r.n, m, c, math.inf))
            yield pd.DataFrame(rows, columns=_NAMES)

    return sums.mapInPandas(f, _ESTIMATE)


def _distance() -> Column:
    d = F.lit(0.0)
    for a, b in PAIRS:
        d = d + F.col(f"i{a}{b}") * (F.col(FEATURES[a]) - F.col(f"m{a}")) * (F.col(FEATURES[b]) - F.col(f"m{b}")) * (1 if a == b else 2)
    return d


def _terms() -> dict[str, Column]:
    """What _SUMS are the sums of."""
    w = F.col("w")
    out = {"n": w, **{f"s{a}": w * F.col(f) for a, f in enumerate(FEATURES)}}
    return out | {f"p{a}{b}": w * F.col(FEATURES[a]) * F.col(FEATURES[b]) for a, b in PAIRS}


def _moments(where: Column | None = None) -> list[Column]:
    return [F.sum(x if where is None else F.when(where, x)).alias(n) for n, x in _terms().items()]


def _concentrated(cells: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """The estimates that the nearest share of the documents under these give."""
    by = [*KEY, "start"]
    near = _met(cells, estimates.select(*by, *_MEAN, *_INVERSE)).withColumn("near", F.floor(16 * F.log2(_distance() + 0.01)).cast("int"))
    sums = stash(near.groupBy(*by, "near").agg(*_moments()), "classes")
    upto = Window.partitionBy(*by).orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    half = sums.where(F.col("before") < F.ceil(share * F.col("total"))).groupBy(*by)
    return _from_sums(half.agg(*[F.sum(x).alias(x) for x in _SUMS]), truncation(share))


def _run() -> Column:
    """One number for a group and a start."""
    return F.col("key") * 4 + F.col("start")


def determinant_estimates(cells: DataFrame, share: float, inner: float) -> DataFrame:
    """cells (KEY, FEATURES, w documents) -> a reweighted estimate for each KEY: (KEY, n, mean, cov), n documents in all."""
    best = stash(_starts(cells).withColumn("moves", F.lit(True)), "estimates")
    while best.where("moves").limit(1).count():
        # a start goes on as long as its determinant falls, which ends, as there are finitely many choices
        new = _concentrated(cells, best.where("moves"), share).select(_run().alias("run"), *[F.col(c).alias(f"new_{c}") for c in _NAMES[len(KEY) + 1 :]])
        both = best.join(new, _run() == F.col("run"), "left").withColumn("falls", F.coalesce(F.col("new_det") < F.col("det") - 1e-9, F.lit(False)))
        best = stash(both.select(*KEY, "start", *[F.when(F.col("falls"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in _NAMES[len(KEY) + 1 :]], F.col("falls").alias("moves")), "estimates")
    first = Window.partitionBy(*KEY).orderBy("det", "start")
    best = stash(best.withColumn("place", F.row_number().over(first)).where("place = 1").select(*_NAMES), "estimates")
    inside = _met(cells, best.select(*KEY, "start", *_MEAN, *_INVERSE)).withColumn("inside", _distance() <= chi2(inner))
    total = F.sum("w").alias("documents")
    sums = inside.groupBy(*KEY, "start").agg(total, *_moments(F.col("inside")))
    own = stash(sums.where("n > 0"), "inside")
    again = _from_sums(own, truncation(inner)).join(own.select(*KEY, "documents"), list(KEY))
    return again.select(*KEY, F.col("documents").alias("n"), F.array(*_MEAN).alias("mean"), "cov")


def _drawn(groups: DataFrame, prior: int) -> DataFrame:
    """(g0, g1, mean, inverse): each group's estimate, drawn towards its language's, which is drawn towards that of all."""
    names = ["g0", "g1", *_MEAN, *_INVERSE]

    def f(frames):
        for d in frames:
            rows = []
            for r in d.itertuples(index=False):
                mean = cov = None
                for level in range(3):
                    n, m, c = (getattr(r, f"{k}{level}") for k in ("n", "mean", "cov"))
                    if m is None:
                        continue
                    m, c = np.array(m), _matrix(c)
                    part = 1.0 if mean is None else n / (n + prior)
                    mean, cov = (m, c) if mean is None else (part * m + (1 - part) * mean, part * c + (1 - part) * cov)
                rows.append([r.g0, r.g1, *([None] * (len(names) - 2) if mean is None else [*mean.tolist(), *_flat(np.linalg.inv(cov + _floor()))])])
            yield pd.DataFrame(rows, columns=names)

    return groups.mapInPandas(f, "g0 string, g1 string, " + ", ".join(f"{n} double" for n in names[2:]))


def quality_rules(stats: DataFrame, share: float = 0.75, inner: float = 0.975, tail: float = 0.9999, prior: int = PRIOR) -> DataFrame:
    """stats (of document_statistics) with base_failed, distance and kept.

    A document is kept if the base rules pass and its squared Mahalanobis distance from its group's estimate is at
    most the chi-square law's quantile at `tail`: of normal clean documents one in ten thousand would go. Groups are
    language and source; documents that fail the base rules have no part in the estimates. Each estimate starts from
    the nearest `share`, is reweighted by those within the quantile at `inner`, and is mixed with the next wider one
    (language, then all documents) as if `prior` more documents came from there, so a group of any size has one. Null
    groups count as ''. Repeated rows and null ids count each; where no document passes the base rules, distances are
    null; an empty table gives no rows.
    """
    rows = stash(stats.withColumn("base_failed", base_failed()).select("*", *_features()), "stats")
    none = F.lit("")
    levels = F.array(*[F.struct(F.lit(n).alias("level"), a.alias("g0"), b.alias("g1")) for n, (a, b) in enumerate([(none, none), (F.col("g0"), none), (F.col("g0"), F.col("g1"))])])
    good = rows.where("not base_failed")
    keys = good.select("g0", "g1").distinct().select(F.inline(levels)).distinct()
    keys = stash(keys.select(F.monotonically_increasing_id().alias("key"), *GROUP), "keys")
    cells = good.groupBy("g0", "g1", *FEATURES).agg(F.count(F.lit(1)).alias("w"))
    cells = cells.select(F.inline(levels), *FEATURES, "w").groupBy(*GROUP, *FEATURES).agg(F.sum("w").alias("w"))
    cells = stash(_met(cells, keys, GROUP).select(*KEY, *FEATURES, "w"), "cells")
    found = stash(determinant_estimates(cells, share, inner).join(keys, list(KEY)), "found")

    groups = rows.select("g0", "g1", F.substring("g0", 1, 0).alias("all")).distinct()  # '' as in the estimate of all
    for level, own in enumerate((["all"], ["g0"], ["g0", "g1"])):
        here = found.withColumn("all", F.col("g0")).where(F.col("level") == level).select(*own, *[F.col(c).alias(f"{c}{level}") for c in ("n", "mean", "cov")])
        groups = groups.join(here, own, "left")
    judged = rows.join(stash(_drawn(groups, prior), "drawn"), ["g0", "g1"], "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2(tail), F.lit(True))
    return judged.select(*stats.columns, "base_failed", "distance", kept.alias("kept"))
