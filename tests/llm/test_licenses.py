"""op3: phrases against a plain scan, notices whole, changed and cut."""

import brute
import pytest

from weir.llm import license_query
from weir.llm.licenses import TEMPLATES, license_scan


def scan(df, **options):
    return {r.id: r for r in license_scan(df, **options).collect()}


def test_phrases(frame, odd_texts):
    texts = odd_texts + ["the MIT License, and the mit-license", "mitlicense MIT  LICENSE mit", "GNU General Public License v3", "apache license apache license", "general public", "LİCENSE MIT LIcense", "mit licenſe", "MIT licenKe", "Apache\nLicense"]
    out = scan(frame(texts))
    assert len(out) == len(texts)
    for n, t in enumerate(texts):
        r = out[n]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.phrases(t), t


def test_notices(frame):
    mit, bsd = TEMPLATES["mit-grant"], TEMPLATES["bsd-terms"].split()
    changed = " ".join(w for n, w in enumerate(bsd) if n != 20)
    texts = ["Lorem ipsum dolor. " + mit + " And so on.", changed, " ".join(bsd[:10]), mit + "\n\n" + mit, "x " * 5000 + mit, " ".join(bsd[:20] + ["new", "words"] + bsd[20:]), "permission is hereby granted"]
    out = scan(frame(texts))
    assert out[0].labels == "mit-grant" and out[0].base_labels == "" and out[0].score == pytest.approx(1.0)
    assert out[1].labels == "bsd-terms" and 0.6 <= out[1].score < 1
    assert out[2].labels == "" and out[2].score < 0.6
    assert out[3].n_spans == 2 and out[4].labels == "mit-grant" and out[5].labels == "bsd-terms" and out[5].n_spans == 1 and out[6].labels == ""


def test_repeated_rows_and_empty_tables(frame):
    df = frame(["the mit license"])
    assert [r.n_base for r in license_scan(df.union(df)).collect()] == [1, 1]
    assert license_scan(df.limit(0)).count() == 0


def test_plan_has_no_python(frame):
    plan = license_scan(frame(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark, sf_dir, documents):
    rows = license_query.query(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.phrases(documents[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | set() and 0 <= r.score <= 1
