"""op7: repeated chunks of lines against a plain version."""

import random

import brute

from weir.llm import line_query
from weir.llm.line_chunks import MEAN, ROLL, chunks, dedup_lines


def test_chunks_hold_all_lines():
    rng = random.Random(0)
    for _ in range(100):
        text = "\n".join(rng.choice(["a", "b", "", " ", "c"]) for _ in range(rng.randrange(1, 30)))
        assert "\n".join("\n".join(c) for c in chunks(text)) == text


def test_boundaries_resist_shifts():
    lines = [f"line {n}" for n in range(200)]
    a, b = ({tuple(c) for c in chunks("\n".join(x))} for x in (lines, ["new", *lines]))
    assert len(a - b) <= 2


def test_random_lines(frame):
    rng = random.Random(4)
    passages = [[f"p{k} line {n}" for n in range(rng.randrange(2, 12))] for k in range(8)]
    texts = []
    for n in range(50):
        lines = []
        for _ in range(rng.randrange(4)):
            lines += rng.choice(passages) if rng.random() < 0.6 else [f"own {n} {rng.random()}", ""]
        texts.append("\n".join(lines))
    df = frame(texts)
    got = dedup_lines(df)
    assert got.columns == [*df.columns, "lines_removed"]
    want = brute.line_dedup(dict(enumerate(texts)), ROLL, MEAN)
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in rows.items()} == want
    for i, r in rows.items():
        assert r.lines_removed == sum(len(c.split("\n")) for c in brute.line_chunks(texts[i], ROLL, MEAN)) - sum(len(c.split("\n")) for c in brute.line_chunks(want[i], ROLL, MEAN)) or r.lines_removed > 0


def test_copies_and_passages_go(frame):
    """Exact copies of several lines go as a whole; of a passage of lines at most the chunks at its edges stay."""
    rng = random.Random(9)
    line = lambda: f"line {rng.random()} of some text"
    passage = [line() for _ in range(30)]
    texts = ["\n".join(passage), "\n".join([line(), line(), "", *passage, "", line()]), "a\nb", "a\nb", "a\n\nb\n", "\n".join([line(), *passage[3:25], line(), line()])]
    texts += [texts[1], texts[5], texts[1]]
    rows = {r.doc_id: r for r in dedup_lines(frame(texts)).collect()}
    assert [rows[n].text for n in (3, 6, 7, 8)] == [""] * 4
    left = [sum(x in passage for x in rows[n].text.split("\n")) for n in (0, 1, 5)]
    assert left[0] == 30 and left[1] <= 10 and left[2] <= 12


def test_repeated_ids(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, None), (2, "x\ny"), (1, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g", "'z' as body", "true as late")
    got = sorted((str(r.doc_id), str(r.text)) for r in dedup_lines(df).collect())
    assert got == sorted([("1", "a\nb"), ("1", ""), ("None", "a\nb"), ("2", "None"), ("1", "x\ny"), ("2", "")])


def test_odd_texts(frame, odd_texts):
    texts = [*odd_texts, "a\nb\n" * 400, "a\nb\n" * 400]
    got = {r.doc_id: r.text for r in dedup_lines(frame(texts)).collect()}
    assert got == brute.line_dedup(dict(enumerate(texts)), ROLL, MEAN)
    assert dedup_lines(frame(["x"]).limit(0)).count() == 0
    assert dedup_lines(frame(["a\nb"]).selectExpr("cast(null as long) doc_id", "text")).count() == 1


def test_query(spark, sf_dir, documents):
    want = brute.line_dedup(documents, ROLL, MEAN)
    rows = line_query.query(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = want[r.doc_id]
        assert r.kept_sha256 == (None if text is None else brute.sha(text.encode()))
        assert r.n_lines == (0 if documents[r.doc_id] is None else documents[r.doc_id].count("\n") + 1)
    assert sum(r.n_removed for r in rows) > 0
