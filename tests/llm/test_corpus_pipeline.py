"""The pipeline's stages against plain versions, each on its own input."""

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from weir.llm.line_chunks import MEAN, ROLL
from weir.llm.quality import document_statistics, quality_rules


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def worded(text):
    return bool(text) and bool(text.strip(" \t\n\x0b\x0c\r"))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, clean = docs.columns, {}
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        before = texts(docs)
        if n == len(cp.STAGES) - 1:
            whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            whole.no_truncation(), whole.no_padding()
            assert brute.check_packing(out.collect(), {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in before.items()}) > 0.85
            break
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = texts(out)
        if name == "quality_rules":
            kept = {r.id for r in quality_rules(document_statistics(docs)).where("kept").collect()}
            assert after == {i: before[i] for i in kept} and 0 < len(after) < len(before)
        elif name == "line_dedup":
            assert after == {i: t for i, t in brute.line_dedup(before, ROLL, MEAN).items() if worded(t)}
        elif name == "ngram_jaccard":
            assert after == {i: before[i] for i, (_, c) in brute.jaccard(before).items() if c == i}
        else:
            want = {i: x[3].decode("utf-8", "ignore") for i, x in brute.repeats(before).items()}
            assert after == {i: t for i, t in want.items() if worded(t)}
        assert all(r.n_chars == len(r.text) for r in out.collect())
        docs, clean[name] = out, after
    assert sum(map(len, clean["suffix_array"].values())) > 0


def test_run_and_empty(spark, sf_dir, tmp_path):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, odd_texts):
    """Null and repeated ids, equal rows, nulls everywhere, and columns with the operators' names pass every stage."""
    prose = " ".join(f"word{n} of the text" for n in range(30))
    texts = [*odd_texts, prose, prose, prose + " more", f"{prose}\nnext line\nlast line of it", None]
    rows = [(n, t, "en", "web", 0) for n, t in enumerate(texts)] + [(None, prose, None, None, None), (None, prose, None, None, None), (12, prose, "en", "web", 1), (3, None, None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as id", "'k' as kept", "2 as g", "3 as _kept", "4 as lines_removed", "5 as c0", "6 as row", "7 as data", "8 as set")
    for name, stage in cp.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, None)
            got = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert bool(got) == (df is docs), name
        if name in ("quality_rules", "ngram_jaccard", "suffix_array"):
            assert sum(r.doc_id is None for r in stage(spark, docs, None).collect()) == 2, name
        if name != "packing":
            assert {(r.id, r.kept, r.g, r._kept, r.lines_removed, r.c0, r.row, r.data, r.set) for r in stage(spark, docs, None).collect()} == {(1, "k", 2, 3, 4, 5, 6, 7, 8)}
