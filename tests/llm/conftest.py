import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table, with columns whose names the operators use inside."""

    def make(texts, start=0, lang="en", source="web"):
        rows = [(start + n, t, lang, source, None if t is None else len(t), "x", n) for n, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, g int")

    return make


ODD = [None, "", " ", "\n\n", "word", "one two three four", "a\tb\x0bc\x0cd\re f", "é ü ß 漢字 🎉 é", "x" * 70_000, "tie tie tie tie tie tie tie tie tie tie", "tie tie tie tie tie tie tie tie tie tie"]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD
