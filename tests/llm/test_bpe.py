"""op1: encoding and decoding against the tokenizers library."""

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weir.llm import bpe_query
from weir.llm.bpe import Bpe, decode, encode

WORDS = public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    return t


TEXTS = ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|", "don't we'll I'VE '' 's", "Äpfel ÄPFEL İstanbul ǅ", "\x1c\x1d\xa0\x85  x​y", "0123456789 1,000.50", "a" * 3000, "aB" * 900 + " " + "1" * 700 + "!" * 500, "hello " * 700, "é" * 300, "漢字かな" * 200, "🎉👩‍👩‍👧" * 100, "...---..." * 80, "퟿�"]


@pytest.mark.parametrize("leaf", [7, 64, 32_768])
@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_like_the_library(spark, frame, odd_texts, leaf, name):
    path = public_tokenizers.path(name)
    texts = TEXTS + [t and t[: 2000 if leaf < 100 else None] for t in odd_texts]
    df = frame(texts)
    whole = library(path)
    want = {n: whole.encode(t or "", add_special_tokens=False).ids for n, t in enumerate(texts)}
    rows = decode(encode(df, path, leaf=leaf), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert bytes(r.ids) == brute.packed(want[r.id]), texts[r.id]
        assert r.text == whole.decode(want[r.id], skip_special_tokens=False)


def test_repeated_and_null_ids(spark):
    """Rows are encoded for themselves: equal ids, equal rows and null ids, below and above a leaf."""
    whole, long, other = library(WORDS), "long text " * 20, "another one " * 20
    rows = [(1, long), (1, long), (1, other), (None, long), (None, other), (None, "x"), (None, None), (1, "x")]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, leaf=64).collect()
    want = [(i, brute.packed(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((str(r.id), bytes(r.ids)) for r in got) == sorted((str(i), x) for i, x in want)


def test_memory_is_bounded():
    bpe = Bpe(WORDS)
    bpe.remembered = 10_000
    whole = library(WORDS)
    for n in range(30):
        text = " ".join(f"word{n}x{k}" for k in range(40))
        assert bpe.encode([text]) == [brute.packed(whole.encode(text, add_special_tokens=False).ids)]
        assert bpe.held <= 10_000 + 2 * 40 * 250


def test_random_joins():
    rng, bpe, whole = np.random.default_rng(3), Bpe.of(WORDS), library(WORDS)
    alphabet = list("aab bcde  THE'st 01é!?-\n") + ["漢", "ing ", "tion", "'re"]
    for _ in range(150):
        text = bpe.normalizer.normalize_str("".join(rng.choice(alphabet, rng.integers(0, 60))))
        k = int(rng.integers(1, 9))
        leaves = [text[i : i + k] for i in range(0, max(1, len(text)), k)]
        nodes = [(x, np.frombuffer(bpe.encode_part(x), "<u4")) for x in leaves]
        assert bpe.tree(nodes).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_each_piece_is_encoded_once(monkeypatch):
    """The library sees a word once, whatever stands around it."""
    bpe, whole, seen = Bpe(WORDS), library(WORDS), []
    encoded = bpe._encoded
    monkeypatch.setattr(bpe, "_encoded", lambda pieces: (seen.extend(pieces), encoded(pieces))[1])
    texts = ["Oferan oferan, (oferan) oferan's", "\"OFERAN\" 7oferan77", "", "oferan's!"]
    for _ in range(2):
        assert bpe.encode(texts) == [brute.packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sorted(seen) == sorted([b"oferan", b",", b"(", b")", b"'s", b'"', b"7", b"!"])
    assert bpe.encode([]) == []


def test_latin_pieces_like_the_library():
    rng, bpe, whole = np.random.default_rng(7), Bpe(WORDS), library(WORDS)
    bits = ["'ll", "'re", "'ve", "'S", "''s", " 's", "don't", "x'", ".'t", "1'd", "é'm", "'lland", "<|", "|>", "'", "l", "e", " "]
    every = [chr(c) for c in range(256)]
    texts = ["".join(rng.choice(a, rng.integers(0, 40))) for a in (bits, every, bits + every) for _ in range(2000)]
    texts += [x for c in every for x in (c, f"a{c}b", f"{c}'s", f"'s{c}")] + ["'l", "'r", "a'", "'l l"]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids == brute.packed(whole.encode(text, add_special_tokens=False).ids), text


def test_empty_table(spark, frame):
    df = frame(["x"]).limit(0)
    assert encode(df, WORDS).count() == 0
    assert [r.text for r in decode(spark.createDataFrame([(1, None)], "id long, ids binary"), WORDS).collect()] == [""]


def test_query(spark, sf_dir, documents):
    whole = library(WORDS)
    rows = bpe_query.query(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = whole.encode(documents[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(brute.packed(ids)))
        assert r.decoded_sha256 == brute.sha(whole.decode(ids, skip_special_tokens=False).encode())
