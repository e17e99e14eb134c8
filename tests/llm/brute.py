"""Plain versions of the corpus operators, for small inputs. documents: {id: text or None}."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def least_reachable(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def shingle_set(text):
    words = re.findall(SPACE, ascii_lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(documents):
    """{id: (n_shingles, component_id)}"""
    sets = {i: shingle_set(t) for i, t in documents.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = least_reachable(documents, links)
    return {i: (len(sets[i]), label[i]) for i in documents}


def repeats(documents, span=50):
    """{id: (n_bytes, n_removed, n_spans, kept)}"""
    first, out = {}, {}
    data = {i: (t or "").encode() for i, t in documents.items()}
    for i in sorted(data):
        for a in range(len(data[i]) - span + 1):
            first.setdefault(data[i][a : a + span], i)
    for i, b in data.items():
        gone = [False] * len(b)
        for a in range(len(b) - span + 1):
            if first[b[a : a + span]] < i:
                gone[a : a + span] = [True] * span
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out[i] = (len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def line_chunks(text, roll, mean):
    lines, out, now = text.split("\n"), [], []
    several = lambda chunk: sum(bool(x.strip()) for x in chunk) >= 2
    for n, line in enumerate(lines):
        now.append(line)
        window = [xxhash.xxh3_64_intdigest(x) for x in lines[max(0, n - roll + 1) : n + 1]]
        h = 0
        for x in window:
            h = (h * 0x9E3779B97F4A7C15 + x) % 2**64
        if len(window) == roll and (h >> 20) % mean == 0 and several(now):
            out.append(now)
            now = []
    if now and out and not several(now):
        now = out.pop() + now
    return ["\n".join(x) for x in [*out, now] if x]


def line_dedup(documents, roll, mean):
    """{id: text}"""
    seen, out = set(), {}
    for i in sorted(documents):
        if documents[i] is None:
            out[i] = None
            continue
        kept = []
        for c in line_chunks(documents[i], roll, mean):
            if sum(bool(x.strip()) for x in c.split("\n")) >= 2:
                if c in seen:
                    continue
                seen.add(c)
            kept.append(c)
        out[i] = "\n".join(kept)
    return out


def word_statistics(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def base_failed(s):
    return s[0] < 10 or 100 * s[4] > 20 * s[0]


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def phrases(text):
    """(n_words, n_base, first, last, labels)"""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def near_vectors(rows, least=0.93):
    """rows: (id, label, vector) -> {id: (n_links, component)}, and the links."""
    ok = [(i, lab, np.array(v, float)) for i, lab, v in rows if lab is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = [(a[0], b[0]) for n, a in enumerate(ok) for b in ok[n + 1 :] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= least]
    count = Counter(x for pair in links for x in pair)
    label = least_reachable([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], label[r[0]]) for r in rows}, {tuple(sorted(p)) for p in links}


def check_packing(rows, ids_of, window=4096):
    """rows of op10 against the laws: every id in one piece, gapless offsets, no sequence beyond the window."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for i, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(packed(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    used = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        used += at
    return used / (window * len(by_seq))


class _Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article_text(source):
    """Blocks of the article element of the tables' pages, whose articles hold headings and paragraphs only."""
    parser = _Article()
    parser.feed(source or "")
    parser.close()
    return "\n\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)


def text_density(page, inline):
    """(density, sum of the children's densities) of each node of a parsed page, subtree by subtree."""
    n = len(page.tag)
    below = [[y for y in range(n) if x in _line(page.parent, y)] for x in range(n)]
    links = {x for x in range(n) if any(page.tag[y] == "a" for y in _line(page.parent, x))}
    size = lambda nodes: sum(len(" ".join(t.split())) for node, _, t in page.runs if node in nodes)
    whole = next((x for x in range(n) if page.tag[x] == "body" and size(set(below[x]))), 0)

    def density(x):
        nodes = {y for y in below[x] if not page.gone[y] or y == x}
        c, lc = size(nodes), size(nodes & links)
        if not c or page.gone[x]:
            return 0.0
        t, lt = len(nodes) - 1, sum(page.tag[y] == "a" for y in nodes)
        ratio = size(set(below[whole]) & links) / size(set(below[whole]))
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        plain = c / (t or 1) * math.log(max(c * (t or 1) / ((lc or 1) * (lt or 1)), 1.0000001))
        return plain / math.log(max(base, 1.0000001)) if base > 1 else plain

    out = [density(x) for x in range(n)]

    def children(x):
        return [z for y in range(1, n) if page.parent[y] == x and not page.gone[y] for z in ([y] if page.tag[y] not in inline else children(y))]

    return out, [sum(out[y] for y in children(x)) for x in range(n)]


def _line(parent, x):
    while x >= 0:
        yield x
        x = parent[x]
