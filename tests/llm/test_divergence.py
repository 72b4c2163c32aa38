from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from xrel.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    terms = [TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for *_, t in rows]
    seen, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (lang, source, _), found in zip(rows, terms, strict=True):
        seen[lang].update(set(found))
        sources[lang].add(source)
        counts[lang, source].update(found)
        counts[lang, None].update(found)
    out = []
    for lang, mine in sources.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        p = {}
        for s in [*mine, None]:
            total = sum(counts[lang, s][t] for t in kept) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // total for t in kept}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for s in mine:
            pairs = [(o, sum(f(s, o, t) for t in kept)) for o in mine if o != s]
            best = [(t, f(s, None, t)) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", best)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def compared(spark, rows, least=2, top=3, **more):
    docs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], "doc_id int, lang string, source string, text string, term string, n string")
    got = D.source_divergences(docs.repartition(3), least, top, **more)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, top)


def some_rows(n, seed=1):
    rnd = random.Random(seed)
    words = ["the", "The", "ÄÖ", "äö", "x1y", "don't", "é", "日本", "á", "z-Z", "word", "Word", "ſ"]
    langs, sources = ["en", "de", None, ""], ["a", "b", "c", None, "ü", "Z"]
    return [(rnd.choice(langs), rnd.choice(sources), " ".join(rnd.choices(words, k=rnd.randint(0, 9)))) for _ in range(n)]


def test_against_plain_version(spark):
    compared(spark, some_rows(120))


def test_edges(spark):
    compared(spark, [])
    compared(spark, [("en", "a", None), ("en", "b", "1 2 3"), (None, None, None)])
    compared(spark, [("en", "a", "one one"), ("en", "a", "one two")])
    compared(spark, [("en", "a", "tie b a"), ("en", "b", "tie c d"), ("en", "a", "b a"), ("en", "b", "c d"), ("en", "none", "")])


@pytest.mark.parametrize("held, cells", [(4, 1), (10, 7)])
def test_small_blocks(spark, held, cells, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", held)
    monkeypatch.setattr(D, "BLOCK_CELLS", cells)
    rows = some_rows(60, 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in rows], pa.string()) for i in range(3)], names=["lang", "source", "text"])
    got = Counter()
    for part in D._partial_counts(iter([batch.slice(0, 25), batch.slice(25)])):
        for lang, source, term, n, docs in zip(*part.to_pydict().values(), strict=True):
            got[lang, source, term, "n"] += n
            got[lang, source, term, "docs"] += docs
    want = Counter()
    for lang, source, text in rows:
        found = Counter(TERM.findall("".join(c.lower() if c.isascii() else c for c in text)))
        for term, n in found.items():
            want[lang or "", source or "", term, "n"] += n
            want[lang or "", source or "", term, "docs"] += 1
    assert +got == want
    compared(spark, rows, shards=2)


def test_long_texts(spark):
    long = "lorem ipsum Dolor " * 150_000 + "é" * 3_000_000
    compared(spark, [("en", "a", long), ("en", "b", "lorem ipsum"), ("en", "b", "dolor " + "é" * 3_000_000)])


def test_shares_beyond_64_bits():
    count, total = np.array([[1 << 40, 5]]), np.array([(1 << 41) + 7, 1 << 41])
    assert D.shares(count, total).tolist() == [[1 + 10**9 * ((1 << 40) + 2) // ((1 << 41) + 7), 1 + 10**9 * 7 // (1 << 41)]]
