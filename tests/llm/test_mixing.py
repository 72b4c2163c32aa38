from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm import brute
from xrel.llm import shared
from xrel.llm.mixing import WEIGHTS, mix, mixed_documents

SOURCES = ["b", "B", "é", "ä-long", None, "", "empty"]


def cases(n=400):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice((0, 3, 20, 400))))) for i in range(n)]
    source = [rng.choice(SOURCES[:3] if rng.random() < 0.8 else SOURCES[:-1]) for _ in rows]
    rows += [(n, None), (n + 1, "  \t"), (None, "a b c"), (3, rows[3][1])]
    return rows, [*source, "empty", "empty", "b", source[3]]


def targets(sizes):
    """Shares by weight, cut at three times a source's size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(spark, table):
    rows, source = cases()
    docs = table(rows, source=lambda i: source[i])
    sizes = defaultdict(int)
    for (_, text), s in zip(rows, source, strict=True):
        sizes[s] += len(brute.white_words(text))
    want = targets(sizes)
    named = docs.select("doc_id", "source", "text").collect()
    got = mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=repr)
    by_id = {r.doc_id: r for r in got}
    for r in named:
        m = by_id[r.doc_id]
        assert m.size == len(brute.white_words(r.text)) and m.source_size == sizes[r.source]
        assert abs(m.target - want[r.source]) <= 1e-9 * max(1.0, want[r.source])
        assert m.taken == m.copies * m.size <= 3 * m.size
        if sizes[r.source]:
            assert abs(m.copies - m.target / m.source_size) < 1
    copies = Counter((r.doc_id, r.text) for r in mixed_documents(docs).collect())
    for r in named:
        times = 2 if r.doc_id == 3 else 1
        assert copies[r.doc_id, r.text] == times * by_id[r.doc_id].copies
    assert mixed_documents(docs).columns == docs.columns


def test_targets_and_copies(spark, table):
    check(spark, table)


def test_more_sources_than_are_broadcast(spark, table, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)
    check(spark, table)


def test_empty(spark, table):
    assert mix(table([])).count() == 0 and mixed_documents(table([])).count() == 0
    assert [r.taken for r in mix(table([(1, None)])).select(F.col("taken")).collect()] == [0]
