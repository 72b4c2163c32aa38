from __future__ import annotations

import hashlib
import random
import re

import duckdb

from tests.llm import brute
from xrel.llm.passages import SIZE, without_repeated_passages
from xrel.llm.queries import op5_repeated_paragraphs

SF = "/root/testdata/sf0.001"


def expected(docs, size=SIZE):
    """docs: (doc_id, text) in order -> (doc_id, spans of bytes, text without them)."""
    first, out = {}, []
    for d, (doc_id, text) in enumerate(docs):
        data = (text or "").encode()
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))
        own = [m.group().lower() for m in found]
        gone = set()
        for k in range(len(own) - size + 1):
            at = first.setdefault(tuple(own[k : k + size]), (d, k))
            if at != (d, k) and (at[0] != d or k - at[1] >= size):
                gone.update(range(k, k + size))
        spans = []
        for k in sorted(gone):
            if k - 1 in gone:
                spans[-1][1] = found[k].end()
            else:
                spans.append([found[k].start(), found[k].end()])
        kept = bytearray(data)
        for a, b in reversed(spans):
            del kept[a:b]
        out.append((doc_id, [tuple(s) for s in spans], None if text is None else kept.decode()))
    return out


def got(df):
    return sorted(((r.doc_id, [tuple(s) for s in r.passages], r.text) for r in df.collect()), key=repr)


def cases(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines = lambda own, n: "\n".join(" ".join(own[k : k + n]) for k in range(0, len(own), n))
    p, q, r, short = words(127), words(60), words(50), words(49)
    one = lambda own: " ".join(own)
    return [
        (1, one(words(30) + p + words(700))), (2, one(words(11) + p + words(5))),  # within longer lines
        (3, lines(words(7) + q, 13)), (4, lines(words(12) + q + words(9), 9)), (5, one(q).upper()),  # over short lines
        (6, "é \t " + lines(r, 10) + "\nend"), (7, one(["x"] + r + ["y"])), (8, one(r[1:])),  # the least size, and one word less
        (9, one(short + words(3))), (10, one(short)), (11, one(["a", "b"] * 200)), (12, one(["b", "a"] * 40)),
        (13, None), (14, ""), (15, one(p[20:100] + ["cut"] + p[100:])), (16, one(p) + "\n\n" + one(p)), (17, one(q)), (17, one(["z"] + q)), (None, one(q + p)),
    ]


def test_against_all_windows(spark, table):
    rows = sorted(cases(3), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    want = expected(rows)
    found = without_repeated_passages(table(rows))
    assert got(found) == sorted(want, key=repr)
    assert found.columns == ["doc_id", "source", "lang", "size", "n_words", "id", "n", "key", "passages", "text"]
    by_id = {d: s for d, s, _ in want}
    assert all(by_id[d] for d in (2, 4, 5, 7, 16, None)) and not any(by_id[d] for d in (1, 3, 6, 8, 10))


def test_hot_passage(spark, table):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p = words(80)
    rows = [(i, f"{words(3)} {p} {words(2)}") for i in range(2_000)]
    assert got(without_repeated_passages(table(rows))) == sorted(expected(rows), key=repr)


def test_empty(spark, table):
    assert got(without_repeated_passages(table([]))) == []


def test_query(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    lines = [(d, kept) for d, _, _, kept in brute.repeated_paragraphs(docs)]
    want = [
        (d, len(s), sum(b - a for a, b in s), ",".join(f"{a}:{b}" for a, b in s), hashlib.sha256((t or "").encode()).hexdigest())
        for d, s, t in expected(lines)
    ]
    columns = ("doc_id", "n_passages", "n_passage_bytes", "passages", "rest_sha256")
    assert sorted(tuple(r) for r in op5_repeated_paragraphs(spark, SF).select(*columns).collect()) == sorted(want)
    assert sum(r[1] for r in want) > 0


def test_periodic_texts_and_equal_runs(spark, table):
    """Runs that overlap equal ones in their own row, beside whole copies of them elsewhere."""
    rng = random.Random(5)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) for _ in range(4)]
    turns = ["a b " * 70, "x " * 130, " ".join(f"p{i % 37}" for i in range(200)), " ".join(f"q{i % 60}" for i in range(240))]
    rows = []
    for i in range(24):
        parts = [rng.choice(own), rng.choice(turns), rng.choice(own), rng.choice(turns), f"e{i}"]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts[: rng.randrange(1, 6)])))
    found = without_repeated_passages(table(rows)).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.passages], r.text) for r in found) == expected(rows)
