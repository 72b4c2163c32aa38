from __future__ import annotations

import random

import numpy as np

from tests.llm import brute
from xrel.llm import buckets
from xrel.llm.paragraphs import COLLIDING, MISSED, STRAY, _paragraph_sets, tuned_bands, without_repeated_paragraphs


def got(df):
    return sorted(((r.doc_id, r.n_removed, r.removed, r.kept_text) for r in df.collect()), key=repr)


def cases(seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [line(n) for n in (20, 55, 60, 120, 19)]
    rows = []
    for i in range(40):
        parts = [line(rng.choice((3, 25, 70)))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(shared).split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                own[rng.randrange(len(own))] = f"é{rng.randrange(99)}"
            parts.append(" ".join(own).title() if rng.random() < 0.3 else " ".join(own))
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(50, rows[3][1] + "\n\n" + rows[3][1]), (51, None), (52, ""), (53, "\n\n"), (54, shared[1]), (54, "a\n" + shared[1])]
    return rows + [(None, shared[2] + "\nend")]


def test_against_all_pairs(spark, table):
    rows = sorted(cases(6), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    assert got(without_repeated_paragraphs(table(rows))) == sorted(brute.repeated_paragraphs(rows), key=repr)


def test_empty(spark, table):
    assert got(without_repeated_paragraphs(table([]))) == []


def test_bands():
    bands, rows = tuned_bands(0.8)
    assert (1 - 0.8**rows) ** bands <= MISSED and 1 - (1 - STRAY**rows) ** bands <= COLLIDING


def test_what_stays_apart_in_buckets(spark, table, monkeypatch):
    """Near copies of three lines at every distance around the threshold, without rounds."""
    monkeypatch.setattr(buckets, "FEW", 0)
    monkeypatch.setattr(buckets, "ROUNDS", 0)
    rng = random.Random(4)
    rows = []
    for k in range(90):
        own = [f"w{i}" if i % 9 else f"w{i}-{k % 3}" for i in range(200)]
        for _ in range(rng.choice((0, 1, 3, 5, 7))):
            own[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((k, f"head {k}\n" + " ".join(own)))
    assert got(without_repeated_paragraphs(table(rows))) == sorted(brute.repeated_paragraphs(rows), key=repr)


def test_lines_of_a_slice():
    rng = random.Random(2)
    texts = ["", "a b c\n", "\n\nx", "é " * 30 + "\n" + " ".join("ab"[rng.randrange(2)] for _ in range(60)), "", "one two three four five six\n\n"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    row, place, begin, end, starts, grams = _paragraph_sets(data, offsets, 1)
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.encode().split(b"\n"))]
    assert [(r, p) for r, p, x in lines if x.split()] == list(zip(row.tolist(), place.tolist(), strict=True))
    for i in range(len(row)):
        own = texts[row[i]].encode()[begin[i] : end[i]].split()
        sets = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))}
        assert len(sets) == starts[i + 1] - starts[i] and (np.diff(grams[starts[i] : starts[i + 1]].astype(object)) > 0).all()
