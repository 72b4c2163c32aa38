from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from xrel.llm import repeated_bytes as R


def got(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in rows), key=repr)


def cases(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    shared = [piece(n) for n in (100, 101, 130, 260, 600)]
    rows = []
    for i in range(60):
        parts = [piece(rng.randrange(150)), rng.choice(shared), piece(rng.randrange(90)), rng.choice(shared)[rng.randrange(20) :]]
        rows.append((i * 3, "".join(parts[: rng.randrange(1, 5)])))
    rows += [(500, "z" * 350), (501, "z" * 99), (502, "ab" * 120), (503, rows[0][1]), (504, ""), (505, None)]
    # Repeated ids are ordered by text, rows without an id come last.
    rows += [(506, shared[4]), (506, shared[4]), (506, "0" + shared[3]), (None, shared[2] + "tail")]
    return rows


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))


def test_against_all_strings(spark, table, monkeypatch):
    rows = cases(1)
    want = sorted(brute.repeated_bytes(ordered(rows)), key=repr)
    assert got(R.removed_bytes(table(rows))) == want


def test_hot_anchors_and_segments(spark, table):
    rng = random.Random(9)
    hot = "".join(rng.choice("pqrst ") for _ in range(240))
    rows = [(i, f"{rng.random()}{hot[rng.randrange(40):]}{rng.random()}") for i in range(R.HOT + 50)]
    assert got(R.removed_bytes(table(rows))) == sorted(brute.repeated_bytes(rows), key=repr)


def test_every_anchor_frequent(spark, table, monkeypatch):
    """With HOT at 1 all strings at anchors of different runs are grouped by bytes; a full bit table lets all runs by."""
    monkeypatch.setattr(R, "HOT", 1)
    monkeypatch.setattr(R, "MOST_BITS", 1 << 15)
    rows = cases(2)
    assert got(R.removed_bytes(table(rows))) == sorted(brute.repeated_bytes(ordered(rows)), key=repr)


def test_texts_over_several_segments(spark, table):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=R.SEGMENT + 5_000))
    rows = [(1, long), (2, "x" + long[R.SEGMENT - 150 : R.SEGMENT + 150]), (3, long[-400:] + long[:300]), (4, "z" * (R.SEGMENT + 700))]
    n = R.SEGMENT
    removed = {r.doc_id: [(m.begin, m.end) for m in r.removed] for r in R.removed_bytes(table(rows)).collect()}
    assert removed == {1: [], 2: [(1, 301)], 3: [(0, 700)], 4: [(1, n + 700)]}


def test_kinds_that_go_on_over_partitions(spark):
    rng = random.Random(8)
    runs = [(7, 1, 1, i, 5, 3) for i in range(3_000)] + [(rng.randrange(9), rng.randrange(3), 2, i, i, 1) for i in range(500)]
    rng.shuffle(runs)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            leaders, copies = R.judged_runs(spark.createDataFrame(runs, "anchor long, text_a long, text_b long, id long, place long, more int"))
            first = {}
            for r in sorted(runs):
                first.setdefault(r[:3], (r[0], *r[3:]))
            assert sorted(map(tuple, leaders.collect())) == sorted(first.values())
            want = sorted(r[3:] for r in runs if (r[0], *r[3:]) != first[r[:3]])
            assert sorted(map(tuple, copies.collect())) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_bit_table(spark):
    rng = random.Random(5)
    anchors = [rng.getrandbits(48) for _ in range(5_000)]
    marked = R.bit_table(spark.createDataFrame([(a,) for a in anchors], "anchor bigint"), len(anchors))
    at = {a % (8 * len(marked)) for a in anchors}
    assert 8 * len(marked) >= R.BITS_PER_ANCHOR * 5_000
    assert set(np.flatnonzero(np.unpackbits(marked, bitorder="little")).tolist()) == at
    assert not R.bit_table(spark.createDataFrame([], "anchor bigint"), 0).any()


def test_empty(spark, table):
    assert got(R.removed_bytes(table([]))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=300), max_size=5))
def test_anchor_runs_cover_every_string_once(texts):
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    anchors, covered = {}, []
    for row, first, last, hashes in R.anchor_runs(data, offsets):
        for r, a, b, h in zip(row.tolist(), first.tolist(), last.tolist(), hashes.tolist(), strict=True):
            for s in range(a, b + 1):
                covered.append((r, s))
                assert anchors.setdefault(texts[r][s : s + 100], h) == h
    assert covered == [(r, s) for r, t in enumerate(texts) for s in range(len(t) - 99)]
