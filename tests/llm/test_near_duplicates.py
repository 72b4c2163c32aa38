from __future__ import annotations

import random

from tests.llm import brute
from xrel.llm.near_duplicates import near_duplicates, one_of_each

PLAIN = lambda rows: sorted(rows, key=repr)


def got(df):
    rows = df.select("doc_id", "n_shingles", "component_id").collect()
    return PLAIN((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in rows)


def varied(seed, groups=12, copies=9):
    """Groups of copies with a few words changed, around the threshold, besides plain texts."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows, start=5))


def test_against_all_pairs(spark, table):
    rows = varied(3)
    assert got(near_duplicates(table(rows), 85)) == PLAIN(brute.near_duplicates(rows, 85))


def test_large_bucket_with_two_parts(spark, table):
    """Many near copies in one bucket, of which some are only close to each other."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(40):
        own = list(base)
        for _ in range(1 if k < 25 else 9):
            own[rng.randrange(300)] = f"y{k}-{rng.randrange(99)}"
        rows.append((k, " ".join(own)))
    assert got(near_duplicates(table(rows), 85)) == PLAIN(brute.near_duplicates(rows, 85))


def test_edges(spark, table):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c d e"), (7, "A B C D E"), (None, "a b"),
            (None, "only here and nowhere else at all"), (8, "same"), (8, "same"), (9, "other"), (9, "different words")]
    found = got(near_duplicates(table(rows), 85))
    assert found == PLAIN(brute.near_duplicates(rows, 85))
    assert near_duplicates(table([])).count() == 0


def test_one_stays(spark, table):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (4, None), (5, ""), (6, "x y")]
    kept = one_of_each(table(rows))
    assert kept.columns[:3] == ["doc_id", "text", "source"]
    assert PLAIN((r.doc_id, r.text) for r in kept.collect()) == PLAIN([(1, "A b c d e f"), (4, None), (5, ""), (6, "x y")])


def test_what_stays_apart_in_buckets(spark, table, monkeypatch):
    """Rounds and the rarest-shingle join, however few memberships are left, with counters that many shingles share."""
    from xrel.llm import buckets
    from xrel.llm import near_duplicates as N

    monkeypatch.setattr(buckets, "FEW", 0)
    monkeypatch.setattr(N, "LEAST_COUNTERS", 1 << 4)
    monkeypatch.setattr(N, "PIECE", 1 << 3)
    rng = random.Random(9)
    rows = []
    for k in range(135):
        # Three texts that share most words, and copies of each at every distance around the threshold.
        own = [f"w{i}" if i % 9 else f"w{i}-{k % 3}" for i in range(200)]
        for _ in range(rng.choice((0, 1, 3, 5, 7))):
            own[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    for percent in (80, 85):
        assert got(near_duplicates(table(rows), percent)) == PLAIN(brute.near_duplicates(rows, percent))


def test_rounds_end_with_the_rarest_shingles(spark, table, monkeypatch):
    from xrel.llm import buckets

    monkeypatch.setattr(buckets, "FEW", 0)
    monkeypatch.setattr(buckets, "ROUNDS", 0)
    rows = varied(11, groups=4, copies=12)
    assert got(near_duplicates(table(rows), 85)) == PLAIN(brute.near_duplicates(rows, 85))
