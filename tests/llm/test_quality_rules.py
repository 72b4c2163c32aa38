from __future__ import annotations

import random

from tests.llm import brute
from xrel.llm import quality_rules as Q

TEXTS = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d a b c e a b c", "l m\nl m\n\n \nl m\nn",
         "#*$ %&|<> é ü\U0001f600 A!!", "one\x0btwo\x0cthree\rfour", "a b c d", "a b a b a b c c c c"]


def test_statistics(spark, table):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (30, 200, 3000)]
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "a")]
    got = Q.document_statistics(table(rows)).select("doc_id", *Q.STATISTICS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((d, *brute.rule_statistics(t)) for d, t in rows), key=repr)
    assert Q.document_statistics(table([])).count() == 0


def labelled(n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(60, 200))]
        bad = i % 5 == 0
        if bad and i % 2:
            words = [w + "###" for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, "x"))
    return rows, labels


def test_learns_threshold_rules(spark, table):
    rows, labels = labelled()
    marked = spark.createDataFrame(labels + [(None, 0, "x"), (7, None, "x")], "doc_id bigint, quality int, text string")
    verdicts, rules = Q.quality_verdicts(table(rows), marked)
    kept = {r.doc_id: r.kept for r in verdicts.collect()}
    assert kept == {d: q == 1 for d, q, _ in labels}
    assert 1 <= len(rules.rules) <= 4 and "reject if" in str(rules)
    good = Q.good_documents(table(rows), marked)
    assert sorted(r.doc_id for r in good.collect()) == [d for d, q, _ in labels if q == 1] and len(good.columns) == 9


def test_without_labels(spark, table):
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    verdicts, rules = Q.quality_verdicts(table([(1, None), (2, " ".join(map(str, range(60)))), (2, "a " * 80)]), empty)
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in verdicts.collect()) == [(1, True, False), (2, False, True), (2, True, False)]
    assert not rules.rules
