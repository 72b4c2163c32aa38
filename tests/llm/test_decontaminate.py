from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tests.llm import brute
from xrel.llm import decontaminate as D


def got(spark, docs, items, **more):
    rows = D.benchmark_hits(docs, items, **more).collect()
    digest = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), digest(r.item_ids), r.n_hit > 0) for r in rows), key=repr)


def items_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id bigint, text string, words string, gram string")


def cases(seed):
    rng = random.Random(seed)
    words = ["the", "of", "é", "x1", "7", "zeta", "omega", "and"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.choice((1, 2, 5, 10, 14, 25)))) for i in range(12)]
    items += [(None, "nobody knows this item at all and yet it occurs here"), (3, None), (4, ""), (5, "?!"), (6, items[0][1])]
    docs = [(i, line(rng.randrange(60))) for i in range(40)]
    docs += [(i, f"{line(9)}. {rng.choice(items)[1]}, {line(4)}") for i in range(40, 70)]
    docs += [(71, None), (72, ""), (73, "--"), (None, items[2][1].upper()), (None, items[2][1]), (74, docs[3][1]), (74, docs[3][1])]
    docs += [(75, "Nobody knows this item at all and yet it occurs here"), (75, "another text under one id")]
    return docs, items


def test_against_all_windows(spark, table, monkeypatch):
    docs, items = cases(2)
    want = sorted(brute.decontaminate(docs, items), key=repr)
    assert got(spark, table(docs), items_table(spark, items)) == want
    monkeypatch.setattr(D, "BLOCK_GRAMS", 40)
    assert got(spark, table(docs), items_table(spark, items)) == want


def test_empty(spark, table):
    docs, items = cases(4)
    assert {r[2] for r in got(spark, table(docs), items_table(spark, []))} == {0}
    assert got(spark, table([]), items_table(spark, items)) == []


def test_clean_documents(spark, table):
    items = items_table(spark, [(1, "one two three four five six seven eight nine ten eleven")])
    rows = [(1, "One two three four five six seven eight nine ten!"), (2, "one two three"), (None, None)]
    kept = D.clean_documents(table(rows), items)
    assert sorted((r.doc_id or 0) for r in kept.select(F.col("doc_id")).collect()) == [0, 2]
    assert len(kept.columns) == 9
