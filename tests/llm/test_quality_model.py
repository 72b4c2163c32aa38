from __future__ import annotations

import zlib

import duckdb

from xrel.llm.quality_model import quality_scores
from xrel.llm.queries import op4_quality_classifier

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = op4_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= 0.95 * len(known)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_edges(spark, table):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (4, "one"), (None, "some text here"), (6, "x " * 5000)]
    none = spark.createDataFrame([(None, 1), (4, None)], "doc_id bigint, quality int")
    got = quality_scores(table(rows), none).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(4, 1), (6, 0), (4, 1)], "doc_id bigint, quality int")
    got = quality_scores(table(rows), some).collect()
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality_scores(table([]), some).count() == 0
