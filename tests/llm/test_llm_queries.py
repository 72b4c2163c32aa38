"""The registered queries on the smallest tables: against SQL where there is some, else against plain versions."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

from __spark_entry__ import queries
from tests.check import compare, connect
from tests.llm import brute
from xrel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect())


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    ok, note = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert ok, note


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and len(QUERIES) == 13


def test_repeated_paragraphs(spark, docs):
    want = sorted(
        (d, size, len(places), ",".join(map(str, places)), hashlib.sha256((kept or "").encode()).hexdigest())
        for d, size, places, kept in brute.repeated_paragraphs(docs)
    )
    assert rows(spark, "op5_repeated_paragraphs", "doc_id", "n_removed", "n_paragraphs", "paragraphs", "kept_sha256") == want


def test_repeated_bytes(spark, docs):
    want = sorted(brute.repeated_bytes(docs))
    assert rows(spark, "op6_repeated_bytes", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_quality_rules(spark, docs):
    got = rows(spark, "op7_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [r[:6] for r in got] == [(d, *brute.rule_statistics(t)) for d, t in docs]
    for _, n_words, _, _, _, repeated, failed, kept in got:
        assert failed == (n_words < 50 or 100 * repeated > 50 * n_words) and not (failed and kept)


def test_near_duplicates(spark, docs):
    assert rows(spark, "op8_near_duplicates", "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(docs, 85))
