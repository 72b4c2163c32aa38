from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_tokens import MODEL, ODD, PIECES
from xrel.llm import pieces as P
from xrel.llm.queries import QUERIES

OWN = P.Pieces(PIECES)
SOME = [p.replace("▁", " ") for p in list(OWN.ids)[::97]]
TEXT = st.lists(st.sampled_from([*SOME, *"aab es\n\t▁-=—日😀\x00", " " * 17, "e" * 9]) | st.characters(exclude_categories=["Cs"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_like_the_library(text):
    ids = OWN.encode(text)
    assert ids.tolist() == MODEL.encode(text) and OWN.decode(ids) == MODEL.decode(ids.tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(3, 258), max_size=12).filter(lambda ids: 0 not in ids))
def test_any_ids_decode(ids):
    assert OWN.decode(np.array(ids, np.int32)) == MODEL.decode(ids)


@pytest.mark.parametrize("text", [" " * 30_000, "a" * 30_001, "ab" * 20_000, "word and " * 150_000, "日本" * 20_000])
def test_long_texts(text):
    assert OWN.encode(text).tolist() == MODEL.encode(text)


def test_pieces_of_every_unit_are_what_merging_gives():
    for unit in ["▁the", "▁▁▁▁▁▁▁", "▁misinterpretations", "▁aaaaaaaaaaaa", "▁=-=-=---=", "▁Ünïcode"]:
        assert [OWN.texts[i] for i in OWN.split(unit)] == OWN.merged(unit)


def test_caches_that_start_anew(monkeypatch):
    monkeypatch.setattr(P, "CACHED_UNITS", 3)
    monkeypatch.setattr(P, "CACHED_PAIRS", 3)
    own = P.Pieces(PIECES)
    for text in ["one two three four five six", "seven eight one two"] * 3:
        assert own.encode(text).tolist() == MODEL.encode(text)


def test_rows(spark, table):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(7, "again"), (7, "again"), (None, "no id"), (300, None)]
    encoded = P.encode_texts(table(rows), PIECES, 2)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.ids, r.text) for r in P.decode_ids(encoded, PIECES).collect())
    want = [((d is None, d or 0), [*MODEL.encode(t or ""), 2], MODEL.decode(MODEL.encode(t or ""))) for d, t in rows]
    assert got == sorted(want)
    assert P.encode_texts(table([]), PIECES).count() == 0
    assert [r.text for r in P.decode_ids(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), PIECES).collect()] == [""]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall():
        ids = [*MODEL.encode(t), 2]
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(MODEL.decode(ids))))
    got = QUERIES["op11_sentencepiece"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
