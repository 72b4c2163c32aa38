"""Every stage of the pipeline on what the stage before has written, against plain versions."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from xrel.llm.shared import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = documents(spark, SF), [documents(spark, SF)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_stage(steps):
    before, after = dict(texts(steps[0])), dict(texts(steps[1]))
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    for doc_id, text in before.items():
        n_words, _, _, _, repeated = brute.rule_statistics(text)
        if n_words < 50 or 100 * repeated > 50 * n_words:
            assert doc_id not in after
        elif labels.get(doc_id) == 1:
            assert after[doc_id] == text


def test_near_duplicates_stage(steps):
    before = texts(steps[1])
    kept = {d for d, _, _, keep in brute.near_duplicates(before, 80) if keep}
    assert texts(steps[2]) == [r for r in before if r[0] in kept]


def test_decontaminate_stage(steps):
    before = texts(steps[2])
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    clean = {r[0] for r in brute.decontaminate(before, items) if not r[5]}
    assert texts(steps[3]) == [r for r in before if r[0] in clean]


def test_mix_stage(steps):
    before, after = steps[3].collect(), steps[4].collect()
    copies, size, source = Counter(r.doc_id for r in after), Counter(), Counter()
    for r in before:
        assert copies[r.doc_id] <= 3
        size[r.source] += len(brute.white_words(r.text))
        source[r.source] += copies[r.doc_id] * len(brute.white_words(r.text))
    assert set(copies) <= {r.doc_id for r in before}
    assert 0.6 * sum(size.values()) <= sum(source.values()) <= 1.4 * sum(size.values())


def test_token_stage(spark, steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    # Rows of one doc_id are copies of one text here.
    for doc_id, text in texts(steps[4]):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, steps[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[5].count()
