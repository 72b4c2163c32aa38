from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from xrel.llm.token_counts import PieceCounter, token_counts
from xrel.llm.token_files import TextEncoder, lookup_tokens, read_tokens, token_index, write_tokens
from xrel.llm.words import text_slices

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n", " \n", "▁", "a▁▁b\n▁c", "x\ty", "\r\n a", "<s> </s><|endoftext|>x <|startoftext|>", "it's 'll we'd",
       "é ́a", " x y\xa0", "İSTANBUL ΑΣ ΑΣ.", "a\x00b", "\x1c\x85 z", "日本語 テスト 123", "a\x0bb\x0cc", "😀 😀👍", "H̱ Å ́",
       "!!.,-—. a12b3", "<|ENDOFTEXT|> <|endoftext|>", "ﬁ ½ ² 12.5", "क्षि ไทย", "word " * 500]
LIBRARY = Tokenizer.from_file(WORDS)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TEXT = st.lists(
    st.sampled_from([*"aB é'.,1\n\t▁|<>", "\u0301", "the ", "'s", "ß", "—", "日", "<|endoftext|>"]), max_size=40
).map("".join)


def ids_of(encoder, texts):
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        counts, flat = encoder.encode(data, offsets, 1)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


ENCODER, COUNTER = TextEncoder(WORDS), PieceCounter(PIECES, {})


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_like_the_libraries(texts):
    assert ids_of(ENCODER, texts) == [library_ids(t) for t in texts]
    assert [COUNTER.count(t) for t in texts] == [len(MODEL.encode(t)) for t in texts]


def test_odd_texts():
    assert ids_of(ENCODER, ODD) == [library_ids(t) for t in ODD]
    assert [COUNTER.count(t) for t in ODD] == [len(MODEL.encode(t)) for t in ODD]


def test_files_round_trip(spark, table, tmp_path):
    rows = [(100 - i, t) for i, t in enumerate(ODD)] + [(300, None), (200, "b"), (200, "a"), (200, "a"), (None, "no id"), (-5, "first")]
    path = str(tmp_path / "tokens")
    write_tokens(table(rows), path, WORDS)
    got = token_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [*sorted(d for d, _ in rows if d is not None), None]
    start = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(library_ids(t))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        mine = {(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in texts[r.doc_id]}
        assert (r.n_tokens, r.ids_crc32) in mine
    assert [r.ids for r in lookup_tokens(spark, path, [-5]).collect()] == [library_ids("first")]
    stored = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in read_tokens(spark, path).collect())
    assert stored == sorted((d is None, d or 0, library_ids(t)) for d, t in rows)


def test_empty_files(spark, table, tmp_path):
    write_tokens(table([]), str(tmp_path / "none"), WORDS)
    assert token_index(spark, str(tmp_path / "none")).count() == 0


def test_counts(spark, table):
    rows = list(enumerate(ODD)) + [(None, None), (3, "again")]
    got = sorted(map(tuple, token_counts(table(rows), PIECES).collect()), key=repr)
    assert got == sorted(((d, len((t or "").encode()), len(MODEL.encode(t or ""))) for d, t in rows), key=repr)
    assert token_counts(table([]), PIECES).count() == 0
