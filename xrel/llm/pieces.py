"""Exact encoding with a sentencepiece model of merge type by backtracking, and decoding (operator 11)."""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow

# What a worker remembers: encoded units, and verdicts on pairs of neighbours. Beyond this they start anew.
CACHED_UNITS = 250_000
CACHED_PAIRS = 400_000
LONGEST_CACHED = 48
# Units of one text taken at a time, so that memory stays bounded for very long texts.
CHARACTERS_AT_ONCE = 1 << 20
UNITS_AT_ONCE = 1 << 16
MARK = "▁"
NEVER = float("-inf")
_WORKER: dict = {}

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Pieces:
    """A vocabulary whose pieces come from merges: the best-scored pair of neighbours first, the leftmost of equals.

    A sequence of pieces is the encoding of its text exactly if every two neighbours are what merging their joined text
    gives: merges within a part happen in the same order as within the whole, so the first merge over a border of the
    sequence would also happen when those two are merged alone. `encode_unit` looks for that sequence from the left, the
    longest piece first, and marks positions from which no continuation exists, so each fails only once.
    """

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.size = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) for i in range(size)]
        texts = [self.model.id_to_piece(i) for i in range(size)]
        self.ids = {t: i for i, t in enumerate(texts) if not special[i] and not self.model.is_unused(i)}
        self.scores = {t: self.model.get_score(i) for t, i in self.ids.items()}
        self.byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surfaces = [
            b"" if self.model.is_control(i) else bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace(MARK, " ").encode()
            for i, t in enumerate(texts)
        ]
        # By id: text, length and the next shorter piece that is a prefix (-1: none). Characters without a piece get ids
        # of their own beyond the vocabulary.
        self.texts, self.lengths, self.shorter = texts, [len(t) for t in texts], [-1] * size
        self.characters: dict[str, int] = {t: i for t, i in self.ids.items() if len(t) == 1}
        self.matches = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.matches.add_word(text, i)
            if len(text) > 1:
                prefix = next((text[:n] for n in range(len(text) - 1, 1, -1) if text[:n] in self.ids), None)
                self.shorter[i] = self._character(text[0]) if prefix is None else self.ids[prefix]
        self.matches.make_automaton()
        self.units: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        joined = [t for t in self.ids if len(t) > 1]
        if any(MARK in t.lstrip(MARK) for t in joined):
            self.cut = re.compile(r"(?s).+")
        elif any("\n" in t for t in joined):
            self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
        self._check()

    def _check(self) -> None:
        """Other kinds of models (unigram, without bytes, with other white-space rules) are refused, not encoded wrongly."""
        if not all(self.model.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no piece for every byte")
        sample = " ".join(islice(self.ids, 0, None, max(1, len(self.ids) // 2000))).replace(MARK, " ") + "  \n x"
        ids = self.encode(sample)
        if ids.tolist() != self.model.encode(sample) or self.decode(ids) != self.model.decode(ids.tolist()):
            raise ValueError("the model does not encode by merges with byte fallback, or decodes by other rules")

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for short texts: the best-scored neighbours are joined until none are left."""
        parts, score = list(text), self.scores.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def _character(self, c: str) -> int:
        known = self.characters.get(c)
        if known is None:
            known = self.characters[c] = len(self.texts)
            self.texts.append(c)
            self.lengths.append(1)
            self.shorter.append(-1)
        return known

    def _fits(self, key: int, before: int, after: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        a, b = "" if before < 0 else self.texts[before], self.texts[after]
        known = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def split(self, text: str) -> list[int]:
        """The pieces of one unit by backtracking."""
        size, lengths, shorter, known = len(text), self.lengths, self.shorter, self.pairs
        longest: list = [None] * size
        for end, i in self.matches.iter(text):
            # Matches come by their end, so a later one at the same place is longer.
            longest[end + 1 - lengths[i]] = i
        if None in longest:
            longest = [self._character(c) if i is None else i for i, c in zip(longest, text, strict=True)]
        failed = bytearray(size + 1)
        found: list[int] = []
        at, before = 0, -1
        piece = longest[0] if size else -1
        while at < size:
            while piece >= 0:
                end = at + lengths[piece]
                if not failed[end]:
                    key = (before << 32) + piece
                    fits = known.get(key)
                    if self._fits(key, before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                found.append(piece)
                before, at = piece, end
                piece = longest[at] if at < size else -1
            else:
                failed[at] = 1
                at -= lengths[found[-1]]
                piece = shorter[found.pop()]
                before = found[-1] if found else -1
        return found

    def encode_unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for i in self.split(unit):
            if i < self.size:
                ids.append(i)
            else:
                ids += [self.byte_ids[b] for b in self.texts[i].encode()]
        return array("i", ids).tobytes()

    def _known(self, unit: str) -> bytes:
        ids = self.encode_unit(unit)
        if len(unit) <= LONGEST_CACHED:
            if len(self.units) >= CACHED_UNITS:
                self.units.clear()
            self.units[unit] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without begin and end."""
        text = self.model.normalize(text)
        if len(text) <= CHARACTERS_AT_ONCE:
            return np.frombuffer(self._encode_units(self.cut.findall(text)), np.int32)
        found, out = self.cut.finditer(text), []
        while some := [m[0] for m in islice(found, UNITS_AT_ONCE)]:
            out.append(self._encode_units(some))
        return np.frombuffer(b"".join(out), np.int32)

    def _encode_units(self, units: list[str]) -> bytes:
        ids = list(map(self.units.get, units))
        if None in ids:
            ids = [i or self.units.get(u) or self._known(u) for i, u in zip(ids, units, strict=True)]
        return b"".join(ids)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: one mark at the beginning is dropped, bytes that are no character become U+FFFD each."""
        raw = b"".join(map(self.surfaces.__getitem__, ids.tolist()))
        # The mark is only dropped from a piece, never from a byte.
        first = next((i for i in ids.tolist() if self.surfaces[i]), None) if raw[:1] == b" " else None
        if first is not None and not self.model.is_byte(first):
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


def _pieces(model_path: str) -> Pieces:
    if _WORKER.get("path") != model_path:
        _WORKER.update(path=model_path, pieces=Pieces(model_path))
    return _WORKER["pieces"]


def encode_texts(docs: DataFrame, model_path: str, end_id: int | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row: its whole text encoded, then `end_id` if one is given.

    Null and empty texts have no ids of their own; repeated rows and null ids are encoded row by row; other columns
    are dropped. Nothing is shuffled. `model_path` is a sentencepiece model of merge type with byte pieces at the same
    place on every machine; other kinds raise ValueError.
    """
    end = np.array([] if end_id is None else [end_id], np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            rows = [np.append(pieces.encode(t.as_py() or ""), end) for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else end[:0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), encode, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text that they decode to; null ids decode to an empty text, ids outside the model raise."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            column = batch.column(1)
            texts = [pieces.decode(np.asarray(column[i].values)) if column[i].is_valid else "" for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return map_arrow(rows, decode, "doc_id bigint, ids array<int>, text string")
