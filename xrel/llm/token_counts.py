"""Token counts (operator 10): frequent pre-tokens from a broadcast table, the rest from a cache in each worker."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow
from xrel.llm.words import scan, text_slices

# Entries of the broadcast table, and of what one task proposes for it. Longer pre-tokens are left to the caches.
FREQUENT = 1 << 16
PER_TASK = 1 << 13
LONGEST = 48
# A worker's cache starts anew from the table beyond this many entries.
CACHED = 1_000_000

_AT_SPACE = bytes(0 if b in b" \n" else 1 for b in range(256))
_PRE_TOKENS = re.compile("▁+[^▁\n]*|\n[^▁\n]*")
_WORKER: dict = {}


class PieceCounter:
    """Counts the pieces of a text as sentencepiece gives them, pre-token by pre-token.

    No piece of the vocabulary has a white-space mark after another character or a line feed anywhere, as
    `check_vocabulary` makes sure, so no merge crosses the edges of a pre-token and counts add up.
    """

    def __init__(self, model_path: str, frequent: dict[str, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.frequent = frequent
        self.cache = dict(frequent)

    def check_vocabulary(self) -> None:
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if "\n" in piece or "▁" in piece.lstrip("▁"):
                raise ValueError(f"pieces cross pre-tokens: {piece!r}")

    def _learn(self, missing: list[str]) -> None:
        """Keys are words after one space, or begin with a line feed."""
        if len(self.cache) + len(missing) > CACHED:
            self.cache = dict(self.frequent)
        for key, pieces in zip(missing, self.model.encode(missing, num_threads=1), strict=True):
            # The model puts one mark before the text; before a line feed it is not part of the pre-token.
            self.cache[key] = len(pieces) - key.startswith("\n")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        keys = text.replace("▁", " ").replace("\n", " \n").split(" ")
        if "" in keys:
            return self._count_runs(text)
        found = list(map(self.cache.get, keys))
        if None in found:
            missing = list({k for k, n in zip(keys, found, strict=True) if n is None})
            known = {k: n for k, n in zip(keys, found, strict=True) if n is not None}
            self._learn(missing)
            return sum(known[k] if k in known else self.cache[k] for k in keys)
        return sum(found)

    def _count_runs(self, text: str) -> int:
        """Texts with runs of spaces, or spaces at an end."""
        total, cut = 0, []
        for token in _PRE_TOKENS.findall("▁" + text.replace(" ", "▁")):
            if token == "▁":
                total += 1
            else:
                cut.append(token if token[0] == "\n" else token[1:].replace("▁", " "))
        for key in cut:
            if key not in self.cache:
                self._learn([key])
            total += self.cache[key]
        return total


def _frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of one task. Those seen once in a slice of text are left out of its tally."""
    tally: Counter = Counter()
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            found = scan(data, offsets, _AT_SPACE)
            _, at, n = np.unique(found.hashes(), return_index=True, return_counts=True)
            keep = (n > 1) & (found.end[at] - found.start[at] <= LONGEST)
            for i, count in zip(at[keep].tolist(), n[keep].tolist(), strict=True):
                tally[found.text(i)] += count
            if len(tally) > 16 * PER_TASK:
                tally = Counter(dict(tally.most_common(4 * PER_TASK)))
    top = heapq.nlargest(PER_TASK, tally.items(), key=lambda x: (x[1], x[0]))
    yield pa.RecordBatch.from_pydict(
        {"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
    )


def frequent_lengths(docs: DataFrame, model_path: str) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens over all texts; at most FREQUENT entries reach the driver."""
    proposed = map_arrow(docs.select("text"), _frequent_words, "word string, n bigint")
    top = proposed.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT)
    words = [r.word for r in top.select("word").collect()]
    counter = PieceCounter(model_path, {})
    counter.check_vocabulary()
    return {w: len(p) for w, p in zip(words, counter.model.encode(words, num_threads=1), strict=True)} if words else {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row: the pieces of its whole text, without begin or end.

    Null and empty texts have none; repeated rows and null ids are counted row by row; other columns are dropped.
    Pre-tokens are never shuffled: only bounded tallies of frequent ones are, to fill the broadcast table.
    `model_path` is a sentencepiece model at the same place on every machine.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model_path, table.id if hasattr(table, "id") else id(table))
        if _WORKER.get("key") != key:
            _WORKER.update(key=key, counter=PieceCounter(model_path, table.value))
        counter: PieceCounter = _WORKER["counter"]
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array((counter.count(t.as_py()) for t in texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", n_bytes)
    return map_arrow(rows, count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
