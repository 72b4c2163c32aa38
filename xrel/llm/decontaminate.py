"""Benchmark decontamination (operator 2): windows of benchmark items found in documents by a prefix-filtered join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow, stored
from xrel.llm.words import LETTERS_DIGITS, LOWER, Words, scan, shingles, text_slices

WINDOW = 10
# Words per shingle; the rarest shingle of a window is the prefix that documents must share with it.
GRAM = 3
# Distinct shingles that are looked for in one pass over the documents; larger benchmarks take several passes.
BLOCK_GRAMS = 4_000_000
_WINDOWS = "item string, words array<string>, grams array<bigint>"
_CANDIDATES = "doc_id bigint, text_key bigint, n_words bigint, found array<struct<gram:bigint,pos:int,low:int,context:string>>"


def _words(data: bytes, offsets: np.ndarray) -> Words:
    return scan(data.translate(LOWER), offsets, LETTERS_DIGITS)


def _grams(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(hashes, words.row, size)


def _item_windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts, grams = [], [], []
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = _words(data, offsets)
                hashes = words.hashes()
                for row in range(hi - lo):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    if a == b:
                        continue
                    length = min(window, b - a)
                    size = min(GRAM, length)
                    _, own = shingles(hashes[a:b], words.row[a:b], size)
                    listed = [words.text(i) for i in range(a, b)]
                    for s in range(b - a - length + 1):
                        items.append(batch.column(0)[lo + row].as_py())
                        texts.append(listed[s : s + length])
                        grams.append(own[s : s + length - size + 1].view(np.int64).tolist())
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array(items, pa.string()),
                    "words": pa.array(texts, pa.list_(pa.string())),
                    "grams": pa.array(grams, pa.list_(pa.int64())),
                }
            )

    return cut


class GramSet:
    """Membership of many 64-bit hashes at once: a bitmap first, the sorted hashes for what it lets through."""

    def __init__(self, grams: np.ndarray):
        self.sorted = np.unique(grams.astype(np.int64).view(np.uint64))
        bits = min(24, max(16, int(len(self.sorted) * 32).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(self.sorted >> self.shift).astype(np.int64)] = True

    def members(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.empty(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[(hashes >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == hashes[maybe]]


def _gram_counts(grams, sizes: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: GramSet = grams.value
        for batch in batches:
            seen = [np.empty(0, np.uint64)]
            for _, _, data, offsets in text_slices(batch.column(0)):
                words = _words(data, offsets)
                hashes = words.hashes()
                for size in sizes:
                    _, own = _grams(words, hashes, size)
                    seen.append(own[known.members(own)])
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "n"]
            )

    return count


def _candidates(grams, sizes: list[int], window: int):
    """Per document the places of prefix shingles, with the words that a window there could span."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: GramSet = grams.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                words = _words(data, offsets)
                hashes = words.hashes()
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for size in sizes:
                    places, own = _grams(words, hashes, size)
                    for k in known.members(own).tolist():
                        at = int(places[k])
                        row = int(words.row[at])
                        first, last = int(words.first[row]), int(words.first[row + 1])
                        low, high = max(first, at - window + size), min(last, at + window)
                        found[row].append(
                            {
                                "gram": int(own[k : k + 1].view(np.int64)[0]),
                                "pos": at - first,
                                "low": low - first,
                                "context": " ".join(words.text(i) for i in range(low, high)),
                            }
                        )
                kind = pa.list_(
                    pa.struct([("gram", pa.int64()), ("pos", pa.int32()), ("low", pa.int32()), ("context", pa.string())])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        batch.column(1)[lo:hi],
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(found, kind),
                    ],
                    names=["doc_id", "text_key", "n_words", "found"],
                )

    return find


def _block_hits(docs: DataFrame, windows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their numbers of words, occurrences (doc_id, text_key, start, length, window_key))."""
    spark = docs.sparkSession
    spans = windows.select("window_key", F.size("words").alias("length"), F.posexplode("grams").alias("offset", "gram"))
    sizes = sorted({min(GRAM, r.length) for r in spans.select(F.least("length", F.lit(GRAM)).alias("length")).distinct().collect()})
    # At most BLOCK_GRAMS values, by the choice of blocks.
    wanted = spark.sparkContext.broadcast(GramSet(spans.select("gram").distinct().toPandas()["gram"].to_numpy(np.int64)))
    counts = map_arrow(docs.select("text"), _gram_counts(wanted, sizes), "gram bigint, n bigint")
    rarity = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    # A window with a shingle that no document has occurs nowhere.
    ranked = spans.join(rarity, "gram", "left").groupBy("window_key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "offset")).alias("rarest")
    )
    prefixes = stored(
        ranked.where("rarest.n > 0")
        .join(windows.select("window_key", "words"), "window_key")
        .select("window_key", "words", "rarest.gram", "rarest.offset"),
        "prefixes",
    )
    rare = spark.sparkContext.broadcast(GramSet(prefixes.select("gram").distinct().toPandas()["gram"].to_numpy(np.int64)))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = stored(map_arrow(keyed, _candidates(rare, sizes, window), _CANDIDATES), "candidates")
    places = found.select("doc_id", "text_key", "n_words", F.explode("found").alias("c")).select(
        "doc_id", "text_key", "n_words", "c.*"
    )
    start, length = F.col("pos") - F.col("offset"), F.size("words")
    # Positional and length bounds first, then the words themselves.
    bounded = places.join(prefixes, "gram").where((start >= F.col("low")) & (start + length <= F.col("n_words")))
    exact = bounded.where(F.slice(F.split("context", " "), start - F.col("low") + 1, length) == F.col("words"))
    hits = exact.select("doc_id", "text_key", start.alias("start"), length.alias("length"), "window_key").distinct()
    return found.select("doc_id", "text_key", "n_words"), hits


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_hit, item_ids (sorted strings of the items that occur).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered. A window is `window` consecutive
    words of an item, or all of a shorter one; a document word inside any occurrence is hit. Null and empty texts
    have no words. Repeated items count once, a null item_id as "null". Rows of docs that repeat an id are told apart
    by text; equal rows give equal results. Empty benchmark: no hits. Other columns are ignored.
    """
    cut = map_arrow(items.select(F.col("item_id").cast("string").alias("item"), "text"), _item_windows(window), _WINDOWS)
    keyed = stored(cut.withColumn("window_key", F.md5(F.array_join("words", " "))), "windows")
    owners = keyed.select("window_key", F.coalesce("item", F.lit("null")).alias("item")).distinct()
    windows = keyed.dropDuplicates(["window_key"]).select("window_key", "words", "grams")
    n_grams = windows.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(n_grams / BLOCK_GRAMS))
    rows, all_hits = None, None
    for block in range(blocks):
        mine = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window_key"), F.lit(blocks)) == block)
        rows, hits = _block_hits(docs, mine, window)
        all_hits = hits if all_hits is None else all_hits.unionByName(hits)
    hits = stored(all_hits, "benchmark-hits")
    key = ["doc_id", "text_key"]
    order = Window.partitionBy(*key).orderBy("start", "length", "window_key")
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("length") - F.greatest("start", F.coalesce(before, F.lit(0)))
    covered = hits.select(*key, F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select(*key, "window_key").distinct().join(owners, "window_key").groupBy(*key).agg(
        F.array_sort(F.collect_set("item")).alias("item_ids")
    )
    both = covered.join(named, (covered["doc_id"].eqNullSafe(named["doc_id"])) & (covered["text_key"] == named["text_key"])).select(
        covered["doc_id"].alias("_id"), covered["text_key"].alias("_key"), "n_hit", "item_ids"
    )
    joined = rows.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of docs, with all their columns, in which no window of the benchmark occurs."""
    leaks = benchmark_hits(docs, items, window).where("n_hit > 0").select(
        F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")
    )
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(docs["text"]) == F.col("_leak_key"))
    return docs.join(leaks, same, "left_anti")
