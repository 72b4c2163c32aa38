"""Substring dedup (operator 5): paragraphs that nearly repeat, by MinHash bands, exact checks and components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.buckets import connected, most_apart
from xrel.llm.key_tables import among, key_blocks, marked, repeated_keys, stored_by_table
from xrel.llm.near_duplicates import rarest_pairs
from xrel.llm.shared import BROADCAST_ROWS, dropped, drops_shuffles, map_arrow, stored, with_row_key
from xrel.llm.words import BETWEEN_SPACES, LOWER, joined_hash, mix, scan, shingles, text_slices

SHINGLE = 5
# Paragraphs with fewer words are left alone: headings, licence lines and the like repeat without being copies.
LEAST_WORDS = 20
# A pair at the threshold may be missed with this chance at most, and one at STRAY may collide with this chance.
MISSED = 1e-4
STRAY, COLLIDING = 0.3, 0.15
_PLACED = "id bigint, n int, place int, begin int, end int, digest binary, n_shingles int"
_SIGNED = f"{_PLACED}, signature binary"
_PRINTS = f"{_PLACED}, keys array<bigint>, bits array<bigint>"
# Bits of each hash, one byte, that tell distant pairs apart before their sets are fetched.
BITS_PER_HASH = 8


def tuned_bands(similarity: float, missed: float = MISSED) -> tuple[int, int]:
    """(bands, rows per band): the fewest bands that miss few pairs at `similarity` and bring few strays together."""
    for rows in range(1, 65):
        bands = max(1, math.ceil(math.log(missed) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if 1 - (1 - STRAY**rows) ** bands <= COLLIDING:
            return bands, rows
    raise ValueError(f"no bands for a similarity of {similarity}")


def bit_words(hashes: int) -> int:
    return math.ceil(hashes * BITS_PER_HASH / 64)


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    return seeds, mix(seeds) | np.uint64(1)


def _paragraph_sets(data: bytes, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, place, begin, end, starts, hashes) of all lines with at least `least` words.

    begin and end are bytes within the row; the line feed that ends a line belongs to it. The sorted distinct shingle
    hashes of line i are hashes[starts[i] : starts[i + 1]].
    """
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    n_rows = len(offsets) - 1
    row = np.concatenate([np.arange(n_rows), np.searchsorted(offsets, feeds, "right") - 1])
    begin = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    bounds = np.append(begin, len(data))
    words = scan(data.translate(LOWER), bounds, BETWEEN_SPACES)
    counts = np.diff(words.first)
    chosen = np.flatnonzero(counts >= least)
    hashes = words.hashes()
    places, grams = shingles(hashes, words.row, SHINGLE)
    line = words.row[places]
    short = chosen[counts[chosen] < SHINGLE]
    if len(short):
        whole = [joined_hash(hashes[words.first[k] : words.first[k + 1]]) if counts[k] else np.uint64(0) for k in short.tolist()]
        line, grams = np.concatenate([line, short]), np.concatenate([grams, np.array(whole, np.uint64)])
    own = np.flatnonzero((counts >= least)[line])
    if len(short):
        own = own[np.argsort(line[own], kind="stable")]
    line, grams = line[own], grams[own]
    bounds_of = np.append(np.searchsorted(line, chosen), len(line)).tolist()
    for a, b in zip(bounds_of, bounds_of[1:]):
        grams[a:b].sort()
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (grams[1:] != grams[:-1])
    line, grams = line[new], grams[new]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    base = offsets[row[chosen]]
    starts = np.append(np.searchsorted(line, chosen), len(line))
    return row[chosen], place[chosen], begin[chosen] - base, bounds[chosen + 1] - base, starts, grams


def _minima(starts: np.ndarray, grams: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of every set under each of `hashes` hash functions."""
    seeds, factors = _seeds(hashes)
    out = np.empty((hashes, len(starts) - 1), np.uint64)
    if len(starts) > 1:
        own = np.empty(len(grams), np.uint64)
        for k in range(hashes):
            np.bitwise_xor(grams, seeds[k], out=own)
            np.multiply(own, factors[k], out=own)
            np.minimum.reduceat(own, starts[:-1], out=out[k])
    return mix(np.ascontiguousarray(out.T))


def _band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    return mix((minima.reshape(-1, bands, rows) * weights).sum(axis=2, dtype=np.uint64) + _seeds(bands)[0])


def _signed(bands: int, rows: int, least: int):
    """Every paragraph with the digest of its set and its signature: all band keys, then the low bits of its minima."""
    width = 8 * bit_words(bands * rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(2)):
                row, place, begin, end, starts, grams = _paragraph_sets(data, offsets, least)
                minima = _minima(starts, grams, bands * rows)
                low = np.zeros((len(row), width), np.uint8)
                low[:, : bands * rows] = minima & np.uint64((1 << BITS_PER_HASH) - 1)
                signatures = np.concatenate([_band_keys(minima, bands, rows), low.view(np.uint64)], axis=1)
                bounds = np.arange(len(row) + 1, dtype=np.int32) * (8 * bands + width)
                raw, cuts = grams.tobytes(), (8 * starts).tolist()
                digests = [hashlib.md5(raw[a:b], usedforsecurity=False).digest() for a, b in zip(cuts, cuts[1:])]
                where = pa.array(lo + row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(where),
                        batch.column(1).take(where),
                        *(pa.array(x.astype(np.int32)) for x in (place, begin, end)),
                        pa.array(digests, pa.binary()),
                        pa.array(np.diff(starts).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(signatures)]),
                    ],
                    names=["id", "n", "place", "begin", "end", "digest", "n_shingles", "signature"],
                )

    return cut


def _signatures(column: pa.Array, bands: int, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, bands + bit_words(bands * rows))


def _all_keys(bands: int, rows: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return key_blocks(_signatures(batch.column(0), bands, rows)[:, :bands].ravel() for batch in batches)

    return cut


def _prints(bands: int, rows: int, table: Broadcast):
    """Paragraphs of which the table marks a key, with these keys and the bits of their signatures.

    Equal sets have equal keys, so a paragraph without a marked key has no equal and shares no bucket.
    """
    words = bit_words(bands * rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = _signatures(batch.column(7), bands, rows).view(np.int64)
            keys = np.ascontiguousarray(signatures[:, :bands])
            shared = marked(table.value, keys)
            some = np.flatnonzero(shared.any(axis=1))
            shared, keys = shared[some], keys[some]
            key_bounds = np.concatenate([[0], np.cumsum(shared.sum(axis=1))]).astype(np.int32)
            bit_bounds = np.arange(len(some) + 1, dtype=np.int32) * words
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(list(range(7))).take(pa.array(some)).columns,
                    pa.ListArray.from_arrays(pa.array(key_bounds), pa.array(keys[shared])),
                    pa.ListArray.from_arrays(pa.array(bit_bounds), pa.array(signatures[some, bands:].ravel())),
                ],
                names=[*batch.schema.names[:7], "keys", "bits"],
            )

    return cut


def _wanted_sets(least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(0)):
                wanted: list[dict] = [dict(w) for w in batch.column(1)[lo : lo + len(offsets) - 1].to_pylist()]
                row, place, _, _, starts, grams = _paragraph_sets(data, offsets, least)
                classes, items = [], []
                for i, (r, p) in enumerate(zip(row.tolist(), place.tolist(), strict=True)):
                    if p in wanted[r]:
                        classes.append(wanted[r][p])
                        items.append(grams[starts[i] : starts[i + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(items, pa.binary())], names=["class", "items"])

    return cut


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, bytes_, kept, shared = [], [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            gone = sorted((m["begin"], m["end"], m["place"], m["shared"]) for m in marks.as_py() or [])
            parts, at = [], 0
            for a, b, *_ in gone:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            removed.append([p for _, _, p, _ in gone])
            bytes_.append(sum(b - a for a, b, *_ in gone))
            shared.append(sum(s for *_, s in gone))
            kept.append(None if text.as_py() is None else b"".join(parts).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bytes_, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string()), pa.array(shared, pa.int64())],
            names=["doc_id", "n_removed", "removed", "kept_text", "n_shared"],
        )


@drops_shuffles
def without_repeated_paragraphs(docs: DataFrame, percent: int = 80, least: int = LEAST_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_removed (bytes), removed (places of lines, from 0), kept_text, n_shared (of
    the removed lines, those whose first stands in another row).

    A paragraph is a line with at least `least` words. Two are linked when their sets of distinct five-word shingles
    (white-space words, A-Z lowered) have 100 * intersection >= percent * union, checked on the full sets. Of every
    component of links the first stays: smallest doc_id, null last; rows of one doc_id in the order of their texts;
    then by place. The others go with their line feed. Null texts stay null. Other columns are ignored.

    Equal sets are one class before anything is compared. Bands are tuned so that a pair at the threshold is missed
    with a chance of MISSED at most. Signatures are worked out once and stored; band keys that repeat are marked in a
    bit table, and only paragraphs with a marked key go further. What stays apart in buckets meets by its rarest shingles.
    Texts move only where a line is wanted or goes, and a few others.
    """
    bands, rows = tuned_bands(percent / 100)
    keyed = with_row_key(docs).select("id", F.col("n").cast("int").alias("n"), "doc_id", "text")
    texts = keyed.select("id", "n", F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(map_arrow(texts, _signed(bands, rows, least), _SIGNED), "signed-paragraphs")
    repeated = repeated_keys(signed.select("signature"), _all_keys(bands, rows), "repeated-keys")
    prints = stored_by_table(signed, lambda table: _prints(bands, rows, table), _PRINTS, repeated, "paragraphs")
    dropped(signed)
    dropped(repeated)
    place = F.struct("id", "n", "place")
    classes = stored(
        prints.groupBy("digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("members"), F.max("n_shingles").alias("size"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"))
        .withColumn("class", F.monotonically_increasing_id()),
        "paragraph-classes",
    )
    members = classes.select(F.explode("keys").alias("key"), F.col("class").alias("id"))
    size = classes.select("class", "size")

    spent: list[DataFrame] = []

    def sets_of(both: DataFrame) -> DataFrame:
        # What earlier sets were wanted for is stored by now.
        while spent:
            dropped(spent.pop())
        wanted = (
            classes.join(both, "class", "left_semi")
            .groupBy("first.id", "first.n")
            .agg(F.map_from_entries(F.collect_list(F.struct("first.place", "class"))).alias("wanted"))
        )
        wanted = stored(wanted, "wanted")
        n_wanted = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
        # Texts move only where more paragraphs are wanted than may be broadcast.
        if n_wanted <= BROADCAST_ROWS:
            own = texts.join(F.broadcast(wanted), ["id", "n"])
        else:
            own = among(texts, wanted, "id", "n").where("_among").join(wanted, ["id", "n"])
        own = own.select("text", "wanted")
        spent.append(stored(map_arrow(own, _wanted_sets(least), "class bigint, items binary"), "sets"))
        return spent[-1]

    def verify(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
        close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        near = stored(sized.where(close).select("a", "b"), "candidates")
        sets = sets_of(near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).distinct())
        with_sets = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return map_arrow(with_sets, _confirmed(percent), "a bigint, b bigint")

    def candidates(apart: DataFrame) -> DataFrame:
        sets = sets_of(apart.select(F.col("id").alias("class"))).toDF("id", "items")
        return rarest_pairs(apart, sets, size.toDF("id", "n"), percent)

    bits = classes.select(F.col("class").alias("id"), "bits")
    most = most_apart(bands * rows, percent / 100)
    parts = connected(members, bits, bit_words(bands * rows), BITS_PER_HASH, most, verify, candidates)
    labelled = classes.select("class", "digest", "first", "members").join(parts.toDF("class", "part"), "class", "left")
    # A class of one paragraph that is linked with none, or the first of its component, takes nothing out.
    labelled = labelled.where("members > 1 or part is not null").withColumn("part", F.coalesce("part", "class"))
    lowest = labelled.groupBy("part").agg(F.min("first").alias("lowest"))
    named = labelled.join(lowest, "part").where("members > 1 or first <> lowest").select("digest", "lowest")
    named = stored(named, "named-classes")
    later = among(prints.drop("keys", "bits"), named, "digest").where("_among").join(named, "digest").where(place != F.col("lowest"))
    elsewhere = (F.col("id") != F.col("lowest.id")) | (F.col("n") != F.col("lowest.n"))
    mark = F.struct("begin", "end", "place", elsewhere.alias("shared"))
    marks = stored(later.groupBy("id", "n").agg(F.collect_list(mark).alias("marks")), "marks")
    dealt = among(keyed, marks, "id", "n")
    whole = dealt.where("not _among").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_removed"), F.array().cast("array<int>").alias("removed"), F.col("text").alias("kept_text"), F.lit(0).cast("bigint").alias("n_shared")
    )
    cut = dealt.where("_among").join(marks, ["id", "n"], "left").select("doc_id", "text", "marks")
    return whole.unionByName(map_arrow(cut, _kept, "doc_id bigint, n_removed bigint, removed array<int>, kept_text string, n_shared bigint"))
