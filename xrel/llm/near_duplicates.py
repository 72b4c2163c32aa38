"""MinHash near-duplicates (operator 8): a multi-index Hamming join over signatures, confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.buckets import connected, most_apart
from xrel.llm.shared import BROADCAST_ROWS, NO_ID, map_arrow, stored
from xrel.llm.words import BETWEEN_SPACES, LOWER, joined_hash, mix, scan, shingles, text_slices

SHINGLE = 5
# A signature has CHUNKS * PARTS components of 16 bits. Two within CHUNKS * 2 - 1 differing components have, by the
# pigeonhole principle, a chunk with at most one; one key per component left out of a chunk finds it.
CHUNKS, PARTS = 10, 6
_SEEDS = mix(np.arange(1, CHUNKS * PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FACTORS = mix(_SEEDS) | np.uint64(1)
# Bits of each component, packed into words, that tell distant pairs apart before their sets are fetched.
BITS, BIT_WORDS = 4, 4
# Counters that order shingles by how many sets hold them: their number is a power of two between these.
LEAST_COUNTERS, MOST_COUNTERS, PIECE = 1 << 16, 1 << 22, 1 << 13
# Buckets whose parity bounds how far two sets are apart.
ODD_BITS = 512
# Sets whose rarest shingles are found at once.
PREFIXED_BYTES = 1 << 17
_PREFIXES = "shingle bigint, id bigint, part bigint, n bigint, place bigint, odd array<bigint>"
_PRINTS = "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, signature binary"


def _sets(data: bytes, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; rows with fewer words have one of all their words."""
    words = scan(data.translate(LOWER), offsets, BETWEEN_SPACES)
    hashes = words.hashes()
    places, own = shingles(hashes, words.row, SHINGLE)
    first = np.searchsorted(places, words.first)
    for row in range(len(offsets) - 1):
        a, b = int(words.first[row]), int(words.first[row + 1])
        if b - a >= SHINGLE:
            yield np.unique(own[first[row] : first[row + 1]])
        elif b > a:
            yield np.array([joined_hash(hashes[a:b])], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def _signature(own: np.ndarray) -> bytes:
    lowest = np.empty(len(_SEEDS), np.uint64)
    for k in range(len(_SEEDS)):
        lowest[k] = ((own ^ _SEEDS[k]) * _FACTORS[k]).min()
    return (mix(lowest) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            sizes, digests, signatures = [], [], []
            for own in _sets(data, offsets):
                sizes.append(len(own))
                digests.append(hashlib.md5(own.tobytes(), usedforsecurity=False).digest() if len(own) else None)
                signatures.append(_signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[lo:hi],
                    batch.column(1)[lo:hi],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "digest", "signature"],
            )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every chunk and every component left out of it, a hash of the others."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        parts = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, CHUNKS, PARTS).astype(np.uint64)
        scaled = mix(parts + np.uint64(1)) * _FACTORS.reshape(CHUNKS, PARTS)
        keys = mix(scaled.sum(axis=2, dtype=np.uint64)[:, :, None] - scaled + _SEEDS.reshape(CHUNKS, PARTS))
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), CHUNKS * PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per_word = CHUNKS * PARTS // BIT_WORDS
    shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(BITS)
    for batch in batches:
        parts = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(batch), BIT_WORDS, per_word)
        packed = ((parts & ((1 << BITS) - 1)).astype(np.uint64) << shifts).sum(axis=2, dtype=np.uint64)
        bounds = np.arange(len(batch) + 1, dtype=np.int32) * BIT_WORDS
        listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(packed.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["id", "bits"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            found = [x.tobytes() for x in _sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(found, pa.binary())], names=["id", "items"])


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


def _sketch_rows(counters: int):
    """How often each counter is met by the shingles of one task, in pieces of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for *_, data, _ in text_slices(batch.column(0)):
                places = np.frombuffer(data, np.uint64) & np.uint64(counters - 1)
                np.add.at(total, places.view(np.int64), 1)
        if total.any():
            pieces = np.minimum(total, (1 << 31) - 1).astype("<i4").reshape(-1, PIECE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["piece", "counts"]
            )

    return count


def _sketch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
    if sums:
        out = [np.minimum(x, (1 << 31) - 1).astype("<i4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], names=["piece", "counts"])


def _frequencies(sets: DataFrame, n_items: int) -> np.ndarray:
    """Counters of shingles, in proportion to the shingles there are and bounded. They only order shingles."""
    counters = LEAST_COUNTERS
    while counters < min(n_items // 8, MOST_COUNTERS):
        counters *= 2
    schema = "piece int, counts binary"
    rows = map_arrow(map_arrow(sets.select("items"), _sketch_rows(counters), schema).repartition("piece"), _sketch_sums, schema).collect()
    out = np.zeros(counters, np.int32)
    for r in rows:
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.counts, "<i4")
    return out


def _odd(items: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, which of ODD_BITS buckets hold an odd number of its items. Where two sets' buckets differ, so do the sets."""
    bucket = (mix(items) & np.uint64(ODD_BITS - 1)).view(np.int64)
    odd = np.bincount(row * ODD_BITS + bucket, minlength=rows * ODD_BITS).reshape(rows, ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view("<i8")


def _prefixes(frequencies: Broadcast, percent: int):
    """The rarest shingles of each set, of which two linked sets have one in common, with their places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequencies.value
        for batch in batches:
            ids, parts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, data, offsets in text_slices(batch.column(2), PREFIXED_BYTES):
                items, sizes = np.frombuffer(data, np.uint64), np.diff(offsets) // 8
                row = np.repeat(np.arange(hi - lo), sizes)
                # Sets are sorted, so of items met equally often the smaller come first.
                rare = np.lexsort((counts[(items & np.uint64(len(counts) - 1)).view(np.int64)], row))
                place = np.arange(len(items)) - (offsets[:-1] // 8)[row]
                own = place < (sizes - -(-percent * sizes // 100) + 1)[row]
                first, row, place = items[rare[own]].view(np.int64), row[own], place[own]
                words = ODD_BITS // 64
                odd = _odd(items, np.repeat(np.arange(hi - lo), sizes), hi - lo)[row]
                bounds = np.arange(len(row) + 1, dtype=np.int32) * words
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (first, ids[lo + row], parts[lo + row], sizes[row], place)), pa.ListArray.from_arrays(bounds, odd.ravel())],
                    names=["shingle", "id", "part", "n", "place", "odd"],
                )

    return cut


def rarest_pairs(apart: DataFrame, sets: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts of apart (id, part) whose sets (id, items) may be linked; size has (id, n).

    Their rarest shingles meet, within bounds that linked sets keep: on lengths, places and what differs.
    """
    n_items = apart.join(size, "id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequencies = apart.sparkSession.sparkContext.broadcast(_frequencies(sets, n_items))
    rows = apart.join(sets, "id").select("id", "part", "items")
    first = stored(map_arrow(rows, _prefixes(frequencies, percent), _PREFIXES), "prefixes")
    # Shingles of one set alone, or of one component alone, give no pair.
    several = first.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("shingle")
    first = stored(first.join(several, "shingle", "left_semi"), "prefixes")
    left, right = (first.toDF(*(c if c == "shingle" else f"{c}_{x}" for c in first.columns)) for x in "ab")
    # At least so many shingles are in one set only; linked sets have at most (1 - t) / (1 + t) of all theirs.
    alone = sum((F.bit_count(F.get("odd_a", i).bitwiseXOR(F.get("odd_b", i))) for i in range(ODD_BITS // 64)), F.lit(0))
    both = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    holds = (
        (F.col("id_a") < F.col("id_b"))
        & (F.col("part_a") != F.col("part_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (both * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
        & (alone * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    )
    return left.join(right, "shingle").where(holds).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_shingles, component_id, first_key.

    Documents are linked when their sets of distinct five-word shingles (white-space words, A-Z lowered; with fewer
    words, all of them as one) have 100 * intersection >= percent * union, confirmed on the full sets. component_id is
    the smallest doc_id that links reach, and first_key the text key of that document. Texts without words, and null
    texts, have empty sets, are linked with nothing and have first_key null. A null doc_id comes last. Rows that repeat
    a doc_id are documents of their own where their texts differ. Other columns are ignored.

    Equal sets are one class; only classes are compared. Signatures within 19 of 60 differing components are always
    found; at a similarity of 0.8 a pair is missed with a chance of about 2.4 in 100,000, at 0.85 of 3.1 in 10 million,
    of which at most 1 in a billion falls to the bound on differing components.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    prints = stored(map_arrow(keyed, _prints, _PRINTS), "prints")
    name = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_key")
    grouped = prints.where("digest is not null").groupBy("digest").agg(
        F.min(name).alias("first"), F.max("n_shingles").alias("n"), F.any_value("signature").alias("signature")
    )
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = map_arrow(classes.select("id", "signature"), _keys, "key bigint, id bigint")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_key"), "text"
    )
    size = classes.select("id", "n")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = stored(classes.join(ids, "id", "left_semi").select("id", "first.doc", "first.text_key"), "wanted")
        # Texts move only where more documents are wanted than may be broadcast.
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        own = texts.join(few, ["doc", "text_key"]).select("id", "text")
        return stored(map_arrow(own, _set_rows, "id bigint, items binary").dropDuplicates(["id"]), "sets")

    def candidates(apart: DataFrame) -> DataFrame:
        return rarest_pairs(apart, sets_of(apart.select("id")), size, percent)

    def verify(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
        close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        pairs = stored(sized.where(close).select("a", "b"), "candidates")
        sets = sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return map_arrow(both, _confirmed(percent), "a bigint, b bigint")

    bits = map_arrow(classes.select("id", "signature"), _bits, "id bigint, bits array<bigint>")
    # Never fewer than the pigeonhole principle finds.
    most = most_apart(CHUNKS * PARTS, percent / 100, CHUNKS * 2 - 1)
    parts = connected(members, bits, BIT_WORDS, BITS, most, verify, candidates)
    labelled = classes.select("id", "digest", "first").join(parts.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    lowest = labelled.groupBy("component").agg(F.min("first").alias("lowest"))
    named = stored(labelled.join(lowest, "component").select("digest", "lowest"), "named-classes")
    smallest = F.when(F.col("lowest.doc") == NO_ID, F.lit(None)).otherwise(F.col("lowest.doc"))
    return prints.join(named, "digest", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("lowest").isNull(), F.col("doc_id")).otherwise(smallest).alias("component_id"),
        F.col("lowest.text_key").alias("first_key"),
    )


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of docs with all their columns, one document of each group of near-duplicates: that of the smallest doc_id.

    Rows equal in doc_id and text are one document and stay once; texts without words stay.
    """
    found = near_duplicates(docs, percent)
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    gone = found.where(F.col("first_key").isNotNull() & ~same).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")
    )
    key = F.xxhash64(docs["text"])
    kept = docs.join(gone.distinct(), docs["doc_id"].cast("bigint").eqNullSafe(F.col("_gone_id")) & (key == F.col("_gone_key")), "left_anti")
    again = found.where("first_key is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    if again.isEmpty():
        return kept
    with_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    once = kept.where(with_words).withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return once.unionByName(kept.where(~F.coalesce(with_words, F.lit(False))))
