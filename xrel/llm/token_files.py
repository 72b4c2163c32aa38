"""Token-ID files (operator 3): ORC with run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow
from xrel.llm.words import LOWER, Words, scan, text_slices

# A worker's table of encoded units starts anew when it holds this many.
CACHED = 1 << 21
# Bits for the number of ids of one unit; a pool of ids takes the others.
SIZE_BITS = 31
# Texts are encoded in slices of so many bytes, whose arrays stay near the processor.
ENCODED_BYTES = 1 << 18
# So many new units go to the library in one text.
JOINED = 4096
ROWS_PER_INDEX_ENTRY = 1_000
STRIPE_BYTES = 16 << 20
COLUMNS = "seq bigint, doc_id bigint, n_tokens bigint, ids array<int>"
_WORKER: dict = {}


# How the tokenizer's own split sees ASCII. 0 space, 1 letter, 2 digit, 3 other; 4 is left to the library
# with the whole text between two spaces: apostrophes begin contractions, bars end special tokens, the rest is not ASCII.
_KIND = bytes(
    0 if b in b" \t\n\r" else 1 if chr(b).isalpha() and b < 128 else 2 if 48 <= b <= 57 else 4 if b < 33 or b > 126 or b in b"'|" else 3
    for b in range(256)
)
_NOT_SPACE = bytes(int(k > 0) for k in _KIND)


class UnitTable:
    """Ids of units by a 64-bit hash of their bytes: open addressing in arrays, looked up for many at once.

    A free slot has the key 0. `where` has the place of a unit's ids in the pool, and their number in the low bits.
    """

    def __init__(self, slots: int = 2 * CACHED):
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.where = np.zeros(slots, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, or the free slot where it would go, and whether the key is there."""
        slot = (keys & self.mask).view(np.int64)
        held = self.keys[slot]
        there = held == keys
        open_ = np.flatnonzero(~there & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            held = self.keys[slot[open_]]
            there[open_] = held == keys[open_]
            open_ = open_[(held != keys[open_]) & (held != 0)]
        return slot, there

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New keys, all different, with their ids one after the other."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        places = ((self.used + np.cumsum(sizes, dtype=np.int64) - sizes) << SIZE_BITS) | sizes
        self.used += len(ids)
        self.count += len(keys)
        left = np.arange(len(keys))
        while len(left):
            slot, _ = self.find(keys[left])
            _, first = np.unique(slot, return_index=True)
            put, slot = left[first], slot[first]
            self.keys[slot], self.where[slot] = keys[put], places[put]
            left = np.delete(left, first)


class TextEncoder:
    """Ids of texts as the tokenizers library gives them, unit by unit.

    The tokenizer drops white space and never joins text across it, and Unicode composition never reaches over a
    space, so texts are cut at spaces first. What lies between is cut further, and its letters lowered, only where it
    is plain: ASCII and the letters from U+00C0 to U+00FF, which composition leaves alone and which have one small letter
    each. It is cut into runs of letters, single digits and runs of other characters, as the tokenizer's own split does.
    Every different unit goes to the library once per worker; texts are then put together from the table.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.table = UnitTable()
        # The ids that end a word, if the tokenizer marks them: plain units are one word each.
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _units(self, data: bytes, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """All units, and which of them are plain."""
        raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(_KIND)), np.uint8)
        # The letters from U+00C0 to U+00FF take two bytes, the first C3; 97 and B7 after it are signs.
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[(raw[lead + 1] & 0xDF) != 0x97]
        kind[lead] = kind[lead + 1] = 1
        between = scan(data, offsets, _NOT_SPACE)
        n = len(data)
        hard = np.flatnonzero(kind == 4)
        whole = np.searchsorted(hard, between.end) > np.searchsorted(hard, between.start)
        begins = np.zeros(n, bool)
        begins[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0)
        lowered = np.frombuffer(bytearray(data.translate(LOWER)), np.uint8)
        lowered[lead[raw[lead + 1] < 0x9F] + 1] += 32
        if whole.any():
            cover = np.zeros(n + 1, np.int8)
            cover[between.start[whole]] += 1
            cover[between.end[whole]] -= 1
            inside = np.cumsum(cover[:n], dtype=np.int8) > 0
            begins &= ~inside
            lowered = np.where(inside, raw, lowered)
        begins[between.start] = True
        start = np.flatnonzero(begins)
        # A unit ends where the next begins, or where its text between spaces ends.
        opens = np.zeros(n, bool)
        opens[between.start] = True
        owner = np.cumsum(opens[start]) - 1
        end = np.minimum(np.append(start[1:], n), between.end[owner])
        first = np.searchsorted(start, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        return Words(lowered.tobytes(), start, end, row, first), ~whole[owner]

    def _joined(self, units: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of ids per unit) of plain units; None if the words found are not these units."""
        raw, ids = np.frombuffer(units.data, np.uint8), []
        for k in range(0, len(at), JOINED):
            start, size = units.start[at[k : k + JOINED]], (units.end - units.start)[at[k : k + JOINED]] + 1
            begin = np.cumsum(size) - size
            places = np.arange(int(size.sum())) + np.repeat(start - begin, size)
            text = raw[np.minimum(places, len(raw) - 1)]
            text[begin + size - 1] = 32
            (got,) = self.library.encode_batch_fast([text[:-1].tobytes().decode()], add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
        flat = np.concatenate(ids)
        last = np.flatnonzero(self.ends[np.minimum(flat, len(self.ends) - 1)])
        if len(last) != len(at) or last[-1] != len(flat) - 1:
            return None
        return flat, np.diff(last, prepend=-1).astype(np.int32)

    def _learn(self, units: Words, plain: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> None:
        """Encode the units at these places, joined by spaces: where words do not tell units apart, by the places of ids."""
        own = at[plain[at]]
        found = self._joined(units, own) if len(own) else None
        if found:
            self.table.add(hashes[own], *found)
            at = at[~plain[at]]
        for k in range(0, len(at), 256):
            some = at[k : k + 256]
            texts = [units.text(i) for i in some.tolist()]
            got = self.library.encode(" ".join(texts), add_special_tokens=False)
            begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
            owner = np.searchsorted(begin, np.array([a for a, _ in got.offsets], np.int64), "right") - 1
            sizes = np.bincount(owner, minlength=len(texts)).astype(np.int32) if len(owner) else np.zeros(len(texts), np.int32)
            self.table.add(hashes[some], np.array(got.ids, np.int32), sizes)

    def encode(self, data: bytes, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per row, all ids): each row's ids with end_id after them."""
        rows = len(offsets) - 1
        if not data:
            return np.ones(rows, np.int64), np.full(rows, end_id, np.int32)
        units, plain = self._units(data, offsets)
        hashes = units.hashes()
        hashes[hashes == 0] = 1
        table = self.table
        slot, there = table.find(hashes)
        missing = np.flatnonzero(~there)
        if len(missing):
            if table.count + len(missing) > CACHED:
                # Grown only for a slice with more different units than the table holds.
                self.table = table = UnitTable(1 << max(int(2 * CACHED).bit_length() - 1, int(2 * len(hashes)).bit_length()))
                missing = np.arange(len(hashes))
            _, first = np.unique(hashes[missing], return_index=True)
            self._learn(units, plain, hashes, missing[first])
            slot, _ = table.find(hashes)
        where = table.where[slot]
        sizes, start = where & ((1 << SIZE_BITS) - 1), where >> SIZE_BITS
        counts = np.bincount(units.row, weights=sizes, minlength=rows).astype(np.int64)
        total = int(sizes.sum())
        run = np.cumsum(sizes) - sizes
        step = np.arange(total)
        source = np.repeat(start - run, sizes) + step
        out = np.full(total + rows, end_id, np.int32)
        out[step + np.repeat(units.row, sizes)] = table.pool[source]
        return counts + 1, out


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row in the order of the input; a null text has the end id alone."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _WORKER.get("path") != tokenizer:
            _WORKER.update(path=tokenizer, encoder=TextEncoder(tokenizer))
        encoder = _WORKER["encoder"]
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), ENCODED_BYTES):
                counts, flat = encoder.encode(data, offsets, end_id)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(counts), ids], names=["doc_id", "n_tokens", "ids"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows, encode, "doc_id bigint, n_tokens bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Write the ids of all rows in ascending doc_id order, nulls last; rows of one doc_id in the order of their texts.

    The order is made on the texts, before encoding, by a hash of the text within a doc_id, so that a doc_id of
    many rows spreads over tasks. `seq` numbers rows in file order: task in the high bits, row in the low 33.
    """
    tie = F.xxhash64(F.col("text"))
    missing = F.col("doc_id").isNull()
    rows = docs.select("doc_id", "text", missing.alias("_last"), tie.alias("_tie"))
    ordered = rows.repartitionByRange("_last", "doc_id", "_tie").sortWithinPartitions("_last", "doc_id", "_tie", "text")
    ids = encode_documents(ordered, tokenizer, end_id)
    (
        ids.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "n_tokens", "ids")
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROWS_PER_INDEX_ENTRY)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files; Spark splits a file by stripes, and reads only the columns asked for."""
    return spark.read.schema(COLUMNS).orc(path)


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents asked for: stripes and row groups without them are skipped by ranges and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        bounds = ids.offsets.to_numpy().tolist()
        view = memoryview(flat).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts), pa.array(crc, pa.int64())],
            names=["seq", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    found = map_arrow(read_tokens(spark, path), _checksums, "seq bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    rows = found.withColumn("part", F.shiftrightunsigned("seq", 33))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written task; its count comes from the narrow column alone.
    sizes = read_tokens(spark, path).groupBy(F.shiftrightunsigned("seq", 33).alias("part")).agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select(
        "doc_id",
        (F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
