"""Which 64-bit keys occur twice or more in a table, and a bit table of them that every task reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow, stored

# A key sets PROBES bits, so that at BITS_PER_KEY bits a key few others are marked; at most 64 MB in all.
PROBES, BITS_PER_KEY, MOST_BITS = 4, 16, 1 << 29
# Keys travel in blocks by their low bits; a task gathers this many keys before it sends blocks.
PIECE_BITS, GATHERED = 12, 1 << 21
# Bits to a page of the table: a place within one fits 16 bits.
PAGE_BITS = 1 << 16


def _turned(keys: np.ndarray) -> np.ndarray:
    """The halves of each key swapped: anchors are least hashes, so only their low bits deal them evenly."""
    return (keys << np.uint64(32)) | (keys >> np.uint64(32))


def key_blocks(batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks (piece, keys) of unsigned keys, each at most twice among those gathered: more would say no more."""

    def done(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(_turned(np.concatenate(parts)))
        own = np.ones(len(keys), bool)
        own[2:] = keys[2:] != keys[:-2]
        keys = keys[own]
        piece, first = np.unique((keys >> np.uint64(64 - PIECE_BITS)).astype(np.int32), return_index=True)
        bounds = np.append(8 * first, 8 * len(keys)).astype(np.int32)
        blocks = pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(bounds), pa.py_buffer(_turned(keys))])
        return pa.RecordBatch.from_arrays([pa.array(piece), blocks], names=["piece", "keys"])

    parts, n = [], 0
    for keys in batches:
        parts.append(keys)
        n += len(keys)
        if n >= GATHERED:
            yield done(parts)
            parts, n = [], 0
    if n:
        yield done(parts)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that occur twice or more in the blocks of a piece; blocks come in order of pieces."""

    def done(blocks: list[bytes]) -> pa.RecordBatch:
        keys = np.sort(np.frombuffer(b"".join(blocks), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.unique(keys[1:][keys[1:] == keys[:-1]]))], names=["anchor"])

    last, blocks = None, []
    for batch in batches:
        for piece, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if piece != last and blocks:
                yield done(blocks)
                blocks = []
            last = piece
            blocks.append(block.as_py())
    if blocks:
        yield done(blocks)


def repeated_keys(rows: DataFrame, blocks: Callable, name: str) -> DataFrame:
    """The keys (anchor) that occur twice or more in rows, stored; `blocks` maps batches of rows to key_blocks()."""
    dealt = map_arrow(rows, blocks, "piece int, keys binary").repartition("piece").sortWithinPartitions("piece")
    return stored(map_arrow(dealt, _twice, "anchor bigint"), name)


def _places(bits: int):
    """The bits that keys set, as blocks (page, places within it)."""
    page = min(bits, PAGE_BITS)

    def done(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(parts).view(np.uint64)
        low, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
        at = np.concatenate([(low + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]).astype(np.uint32)
        at.sort()
        pages, first = np.unique((at // np.uint32(page)).astype(np.int32), return_index=True)
        bounds = np.append(2 * first, 2 * len(at)).astype(np.int32)
        within = (at & np.uint32(page - 1)).astype("<u2")
        blocks = pa.Array.from_buffers(pa.binary(), len(pages), [None, pa.py_buffer(bounds), pa.py_buffer(within)])
        return pa.RecordBatch.from_arrays([pa.array(pages), blocks], names=["page", "bits"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(batch)
            if n >= GATHERED:
                yield done(parts)
                parts, n = [], 0
        if n:
            yield done(parts)

    return cut


def _pages(bits: int):
    """The bits of each page that any block sets; blocks come in order of pages."""
    size = min(bits, PAGE_BITS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(page: int, places: np.ndarray) -> pa.RecordBatch:
            packed = np.packbits(places, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([packed], pa.binary())], names=["page", "bits"])

        last, places = None, np.zeros(size, bool)
        for batch in batches:
            for page, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if page != last:
                    if last is not None:
                        yield done(last, places)
                    last, places = page, np.zeros(size, bool)
                places[np.frombuffer(block.as_buffer(), "<u2")] = True
        if last is not None:
            yield done(last, places)

    return join


def key_table(repeated: DataFrame) -> bytearray:
    """Bits for all keys (anchor) of `repeated`; a fuller table lets more others through, which changes no result.

    The driver takes its pages one partition at a time and holds one copy.
    """
    bits = min(MOST_BITS, 1 << max(15, (repeated.count() * BITS_PER_KEY - 1).bit_length()))
    schema = "page int, bits binary"
    blocks = map_arrow(repeated.select("anchor"), _places(bits), schema).repartition("page").sortWithinPartitions("page")
    out = bytearray(bits // 8)
    for row in map_arrow(blocks, _pages(bits), schema).toLocalIterator():
        begin = row["page"] * PAGE_BITS // 8
        out[begin : begin + len(row["bits"])] = row["bits"]
    return out


def marked(table: bytearray, keys: np.ndarray) -> np.ndarray:
    """Which of these keys the table marks: all that it was made of, and few others."""
    bits, flat = np.frombuffer(table, np.uint8), keys.ravel().view(np.uint64)
    own = np.arange(len(flat))
    for k in range(PROBES):
        x = flat[own]
        at = (x & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((x >> np.uint64(32)) | np.uint64(1))
        at &= np.uint64(8 * len(bits) - 1)
        own = own[((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
    out = np.zeros(len(flat), bool)
    out[own] = True
    return out.reshape(keys.shape)


def among(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """rows with `_among`: false only where no row of table has the same keys, true for few others.

    A bit table as above, in pages that are joined with every task's rows: wide rows without a partner need not move.
    """
    bits = min(MOST_BITS, 1 << max(15, (table.count() * BITS_PER_KEY - 1).bit_length()))
    at = F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1)) + 1
    page, place = F.bitmap_bucket_number(at).alias("_page"), F.bitmap_bit_position(at)
    same = table.select(*(F.col(k).cast(rows.schema[k].dataType).alias(k) for k in keys))
    pages = same.select(page, place.alias("_place")).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    marked_rows = rows.withColumn("_page", page).join(F.broadcast(pages), "_page", "left")
    return marked_rows.withColumn("_among", F.coalesce(bit, F.lit(False))).drop("_page", "_bits")


def stored_by_table(rows: DataFrame, function: Callable[[Broadcast], Callable], schema: str, repeated: DataFrame, name: str) -> DataFrame:
    """rows mapped by function(table of `repeated`), stored; neither the driver nor a task holds the table after that."""
    table = rows.sparkSession.sparkContext.broadcast(key_table(repeated))
    try:
        return stored(map_arrow(rows, function(table), schema), name)
    finally:
        table.destroy()
