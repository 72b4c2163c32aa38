"""Substring dedup (operator 5), beside whole lines: exact passages that repeat within longer lines or over line ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.key_tables import among, key_blocks, marked, repeated_keys, stored_by_table
from xrel.llm.repeated_bytes import judged_runs
from xrel.llm.shared import BROADCAST_ROWS, drops_shuffles, map_arrow, stored, with_row_key
from xrel.llm.words import BETWEEN_SPACES, LOWER, scan, shingles, text_slices

SIZE = 50
# Every window of SIZE words has an anchor: of all its runs of ANCHOR words, the first with the least hash.
ANCHOR = 20
# Windows to a batch.
CHUNK = 50_000
_RUNS = "anchor bigint, text_a bigint, text_b bigint, id bigint, place bigint, more int, close boolean"


def anchor_runs(hashes: np.ndarray, row: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash) of runs of windows of `size` words with one anchor, as words of the slice.

    Every window within a row lies in exactly one run, and equal windows have equal anchors.
    """
    n, choices = len(hashes) - size + 1, size - anchor + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    # Runs over two rows are no part of a window within one row.
    grams = shingles(hashes, np.zeros(len(hashes), np.int64), anchor)[1]
    # The first least of spans that double, then of two spans that cover all choices.
    best, low, span = np.arange(len(grams)), grams, 1
    while span < choices:
        step = min(span, choices - span)
        left, right = low[:-step], low[step:]
        less = right < left
        best = np.where(less, best[step:], best[:-step])
        low = np.minimum(left, right)
        span += step
    whole = np.flatnonzero(row[:n] == row[size - 1 :])
    if not len(whole):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    best, own = best[:n][whole], row[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (best[1:] != best[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    return own[first], whole[first], whole[last], grams[best[first]]


def _anchors(size: int, anchor: int):
    """The anchor of every run, and nothing else."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for *_, data, offsets in text_slices(batch.column(0)):
                words = scan(data.translate(LOWER), offsets, BETWEEN_SPACES)
                yield anchor_runs(words.hashes(), words.row, size, anchor)[3]

    return lambda batches: key_blocks(anchors(batches))


def _close(row: np.ndarray, anchors: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Runs with another of the same anchor less than `size` words before them in their row."""
    order = np.lexsort((first, anchors, row))
    r, a, f = row[order], anchors[order], first[order]
    out = np.zeros(len(row), bool)
    out[order[1:]] = (r[1:] == r[:-1]) & (a[1:] == a[:-1]) & (f[1:] - f[:-1] < size)
    return out


def _repeated_runs(size: int, anchor: int, table: Broadcast):
    """Runs whose anchor the bit table marks, with a 128-bit digest of their words; `place` is n in the high half, then the start.

    Runs that are close to another have no digest: only their windows are judged.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, data, offsets in text_slices(batch.column(2)):
                lowered = data.translate(LOWER)
                words = scan(lowered, offsets, BETWEEN_SPACES)
                row, first, last, hashes = anchor_runs(words.hashes(), words.row, size, anchor)
                anchors = hashes.view(np.int64)
                own = np.flatnonzero(marked(table.value, anchors))
                row, first, last, anchors = row[own], first[own], last[own], anchors[own]
                close = _close(row, anchors, first, size)
                digests = []
                for a, b in zip(words.start[first[~close]].tolist(), words.end[last[~close] + size - 1].tolist(), strict=True):
                    digests.append(hashlib.blake2b(b" ".join(lowered[a:b].split()), digest_size=16).digest())
                text = np.zeros((len(row), 2), np.int64)
                text[~close] = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                place = first - words.first[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors),
                        pa.array(np.ascontiguousarray(text[:, 0])),
                        pa.array(np.ascontiguousarray(text[:, 1])),
                        pa.array(ids[lo + row]),
                        pa.array((ns[lo + row].astype(np.int64) << 32) | place),
                        pa.array((last - first).astype(np.int32)),
                        pa.array(close),
                    ],
                    names=["anchor", "text_a", "text_b", "id", "place", "more", "close"],
                )

    return find


def _windows(size: int):
    """128-bit digests of the words of all windows in the runs asked for, each once a row, with the places it starts at."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, places, digests = [], [], [], []

            def done():
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
                arrays = [pa.array(x, t) for x, t in zip((digests, ids, ns, places), kinds, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, names=["digest", "id", "n", "places"])

            for i, n, text, runs in zip(*(batch.column(k) for k in range(4)), strict=True):
                own = text.as_py().encode().translate(LOWER).split()
                sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
                begin = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                joined = b" ".join(own)
                found: dict[bytes, list[int]] = {}
                for first, last in sorted((run["first"], run["last"]) for run in runs.as_py()):
                    for k in range(first, last + 1):
                        digest = hashlib.blake2b(joined[begin[k] : begin[k + size] - 1], digest_size=16).digest()
                        found.setdefault(digest, []).append(k)
                digests += found
                places += found.values()
                ids += [i.as_py()] * len(found)
                ns += [n.as_py()] * len(found)
                if len(places) > CHUNK:
                    yield done()
                    ids, ns, places, digests = [], [], [], []
            yield done()

    return cut


def _cut(size: int):
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, shared = [], [], []
            for text, runs in zip(batch.column(2), batch.column(3), strict=True):
                runs = sorted((r["first"], r["last"], r["shared"]) for r in runs.as_py() or [])
                if not runs:
                    spans.append([])
                    kept.append(text.as_py())
                    shared.append(0)
                    continue
                data = text.as_py().encode()
                words = scan(data, np.array([0, len(data)]), BETWEEN_SPACES)
                gone: list[list[int]] = []
                for a, b, elsewhere in runs:
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b + size)
                        gone[-1][2] |= elsewhere
                    else:
                        gone.append([a, b + size, elsewhere])
                own = [(int(words.start[a]), int(words.end[b - 1])) for a, b, _ in gone]
                shared.append(sum(x for *_, x in gone))
                parts, at = [], 0
                for a, b in own:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                spans.append([{"begin": a, "end": b} for a, b in own])
                kept.append(b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.string()), pa.array(shared, pa.int64())],
                names=["doc_id", "more", "passages", "text", "n_shared"],
            )

    return cut


@drops_shuffles
def without_repeated_passages(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, shared: str | None = None) -> DataFrame:
    """docs with passages (spans of bytes of the given text) and with text less these passages.

    A column `shared`, if named, counts the passages of which a window stands in another row first.

    A passage is a run of `size` or more words (between ASCII white space, A-Z lowered, line ends like other white
    space). A word goes if a window of `size` words over it also starts earlier: in a row of smaller doc_id, null last,
    rows of one doc_id in the order of their texts, or earlier in the same row without overlapping its copy there.
    Windows are judged on the given texts; what goes is there before. White space around a passage stays. Null texts
    stay null. Other columns are passed on.

    Windows are brought together by anchors, and runs of them around one anchor by 128-bit digests of their words: a run
    that repeats an earlier one goes as a whole. Only where an anchor has different runs are the windows of the first of
    each written out, by 128-bit digests too; the first of each is found by a least value that combines before it
    shuffles. Runs that may overlap an equal one in their own row are judged by windows always.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = stored(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *more).alias("more")), "passage-texts")
    keyed = with_row_key(packed, "more").withColumn("n", F.col("n").cast("int"))
    texts = keyed.where("text is not null").select("id", "n", "text")
    repeated = repeated_keys(texts.select("text"), _anchors(size, anchor), "repeated-passages")
    found = stored_by_table(texts, lambda table: _repeated_runs(size, anchor, table), _RUNS, repeated, "passage-runs")
    close = found.where("close").select("anchor", "id", "place", "more")
    leaders, copies = judged_runs(found.where("not close").drop("close"))
    kinds = leaders.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    mixed = kinds.unionByName(close.select("anchor")).distinct()
    unlike = leaders.join(mixed, "anchor", "left_semi").unionByName(close)
    n, first = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")
    span = F.struct(first.alias("first"), (first + F.col("more")).alias("last"))
    runs = stored(unlike.groupBy("id", n.alias("n")).agg(F.collect_list(span).alias("runs")), "different-passages")
    # Texts move only where there are more such runs than may be broadcast.
    if runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        own = texts.join(F.broadcast(runs), ["id", "n"])
    else:
        own = among(texts, runs, "id", "n").where("_among").join(runs, ["id", "n"])
    windows = map_arrow(own.select("id", "n", "text", "runs"), _windows(size), "digest binary, id bigint, n int, places array<int>")
    windows = stored(windows, "windows")
    where = F.struct("id", "n", F.get("places", 0).alias("place"))
    origin = windows.groupBy("digest").agg(F.min(where).alias("origin"), F.sum(F.size("places")).alias("count")).where("count > 1").drop("count")
    origin = stored(origin, "origins")
    elsewhere = (F.col("id") != F.col("origin.id")) | (F.col("n") != F.col("origin.n"))
    apart = F.when(elsewhere, F.col("places")).otherwise(F.filter("places", lambda k: k >= F.col("origin.place") + size))
    # Windows that no other is equal to need not move.
    again = among(windows, origin, "digest").where("_among").join(origin, "digest").select("id", "n", F.explode(apart).alias("place"), elsewhere.alias("shared"))
    again = again.select("id", "n", F.struct(F.col("place").alias("first"), F.col("place").alias("last"), "shared").alias("span"))
    if shared:
        # Kinds of runs that several rows have: a copy in a row after the first of them repeats another row.
        kind, row = ("anchor", "text_a", "text_b"), F.struct("id", n.alias("n"))
        several = found.where("not close").groupBy(*kind).agg(F.min(row).alias("low"), F.max(row).alias("high")).where("low <> high").drop("high")
        found_elsewhere = found.where("not close").join(several, list(kind)).where(row != F.col("low")).select("id", "place", F.lit(True).alias("_shared"))
        copies = copies.join(found_elsewhere, ["id", "place"], "left")
    else:
        copies = copies.withColumn("_shared", F.lit(False))
    copied = F.struct(span["first"].alias("first"), span["last"].alias("last"), F.coalesce("_shared", F.lit(False)).alias("shared"))
    gone = copies.select("id", n.alias("n"), copied.alias("span")).unionByName(again)
    by_row = stored(gone.groupBy("id", "n").agg(F.collect_list("span").alias("spans")), "spans")
    dealt = among(keyed, by_row, "id", "n")
    kinds = {"doc_id": "bigint", "more": packed.schema["more"].dataType.simpleString(), "passages": "array<struct<begin:int,end:int>>", "text": "string", "n_shared": "bigint"}
    whole = dealt.where("not _among").select("doc_id", "more", F.array().cast(kinds["passages"]).alias("passages"), "text", F.lit(0).cast("bigint").alias("n_shared"))
    cut = dealt.where("_among").join(by_row, ["id", "n"], "left").select("doc_id", "more", "text", "spans")
    cut = map_arrow(cut, _cut(size), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    counted = [F.col("n_shared").alias(shared)] if shared else []
    return whole.unionByName(cut).select("doc_id", *(f"more.{c}" for c in more), "passages", *counted, "text")
