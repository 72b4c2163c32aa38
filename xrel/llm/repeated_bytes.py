"""Suffix-array dedup (operator 6): later copies of byte strings go, found by longest-previous-factor arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow, stored, with_row_key
from xrel.llm.words import mix, text_slices

SIZE = 100
# Every string of SIZE bytes has an anchor: of all its runs of ANCHOR bytes, the first with the least hash.
ANCHOR = 32
SEGMENT = 1 << 20
# Strings at anchors with more different runs than this are grouped over all tasks instead of in one.
HOT = 4_000
CHUNK_BYTES = 1 << 20
# Repeated anchors are marked in a bit table that every task gets: so many bits each, and at most 64 MB in all.
BITS_PER_ANCHOR = 16
MOST_BITS = 1 << 29
_P = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(int(_P), -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_TABLES: list = []


def _prefixes(data: np.ndarray, base: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers before each place, and the inverse powers that move them to the start."""
    if not _TABLES:
        _TABLES.extend(_powers(SEGMENT + 2 * SIZE + 1))
    up, down = _TABLES
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(base)) * up[: len(data)], out=sums[1:])
    return sums, down


def run_hashes(data: np.ndarray, size: int, base: int = 1) -> np.ndarray:
    """A 64-bit hash of every run of `size` bytes."""
    sums, down = _prefixes(data, base)
    n = len(data) - size + 1
    return mix((sums[size:] - sums[:n]) * down[:n])


def anchor_runs(data: bytes, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first start, last start, anchor hash) of runs of strings of SIZE bytes with one anchor.

    Every string within a row lies in exactly one run, and equal strings have equal anchors.
    """
    raw = np.frombuffer(data, np.uint8)
    choices = SIZE - ANCHOR + 1
    for at in range(0, max(0, len(raw) - SIZE + 1), SEGMENT):
        hashes = run_hashes(raw[at : at + SEGMENT + SIZE - 1], ANCHOR)
        # The least hash, and the first place among equals.
        low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= choices:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (choices - span)], low[choices - span :])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = at + np.arange(len(anchor))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, at, at + len(anchor))))
        whole = np.flatnonzero(start + SIZE <= offsets[row + 1])
        if not len(whole):
            continue
        start, row, anchor = start[whole], row[whole], anchor[whole]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        # Cut to 48 bits: anchors that fall together by chance only bring strings together that need not be.
        short = (hashes[anchor[first]] & _SHORT).astype(np.int64)
        yield row[first], start[first] - offsets[row[first]], start[last] - offsets[row[first]], short


_SHORT = np.uint64((1 << 48) - 1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor of every run, and nothing else."""
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            for *_, anchors in anchor_runs(data, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(anchors)], names=["anchor"])


def _repeated_runs(table):
    """Runs whose anchor the bit table marks; `place` is n in the high half, then the start."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = table.value
        for batch in batches:
            ids, ns = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, data, offsets in text_slices(batch.column(2)):
                for row, first, last, anchors in anchor_runs(data, offsets):
                    at = anchors & (8 * len(marked) - 1)
                    own = np.flatnonzero((marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    row, first, last = row[own], first[own], last[own]
                    begin, end = (offsets[row] + first).tolist(), (offsets[row] + last + SIZE).tolist()
                    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True))
                    text = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors[own]),
                            pa.array(np.ascontiguousarray(text[:, 0])),
                            pa.array(np.ascontiguousarray(text[:, 1])),
                            pa.array(ids[lo + row]),
                            pa.array((ns[lo + row].astype(np.int64) << 32) | first),
                            pa.array((last - first).astype(np.int32)),
                        ],
                        names=["anchor", "text_a", "text_b", "id", "place", "more"],
                    )

    return find


def bit_table(repeated: DataFrame, n: int) -> np.ndarray:
    """A bit for each value that the low bits of the `n` anchors in `repeated` take, as bytes.

    Its size is a power of two, at least BITS_PER_ANCHOR bits an anchor while that is within MOST_BITS. A fuller table
    lets more single anchors through, which costs work and changes no result.
    """
    bits = min(MOST_BITS, 1 << max(15, (n * BITS_PER_ANCHOR - 1).bit_length()))
    at = F.col("anchor").bitwiseAND(bits - 1) + 1
    pages = repeated.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in pages.collect():
        own = np.frombuffer(row["bits"], np.uint8)
        out[(row["page"] - 1) * 4096 :][: len(own)] = own
    return out


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each run, in order of (anchor, text, id, place), is the first of its kind in this partition.

    The first run carries its kind in `edge`; a last row without a place carries the kind of the last run.
    """
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        if not len(batch):
            continue
        kinds = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        before = np.concatenate([kinds[:1] if last is None else last, kinds[:-1]])
        leads = (kinds != before).any(axis=1)
        edges = [None] * len(batch)
        if last is None:
            leads[0], edges[0] = True, kinds[0].tobytes()
        last = kinds[-1:]
        columns = [batch.column(k) for k in (0, 3, 4, 5)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(leads), pa.array(np.full(len(batch), part, np.int32)), pa.array(edges, pa.binary())], names=_JUDGED
        )
    if last is not None:
        own = ((int(last[0, 0]), pa.int64()), (None, pa.int64()), (None, pa.int64()), (None, pa.int32()), (None, pa.bool_()), (part, pa.int32()), (last.tobytes(), pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in own], names=_JUDGED)


_JUDGED = ["anchor", "id", "place", "more", "leads", "part", "edge"]


def judged_runs(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders, copies): runs that are the first with their anchor and text, and all others.

    Runs are put in order of (anchor, text, id, place) by a range shuffle, which also splits the copies of one run. A kind
    that goes on from one partition into the next is seen from the kinds at their edges: two rows of each partition
    reach the driver.
    """
    order = ("anchor", "text_a", "text_b", "id", "place")
    kind = "anchor bigint, id bigint, place bigint, more int, leads boolean, part int, edge binary"
    ordered = found.select(*order, "more").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(map_arrow(ordered, _leads, kind), "judged-runs")
    following, last = [], None
    for edge in sorted(rows.where("edge is not null").collect(), key=lambda r: (r.part, r.place is None)):
        if edge.place is None:
            last = bytes(edge.edge)
        elif bytes(edge.edge) == last:
            following.append((edge.id, edge.place, edge.more))
    follow = found.sparkSession.createDataFrame(following, "id bigint, place bigint, more int")
    leaders = rows.where("leads").join(F.broadcast(follow), ["id", "place"], "left_anti").select("anchor", "id", "place", "more")
    return leaders, rows.where("not leads").select("id", "place", "more").unionByName(follow)


def previous_factors(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Which of these places (ascending) begin SIZE bytes that begin at an earlier one too.

    The suffixes are sorted by their first SIZE bytes, by doubling ranks, equal ones by place. A suffix whose longest
    previous factor reaches SIZE lies in a run of equal ones; the entry before it is its previous smaller place in
    suffix order, and its next smaller place is beyond the run, where the common prefix is shorter.
    """
    raw = np.frombuffer(text + b"\0" * SIZE, np.uint8).astype(np.uint64)
    n = len(text)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | raw[k : n + k]
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    width = 8
    while width * 2 <= SIZE:
        rank = np.append(rank, np.zeros(width, np.uint64))
        pair = (rank[:n] << np.uint64(32)) | rank[width : n + width]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        width *= 2
    pair = (rank[starts] << np.uint64(32)) | rank[starts + (SIZE - width)]
    order = np.argsort(pair, kind="stable")
    ordered = pair[order]
    out = np.zeros(len(starts), bool)
    out[order[1:][ordered[1:] == ordered[:-1]]] = True
    return out


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every listed run; those without an anchor are cut into their strings of SIZE bytes."""
    for batch in batches:
        keys, ids, ns, firsts, texts = [], [], [], [], []
        size = 0

        def done():
            arrays = [pa.array(x, t) for x, t in ((keys, pa.int64()), (ids, pa.int64()), (ns, pa.int32()), (firsts, pa.int32()), (texts, pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "id", "n", "first", "string"])

        for i in range(len(batch)):
            id_, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            text = batch.column(3)[i].as_py().encode()
            for run in batch.column(4)[i].as_py():
                first, last, anchor = run["first"], run["last"], run["anchor"]
                for at, end in [(first, last)] if anchor is not None else zip(range(first, last + 1), range(first, last + 1), strict=True):
                    own = text[at : end + SIZE]
                    keys.append(anchor), ids.append(id_), ns.append(n), firsts.append(at), texts.append(own)
                    size += len(own)
                    if size > CHUNK_BYTES or len(keys) > 100_000:
                        yield done()
                        keys, ids, ns, firsts, texts, size = [], [], [], [], [], 0
        yield done()


def _marks_of(rows: list[tuple]) -> tuple[list, list, list, list]:
    """(id, n, begin, end) of removed bytes among strings (id, n, first, string), judged against one another."""
    rows.sort(key=lambda r: r[:3])
    seen: dict[bytes, int] = {}
    ids, ns, begins, ends = [], [], [], []
    kept = []
    for i, n, first, own in rows:
        if own in seen:
            # All of it is there before.
            ids.append(i), ns.append(n), begins.append(first), ends.append(first + len(own))
        else:
            seen[own] = len(kept)
            kept.append((i, n, first, own))
    if len(kept) > 1:
        sizes = np.array([len(r[3]) for r in kept])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        counts = sizes - SIZE + 1
        owner = np.repeat(np.arange(len(kept)), counts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        gone = np.flatnonzero(previous_factors(b"".join(r[3] for r in kept), offsets[owner] + inner))
        if len(gone):
            new = np.ones(len(gone), bool)
            new[1:] = (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(gone)) - 1
            for a, b in zip(gone[first].tolist(), gone[last].tolist(), strict=True):
                i, n, at, _ = kept[owner[a]]
                ids.append(i), ns.append(n), begins.append(at + int(inner[a])), ends.append(at + int(inner[b]) + SIZE)
    return ids, ns, begins, ends


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; chunks are cut between keys."""
    rows: list[tuple] = []
    size, key = 0, None
    for batch in batches:
        for k, i, n, first, own in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4)), strict=True):
            if k != key and size > CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _typed(_marks_of(rows)))), names=["id", "n", "begin", "end"])
                rows, size = [], 0
            key = k
            rows.append((i, n, first, own))
            size += len(own)
    yield pa.RecordBatch.from_arrays(list(map(pa.array, _typed(_marks_of(rows)))), names=["id", "n", "begin", "end"])


def _typed(marks: tuple[list, list, list, list]) -> list[np.ndarray]:
    return [np.array(x, t) for x, t in zip(marks, (np.int64, np.int32, np.int32, np.int32), strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digests = [], [], []
        for text, marks in zip(batch.column(2), batch.column(3), strict=True):
            data = (text.as_py() or "").encode()
            gone = merged([(m["begin"], m["end"]) for m in marks.as_py() or []])
            digest, at = hashlib.sha256(), 0
            for a, b in gone:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            removed.append([{"begin": a, "end": b} for a, b in gone])
            spans.append(sum(b - a for a, b in gone))
            digests.append(digest.hexdigest())
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.int64()), pa.array(removed, kind), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"],
        )


def removed_bytes(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, removed (maximal spans of bytes), kept_sha256.

    A byte goes if some string of SIZE bytes over it also starts earlier: in a row of smaller doc_id, or earlier in the
    same row. Texts are UTF-8; null and empty ones have no bytes. Rows without a doc_id come last, rows that repeat one
    in the order of their texts. Strings are judged on the input. Other columns are ignored.

    Strings are brought together by anchors, and runs of them around one anchor by 128-bit digests of their texts: runs
    that repeat go at once. Of anchors with different runs the first of each move, and their suffixes are sorted in
    chunks between anchors. At an anchor with over HOT different runs strings are grouped by their bytes instead, with
    the first place found by a least value that combines before it shuffles; the result is the same.
    """
    rows = with_row_key(docs).select("id", F.col("n").cast("int").alias("n"), "doc_id", "text")
    long_enough = rows.where(F.octet_length("text") >= SIZE)
    anchors = map_arrow(long_enough.select("text"), _anchors, "anchor bigint")
    repeated = stored(anchors.groupBy("anchor").agg(F.count("*").alias("count")).where("count > 1").select("anchor"), "repeated-anchors")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(repeated, repeated.count()))
    found = map_arrow(
        long_enough.select("id", "n", "text"), _repeated_runs(table),
        "anchor bigint, text_a bigint, text_b bigint, id bigint, place bigint, more int",
    )
    # Of equal runs only the first can hold a first string; the others go as a whole. Where an anchor has different
    # runs, the first of each are compared string by string.
    leaders, copies = judged_runs(stored(found, "repeated-runs"))
    kinds = leaders.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unlike = stored(leaders.join(kinds, "anchor"), "different-runs")
    many = unlike.where(F.col("kinds") > HOT).withColumn("anchor", F.lit(None).cast("bigint"))
    n, first = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")
    listed = F.struct(first.alias("first"), (first + F.col("more")).alias("last"), "anchor")

    def strings(runs: DataFrame) -> DataFrame:
        by_row = runs.groupBy("id", n.alias("n")).agg(F.collect_list(listed).alias("runs"))
        # All columns of rows, so that this join and the last one can share one exchange of texts.
        meeting = rows.join(by_row, ["id", "n"]).select("id", "n", "doc_id", "text", "runs")
        return map_arrow(meeting, _strings, "key bigint, id bigint, n int, first int, string binary")

    whole = copies.select("id", n.alias("n"), first.alias("begin"), (first + F.col("more") + SIZE).alias("end"))
    plain = strings(unlike.where(F.col("kinds") <= HOT)).repartition("key").sortWithinPartitions("key")
    gone = whole.unionByName(map_arrow(plain, _marks, "id bigint, n int, begin int, end int"))
    if not many.isEmpty():
        hot = strings(many).select("string", F.struct("id", "n", "first").alias("place"))
        origin = hot.groupBy("string").agg(F.min("place").alias("origin"), F.count("*").alias("count")).where("count > 1")
        again = hot.join(origin.drop("count"), "string").where("place <> origin")
        gone = gone.unionByName(
            again.select("place.id", "place.n", F.col("place.first").alias("begin"), (F.col("place.first") + SIZE).alias("end"))
        )
    by_row = gone.groupBy("id", "n").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    final = rows.join(by_row, ["id", "n"], "left").select("doc_id", n_bytes, "text", "marks")
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<begin:int,end:int>>, kept_sha256 string"
    return map_arrow(final, _kept, kind)
