"""How far the vocabularies of sources diverge within a language (operator 12): counts in Arrow, exact integer sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow, stored
from xrel.llm.words import SLICE_BYTES, text_slices

# Everything in ASCII but letters lies between terms.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
# A task hands on its counts beyond this many different (group, term).
HELD_TERMS = 400_000
# Cells (terms by sources) of one block of a shard.
BLOCK_CELLS = 1 << 20
SHARDS = 512
_LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _parts(data: bytes, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, texts): the rows of a slice, a very long one cut between terms into parts of bounded size."""
    if len(data) <= 2 * SLICE_BYTES:
        yield np.arange(len(offsets) - 1), pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        return
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while lo < hi:
            end = hi
            size = SLICE_BYTES
            # A term longer than a part widens it until its end is found.
            while lo + size < hi:
                breaks = np.flatnonzero(~_LETTERS[np.frombuffer(data, np.uint8, size, lo)])
                if len(breaks):
                    end = lo + int(breaks[-1]) + 1
                    break
                size *= 2
            yield np.array([row]), pa.array([data[lo:end].decode()], pa.string())
            lo = end


def _terms(texts: pa.Array, rows: np.ndarray) -> pa.Table:
    """(row, term, n) of some texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN_TERMS)
    row = pa.array(rows[pc.list_parent_indices(lists).to_numpy()], pa.int64())
    codes = pc.dictionary_encode(pc.list_flatten(lists))
    counted = pa.table({"row": row, "code": codes.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    terms = codes.dictionary.take(counted["code"].combine_chunks())
    found = pa.table({"row": counted["row"], "term": terms, "n": counted["count_all"]})
    return found.filter(pc.not_equal(found["term"], ""))


def _merged(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    table = pa.concat_tables(tables)
    return table.group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*keys, "n", "docs"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), added up per task as long as they fit."""
    keys = ["lang", "source", "term"]
    held: list[pa.Table] = []
    size = 0

    def flush():
        out = _merged(held, keys) if held else None
        held.clear()
        return out.to_batches() if out is not None else []

    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        names = dict.fromkeys(pairs)
        code = dict(zip(names, range(len(names)), strict=True))
        group = np.array([code[p] for p in pairs])
        langs, sources = (pa.array([p[i] for p in names], pa.string()) for i in (0, 1))
        for at, _, data, offsets in text_slices(batch.column(2)):
            found = [_terms(texts, rows) for rows, texts in _parts(data, offsets)]
            per_row = pa.concat_tables(found)
            if len(found) > 1:
                per_row = per_row.group_by(["row", "term"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["row", "term", "n"])
            per_row = per_row.append_column("g", pa.array(group[at + per_row["row"].to_numpy()]))
            counted = per_row.group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            held.append(
                pa.table(
                    {
                        "lang": langs.take(counted["g"].combine_chunks()),
                        "source": sources.take(counted["g"].combine_chunks()),
                        "term": counted["term"],
                        "n": counted["n_sum"],
                        "docs": counted["n_count"],
                    }
                )
            )
            size += len(counted)
            if size > 2 * HELD_TERMS:
                held[:] = [_merged(held, keys)]
                size = len(held[0])
                if size > HELD_TERMS:
                    yield from flush()
                    size = 0
    yield from flush()


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), partly added up."""
    rows = docs.select(_text("lang"), _text("source"), _text("text"))
    return map_arrow(rows, _partial_counts, "lang string, source string, term string, n bigint, docs bigint")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact: whole numbers too large for 64 bits are taken as Python's."""
    if count.size and int(count.max()) >= (1 << 63) // SCALE - 2:
        return 1 + (SCALE * (count.astype(object) + 2) // total).astype(np.int64)
    return 1 + SCALE * (count + 2) // total


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Lang:
    """Running sums over the terms of one language within one shard.

    `held[a, b]` adds up the terms that source a has, whether b has them or not; `both` those that both have. So the
    terms that a or b has give held[a, b] + held[b, a] - both[a, b], with work per occurring cell instead of per cell.
    """

    def __init__(self, name: str, totals: dict[str, tuple[int, int, int]], top: int):
        self.name, self.top = name, top
        self.sources = sorted(totals, key=lambda s: s.encode())
        self.code = {s: i for i, s in enumerate(self.sources)}
        size = len(self.sources)
        self.total = np.array([totals[s][0] + 2 * totals[s][2] for s in self.sources], np.int64)
        self.lang_total = int(next(iter(totals.values()))[1] + 2 * next(iter(totals.values()))[2])
        self.held, self.both, self.n_both = (np.zeros((size, size), np.int64) for _ in range(3))
        self.n_held = np.zeros(size, np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in range(size)]

    def add(self, terms: list[str], term_no: np.ndarray, source_no: np.ndarray, n: np.ndarray) -> None:
        count = np.zeros((len(terms), len(self.sources)), np.int64)
        count[term_no, source_no] = n
        p = shares(count, self.total)
        q = shares(count.sum(axis=1), self.lang_total)
        for a in range(len(self.sources)):
            rows = np.flatnonzero(count[:, a])
            if not len(rows):
                continue
            mine = p[rows, a]
            f = divergences(mine[:, None], p[rows])
            shared = count[rows] > 0
            self.held[a] += f.sum(axis=0)
            self.both[a] += np.where(shared, f, 0).sum(axis=0)
            self.n_both[a] += shared.sum(axis=0)
            self.n_held[a] += len(rows)
            above = rows[mine > q[rows]]
            value = divergences(p[above, a], q[above])
            if len(above) > self.top:
                # All that tie with the last of the best are looked at, so that ties go by term.
                least = np.partition(value, len(value) - self.top)[len(value) - self.top]
                keep = value >= least
                above, value = above[keep], value[keep]
            new = [(-int(v), terms[t].encode()) for t, v in zip(above.tolist(), value.tolist(), strict=True)]
            self.best[a] = sorted(self.best[a] + new)[: self.top]

    def rows(self) -> Iterator[pa.RecordBatch]:
        size = len(self.sources)
        a, b = np.nonzero(~np.eye(size, dtype=bool))
        names = pa.array(self.sources, pa.string())
        lang = lambda k: pa.array([self.name] * k, pa.string())
        columns = ["lang", "source", "part", "item", "value", "n_terms"]
        if len(a):
            value = self.held[a, b] + self.held[b, a] - self.both[a, b]
            n = self.n_held[a] + self.n_held[b] - self.n_both[a, b]
            yield pa.RecordBatch.from_arrays(
                [lang(len(a)), names.take(pa.array(a)), pa.array(["pair"] * len(a)), names.take(pa.array(b)), pa.array(value), pa.array(n)], names=columns
            )
        best = [(s, t.decode(), -v) for s, found in zip(self.sources, self.best, strict=True) for v, t in found]
        if best:
            source, item, value = zip(*best, strict=True)
            k = len(best)
            yield pa.RecordBatch.from_arrays(
                [lang(k), pa.array(source), pa.array(["term"] * k), pa.array(item), pa.array(value, pa.int64()), pa.nulls(k, pa.int64())], names=columns
            )


def _shard_sums(top: int):
    """Sums over the rows of a shard, which come by language: first its groups with their totals, then terms in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang: _Lang | None = None
        name, totals, rest = None, {}, None

        def take(table: pa.Table, last: bool) -> pa.Table | None:
            """Whole terms of one language go to its sums, in blocks; what may go on in the next batch is given back."""
            nonlocal lang
            if lang is None and totals:
                lang = _Lang(name, totals, top)
            terms = pc.dictionary_encode(table["term"].combine_chunks())
            no = terms.indices.to_numpy()
            # In order of terms, numbers never fall, and the last term may not be whole yet.
            end = len(no) if last else int(np.searchsorted(no, no[-1]))
            source = np.array([lang.code[s] for s in table["source"].to_pylist()], np.int64)
            n, words = table["n"].to_numpy(), terms.dictionary.to_pylist()
            step = max(1, BLOCK_CELLS // len(lang.sources))
            for first in range(0, int(no[end - 1]) + 1 if end else 0, step):
                lo, hi = np.searchsorted(no[:end], [first, first + step])
                lang.add(words[first : first + step], no[lo:hi] - first, source[lo:hi], n[lo:hi])
            return table.slice(end) if end < len(no) else None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal lang, totals, rest
            if rest is not None:
                take(rest, True)
            if lang is not None:
                yield from lang.rows()
            lang, totals, rest = None, {}, None

        for batch in batches:
            table = pa.Table.from_batches([batch])
            langs = pc.run_end_encode(table["lang"].combine_chunks())
            at = 0
            for value, end in zip(langs.values.to_pylist(), langs.run_ends.to_pylist(), strict=True):
                if value != name:
                    yield from close()
                    name = value
                run = table.slice(at, end - at)
                at = end
                heads = run.filter(pc.is_null(run["term"]))
                for s, n, whole, kept in zip(*(heads[c].to_pylist() for c in ("source", "n", "lang_n", "n_kept")), strict=True):
                    totals[s] = n, whole, kept
                run = run.filter(pc.is_valid(run["term"]))
                if len(run):
                    rest = take(pa.concat_tables([rest, run]) if rest is not None else run, False)
        yield from close()

    return work


def source_divergences(docs: DataFrame, least_docs: int = 10, top: int = 10, shards: int = SHARDS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others and from the whole.

    Part `pair` has a row for every other source of the language, part `term` the `top` terms that are more frequent in
    the source than in the language. Terms are runs of letters and of characters beyond ASCII; a language keeps those in
    `least_docs` of its documents. All sums are whole numbers. Null lang, source and text count as empty; a group
    without terms is compared like any other; a language with one source has no pairs; an empty table gives no rows;
    repeated rows and ids are documents of their own; ties go by the UTF-8 bytes of the item; other columns are ignored.

    Counts are added up in each task before they are shuffled by (lang, term), so one source may hold any share of the
    rows. Terms are then dealt over shards, each with the totals of all groups of the languages it holds terms of.
    """
    # Dealt by (lang, term): the sums per source and per language need no further shuffle.
    dealt = term_counts(docs).repartition("lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = counts.withColumn("all_docs", in_docs).where(F.col("all_docs") >= least_docs)
    kept = stored(kept.select("lang", "term", "source", "n"), "terms")
    groups = docs.select(_text("lang"), _text("source")).distinct()
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    in_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.countDistinct("term").alias("n_kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    totals = stored(
        groups.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").select("lang", "source", zero("n"), zero("lang_n"), zero("n_kept")),
        "groups",
    )
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard")
    rows = kept.select("lang", shard, "term", "source", "n", F.lit(None).cast("bigint").alias("lang_n"), F.lit(None).cast("bigint").alias("n_kept"))
    heads = rows.select("lang", "shard").distinct().join(totals, "lang").select("lang", "shard", F.lit(None).cast("string").alias("term"), "source", "n", "lang_n", "n_kept")
    # A task may get several shards: a language then has its heads more than once, before all its terms.
    together = rows.unionByName(heads).repartition("shard").drop("shard").sortWithinPartitions("lang", F.col("term").asc_nulls_first(), "source")
    found = stored(
        map_arrow(together, _shard_sums(top), "lang string, source string, part string, item string, value bigint, n_terms bigint"), "divergences"
    )
    # Terms that neither source has differ only by the sizes of the two.
    share = lambda c: F.lit(1) + F.expr(f"cast({SCALE}L * 2 div ({c}.n + 2 * {c}.n_kept) as bigint)")
    a, b = totals.alias("a"), totals.alias("b")
    p, q = F.when(F.col("a.n_kept") > 0, share("a")), F.when(F.col("b.n_kept") > 0, share("b"))
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select(
        "a.lang", "a.source", F.col("b.source").alias("item"), "a.n_kept", p.alias("p"), q.alias("q")
    )
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms"))
    whole = pairs.join(sums, ["lang", "source", "item"], "left").select(
        "lang",
        "source",
        F.lit("pair").alias("part"),
        "item",
        F.coalesce(
            F.coalesce("value", F.lit(0)) + (F.col("n_kept") - F.coalesce("n_terms", F.lit(0))) * F.expr("(p - q) * (p - q) div (p + q)"), F.lit(0)
        ).alias("value"),
    )
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = whole.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
