"""Multi-hop reads: walk edges along routes from many roots at once, then budget, fetch and page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xrel.functions.ranks import distributed_rank
from xrel.operators.edges import EdgeReader
from xrel.session import cut_lineage
from xrel.sources.entities import EntitySet, display_name

# Fixed value: default and largest number of rows in one result.
MAX_ITEMS = 50

IDS = ("request_id", "dst_id")


@dataclass(frozen=True)
class Route:
    """Hops written as `from.field->to`; no hops means the root itself."""

    to: str
    via: tuple[str, ...] = ()


def route(*hops: str) -> Route:
    return Route(hops[-1].split("->")[1], tuple(hops))


def hop_parts(hop: str) -> tuple[str, str, str]:
    source, to = hop.split("->")
    src_type, field = source.split(".", 1)
    return src_type, field, to


def root_select(requests: DataFrame, roots: DataFrame) -> DataFrame:
    """(request_id, dst_id) of the rows whose key a request names as `root_key`."""
    named = roots.select(F.col("external_key").alias("root_key"), F.col("id").alias("dst_id"))
    return requests.join(named, "root_key").select(*IDS)


def next_hop(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ends of the edges that leave the ids of each request."""
    step = edges.select("src_id", F.col("dst_id").alias("_to"))
    return (
        ids.join(step, ids["dst_id"] == step["src_id"]).select("request_id", F.col("_to").alias("dst_id")).distinct()
    )


def shared_hops(roots: DataFrame, routes: list[Route], read: EdgeReader) -> dict[tuple[str, ...], DataFrame]:
    """Ids after every distinct prefix of the routes, each worked out once.

    A prefix more than one step builds on is written out, so it is not computed again for each.
    """
    prefixes = sorted({r.via[:n] for r in routes for n in range(1, len(r.via) + 1)}, key=lambda p: (len(p), p))
    ends = [r.via for r in routes]
    users = {p: sum(q[:-1] == p for q in prefixes) + ends.count(p) for p in prefixes}
    reached: dict[tuple[str, ...], DataFrame] = {(): roots}
    for prefix in prefixes:
        src_type, field, _ = hop_parts(prefix[-1])
        ids = next_hop(reached[prefix[:-1]], read(src_type, field))
        reached[prefix] = cut_lineage(ids) if users[prefix] > 1 else ids
    return reached


def union_by_type(reached: dict[tuple[str, ...], DataFrame], routes: list[Route], types: list[str]) -> DataFrame:
    """Ids per request and target type (request_id, type_order, dst_type, dst_id), routes to one type united."""
    parts = []
    for order, t in enumerate(dict.fromkeys(types), start=1):
        ends = [reached[r.via].select(*IDS) for r in routes if r.to == t]
        if not ends:
            continue
        united = ends[0] if len(ends) == 1 else reduce(DataFrame.unionByName, ends).distinct()
        parts.append(united.select("request_id", F.lit(order).alias("type_order"), F.lit(t).alias("dst_type"), "dst_id"))
    return reduce(DataFrame.unionByName, parts)


def with_root(ids: DataFrame, roots: DataFrame, root_type: str) -> DataFrame:
    """Put the root in front of everything else, for requests that ask for it."""
    first = roots.select("request_id", F.lit(0).alias("type_order"), F.lit(root_type).alias("dst_type"), "dst_id")
    return ids.unionByName(first)


def item_limit(asked: int | None) -> int:
    return MAX_ITEMS if asked is None or not 0 <= asked <= MAX_ITEMS else asked


def budget(ids: DataFrame, max_items: int | None = None) -> DataFrame:
    """The first rows of each request, in order of type, then id.

    The limit on the row number lets each task keep its own first rows before the shuffle, so a
    request that reaches a large share of all ids sends only a few of them.
    """
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("type_order", "dst_id"))
    return ids.withColumn("place", place).where(F.col("place") <= item_limit(max_items))


def overflow(ids: DataFrame, included: DataFrame) -> DataFrame:
    """Ids beyond the budget."""
    return ids.join(included.select("request_id", "dst_type", "dst_id"), ["request_id", "dst_type", "dst_id"], "left_anti")


# The columns each type's items are ordered by, nulls last, then by id.
def _sort_order(dst_type: str) -> list[Column]:
    if dst_type == "competition":
        keys = ["start"]
    elif dst_type in ("event", "keyMoment"):
        keys = ["date_time"]
    elif dst_type in ("team", "venue", "club", "nation", "sgo", "sportsPerson", "staff"):
        keys = ["name"]
    elif dst_type == "ranking":
        keys = ["stage_id", "event_id", "ranking"]
    else:
        keys = []
    return [*(F.desc_nulls_last(k) for k in keys), F.asc("id")]


def sort_items(included: DataFrame, entities: EntitySet, types: list[str]) -> DataFrame:
    """Included rows with their place within request and type, and the header of the row itself."""
    parts = []
    for t in dict.fromkeys(types):
        wanted = included.where(F.col("dst_type") == t).select("request_id", "dst_type", "dst_id")
        rows = entities.rows(t).withColumn("name", display_name(t))
        rows = wanted.join(rows, wanted["dst_id"] == rows["id"])
        place = F.row_number().over(Window.partitionBy("request_id").orderBy(*_sort_order(t)))
        parts.append(rows.withColumn("position", place).select("request_id", "dst_type", "position", "id", "external_key", "name"))
    return reduce(DataFrame.unionByName, parts)


def materialise(included: DataFrame, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Full rows of each type named by the included ids."""
    out = {}
    for t, table in rows.items():
        wanted = included.where(F.col("dst_type") == t).select("request_id", "dst_id")
        out[t] = wanted.join(table, wanted["dst_id"] == table["id"]).drop("dst_id")
    return out


def result_shape(roots: DataFrame, included: DataFrame, rest: DataFrame, types: list[str], routes: list[Route]) -> DataFrame:
    """One row per request and asked type, zeros when nothing was found, with the hops used."""
    steps = {(len(r.via[:n]), r.via[n - 1]) for r in routes for n in range(1, len(r.via) + 1)}
    used = ",".join(f"{depth - 1}:{hop}" for depth, hop in sorted(steps))
    asked = roots.select(
        "request_id", F.col("dst_id").alias("root_id"), F.explode(F.array(*(F.lit(t) for t in types))).alias("dst_type")
    )
    items = included.groupBy("request_id", "dst_type").agg(F.count("*").alias("items"))
    more = rest.groupBy("request_id", "dst_type").agg(F.count("*").alias("overflow"))
    joined = asked.join(items, ["request_id", "dst_type"], "left").join(more, ["request_id", "dst_type"], "left")
    return joined.fillna(0, ["items", "overflow"]).withColumn("edges_used", F.lit(used))


def counts(ids: DataFrame) -> DataFrame:
    """Rows per request and type, and per request (dst_type null)."""
    grouped = ids.rollup("request_id", "dst_type").agg(F.count("*").alias("n"))
    return grouped.where(F.col("request_id").isNotNull())


def overflow_pages(rest: DataFrame, page_size: int, bucket_rows: int = 1_000_000) -> DataFrame:
    """Overflow ids in pages of `page_size`, each with the filter that reads it back."""
    size = max(1, page_size)
    ranked = distributed_rank(rest, ["request_id", "dst_type"], "dst_id", "rank", bucket_rows)
    term = F.concat(F.lit("_id==`"), F.col("dst_id"), F.lit("`"))
    pages = (
        ranked.withColumn("page", F.floor((F.col("rank") - 1) / F.lit(size)))
        .groupBy("request_id", "dst_type", "page")
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", term.alias("t")))).alias("_t"))
    )
    joined = F.array_join(F.col("_t")["t"], " ")
    text = F.when(F.col("n") > 1, F.concat(F.lit("(or "), joined, F.lit(")"))).otherwise(joined)
    return pages.select("request_id", "dst_type", "page", "n", text.alias("query"))


def views_normalise(requests: DataFrame, text: str = "views") -> DataFrame:
    """One row per view of a comma-separated list: trimmed, no blanks, the first of equal ones, in order."""
    views = F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: v != ""))
    others = [c for c in requests.columns if c != text]
    return requests.select(*others, F.posexplode(views).alias("view_no", "view"))


def root_keys(entities: EntitySet, types: list[str]) -> DataFrame:
    """Document key of every row of the given types."""
    parts = [entities.rows(t).select(F.lit(t).alias("root_type"), "id", F.col("external_key").alias("root_key")) for t in types]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Result:
    included: DataFrame
    overflow: DataFrame
    ids: DataFrame


def assemble(
    roots: DataFrame,
    root_type: str,
    routes: list[Route],
    types: list[str],
    read: EdgeReader,
    max_items: int | None = None,
) -> Result:
    """Walk, unite and budget for every (request_id, dst_id) in `roots`."""
    reached = shared_hops(roots, routes, read)
    ids = union_by_type(reached, routes, [t for t in types if t != root_type])
    if root_type in types:
        ids = with_root(ids, roots, root_type)
    # Read twice: once to pick the first rows, once for the rest.
    ids = cut_lineage(ids)
    included = budget(ids, max_items)
    return Result(included, overflow(ids, included), ids)
