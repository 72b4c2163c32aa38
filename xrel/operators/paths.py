"""Route search over a graph of (from_type, field, to_type) rows, by repeated joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xrel.operators.relations import SCOPED_TYPES
from xrel.session import cut_lineage

# Limits of a served request. As parameters of a search they may be None: simple paths end by themselves.
DERIVED_DEPTH = 6
REQUEST_DEPTH = 8
EDGE_SET_DEPTH = 12
EDGE_SET_ROUTES = 2000


def hop_text() -> Column:
    return F.expr("concat(from_type, '.', field, '->', to_type)")


def reachable_types(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, type) for every node a root reaches, itself included. `roots` has one column, root."""
    step = graph.select("from_type", "to_type").distinct()
    seen = frontier = cut_lineage(roots.select("root", F.col("root").alias("type")).distinct())
    while True:
        found = frontier.join(step, F.col("type") == F.col("from_type")).select("root", F.col("to_type").alias("type"))
        frontier = cut_lineage(found.distinct().join(seen, ["root", "type"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(frontier))


# Which nodes are scoped: their names, or a rule on the name.
Scope = tuple[str, ...] | Callable[[Column], Column]


def _scoped(node: str, scoped: Scope) -> Column:
    return scoped(F.col(node)) if callable(scoped) else F.col(node).isin(*scoped)


def _start(roots: DataFrame, *carried: str) -> DataFrame:
    return roots.select(
        *carried,
        "root",
        F.col("root").alias("target"),
        F.array("root").alias("visited"),
        F.lit(0).alias("hops"),
        F.lit(0).alias("toggles"),
        F.lit("").alias("path"),
    )


def _extend(level: DataFrame, graph: DataFrame, on: Column, scoped: Scope, *carried: str) -> DataFrame:
    """One hop further along edges to nodes not yet on the path."""
    crosses = (_scoped("from_type", scoped) != _scoped("to_type", scoped)).cast("int")
    return (
        level.join(graph, on)
        .where(~F.array_contains("visited", F.col("to_type")))
        .select(
            *carried,
            "root",
            F.col("to_type").alias("target"),
            F.concat("visited", F.array("to_type")).alias("visited"),
            (F.col("hops") + 1).alias("hops"),
            (F.col("toggles") + crosses).alias("toggles"),
            F.concat("path", F.when(F.col("hops") > 0, F.lit("|")).otherwise(F.lit("")), hop_text()).alias("path"),
        )
    )


def constrained_paths(
    graph: DataFrame, roots: DataFrame, max_depth: int | None = DERIVED_DEPTH, scoped: Scope = SCOPED_TYPES
) -> DataFrame:
    """All simple paths from each root, of up to `max_depth` hops, with their end as `target`.

    From a scoped root a path may not go from an unscoped to a scoped node; from an unscoped root
    it may not go from one scoped node to another.
    """
    root, src, dst = (_scoped(c, scoped) for c in ("root", "from_type", "to_type"))
    allowed = F.when(root, src | ~dst).otherwise(~(src & dst))
    at_end = F.col("target") == F.col("from_type")
    level = _start(roots.select("root").distinct())
    found = []
    while max_depth is None or len(found) < max_depth:
        level = cut_lineage(_extend(level, graph, at_end & allowed, scoped))
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found) if found else level


def best_paths(paths: DataFrame) -> DataFrame:
    """Per root and target the path with the fewest scope changes, then hops, then first in text order."""
    first = F.min_by(F.struct("toggles", "hops", "path"), F.struct("toggles", "hops", "path")).alias("b")
    return paths.groupBy("root", "target").agg(first).select("root", "target", "b.*")


def derive_routes(
    requests: DataFrame, graph: DataFrame, max_depth: int | None = DERIVED_DEPTH, scoped: Scope = SCOPED_TYPES
) -> tuple[DataFrame, DataFrame]:
    """Routes and errors for requests of (request_id, root, target). A root asked for itself needs no route."""
    asked = requests.where(F.col("root") != F.col("target"))
    best = cut_lineage(best_paths(constrained_paths(graph, asked.select("root"), max_depth, scoped)))
    key = F.concat("target", F.lit("_"), F.col("hops").cast("string"), F.lit("hops"))
    routes = asked.join(best, ["root", "target"]).select(
        "request_id", "root", "target", key.alias("route_key"), "hops", F.col("path").alias("via")
    )
    errors = asked.join(best, ["root", "target"], "left_anti").withColumn("error", F.lit("UNREACHABLE_AUTO_ROUTE"))
    return routes, errors


def allowed_edges(specs: DataFrame, graph: DataFrame, aliases: DataFrame) -> DataFrame:
    """Graph edges named by `edges`, a comma-separated list of type pairs; what names no edge is left out.

    Only the keys of `specs` (spec_id, root, views) are carried.
    """
    pairs = specs.select("spec_id", F.explode(F.split("edges", ",")).alias("pair"))
    parts = F.split(F.trim("pair"), r"\.")
    named = pairs.where(F.size(parts) == 2).select(
        "spec_id", F.lower(F.trim(parts[0])).alias("_from"), F.lower(F.trim(parts[1])).alias("_to")
    )
    sources = aliases.select(F.col("alias").alias("_from"), F.col("type").alias("from_type"))
    targets = aliases.select(F.col("alias").alias("_to"), F.col("type").alias("to_type"))
    return (
        named.join(sources, "_from").join(targets, "_to").join(graph, ["from_type", "to_type"])
        .select("spec_id", "from_type", "field", "to_type").distinct()
    )


def allowed_edge_routes(
    specs: DataFrame,
    graph: DataFrame,
    aliases: DataFrame,
    max_depth: int | None = EDGE_SET_DEPTH,
    max_routes: int | None = EDGE_SET_ROUTES,
) -> DataFrame:
    """All simple routes from `root` over the allowed edges that end on one of `views` (an array).

    Specs are (spec_id, root, edges, views). Routes are numbered by depth and text; those numbered above `max_routes`
    are not returned, and `n_routes` says how many there were within the depth.
    """
    edges = cut_lineage(allowed_edges(specs, graph, aliases).withColumnRenamed("spec_id", "_spec"))
    level = _start(specs, "spec_id")
    at_end = F.expr("spec_id = _spec and target = from_type")
    found = []
    while max_depth is None or len(found) < max_depth:
        level = cut_lineage(_extend(level, edges, at_end, SCOPED_TYPES, "spec_id"))
        if level.isEmpty():
            break
        found.append(level)
    paths = reduce(DataFrame.unionByName, found) if found else level
    wanted = specs.select("spec_id", F.explode("views").alias("target")).distinct()
    number = F.row_number().over(Window.partitionBy("spec_id").orderBy("hops", "path"))
    key = F.concat("target", F.lit("_"), F.substring(F.sha2("path", 256), 1, 8))
    total = F.count("*").over(Window.partitionBy("spec_id"))
    numbered = paths.join(wanted, ["spec_id", "target"]).withColumns({"route_no": number, "n_routes": total})
    kept = numbered if max_routes is None else numbered.where(F.col("route_no") <= max_routes)
    return kept.select("spec_id", "route_no", "n_routes", "root", "target", key.alias("route_key"), "hops", F.col("path").alias("via"))


def validate_routes(routes: DataFrame, graph: DataFrame) -> DataFrame:
    """The first fault of each route as (route_key, hop_no, reason); sound routes give no row.

    Routes are (route_key, root, target, via), `via` being an array of `from.field->to`.
    """
    hops = routes.select(
        "route_key", "root", "target", F.size("via").alias("n_hops"), F.posexplode_outer("via").alias("hop_no", "hop")
    )
    parsed = hops.withColumns(
        {
            "from_type": F.regexp_extract("hop", r"^([^.]+)\.(.*?)->(.+)$", 1),
            "field": F.regexp_extract("hop", r"^([^.]+)\.(.*?)->(.+)$", 2),
            "to_type": F.regexp_extract("hop", r"^([^.]+)\.(.*?)->(.+)$", 3),
        }
    )
    along = Window.partitionBy("route_key").orderBy("hop_no")
    declared = graph.select("from_type", "field", F.col("to_type").alias("declared_to"))
    checked = parsed.withColumns(
        {
            "expected": F.coalesce(F.lag("to_type").over(along), F.col("root")),
            "times_used": F.row_number().over(Window.partitionBy("route_key", "hop").orderBy("hop_no")),
            "times_reached": F.row_number().over(Window.partitionBy("route_key", "to_type").orderBy("hop_no")),
        }
    ).join(declared, ["from_type", "field"], "left")
    is_last = F.col("hop_no") == F.col("n_hops") - 1
    fault = (
        F.when(F.coalesce(F.col("n_hops"), F.lit(0)) <= 0, "empty")
        .when(F.col("from_type") == "", "bad_edge")
        .when(F.col("from_type") != F.col("expected"), "non_contiguous")
        .when(F.col("declared_to").isNull(), "unknown_edge")
        .when(F.col("declared_to") != F.col("to_type"), "wrong_target")
        .when(F.col("times_used") > 1, "duplicate_edge")
        .when((F.col("to_type") == F.col("root")) | (F.col("times_reached") > 1), "cycle")
        .when(is_last & (F.col("to_type") != F.col("target")), "wrong_end")
    )
    at = F.coalesce("hop_no", F.lit(0))
    return (
        checked.select("route_key", at.alias("hop_no"), fault.alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("route_key")
        .agg(F.min("hop_no").alias("hop_no"), F.min_by("reason", "hop_no").alias("reason"))
    )


def reachability_check(requests: DataFrame, graph: DataFrame, routes: DataFrame) -> DataFrame:
    """Requested types that cannot be served: (request_id, root, type, reason).

    `requests`: (request_id, root, type). `routes`: (request_id, type) a request's routes end on.
    """
    reach = reachable_types(graph, requests.select("root").distinct())
    by_graph = requests.join(reach, ["root", "type"], "left_anti")
    other = requests.join(reach, ["root", "type"], "left_semi").where(F.col("type") != F.col("root"))
    by_routes = other.join(routes, ["request_id", "type"], "left_anti")
    columns = ["request_id", "root", "type"]
    return by_graph.select(*columns, F.lit("UNREACHABLE_BY_GRAPH").alias("reason")).unionByName(
        by_routes.select(*columns, F.lit("UNREACHABLE_BY_ROUTES").alias("reason"))
    )


def key_moment_rule(requests: DataFrame) -> DataFrame:
    """Requests (root, view) that ask for key moments from anything but an event."""
    asks = F.lower(F.trim("view")) == "keymoment"
    return requests.where(asks & (F.lower("root") != "event"))
