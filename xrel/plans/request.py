"""One kind of read for many roots: views and edges as text in, items, counts and pages out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.operators import assemble as A
from xrel.operators import paths as P
from xrel.operators.edges import EdgeReader
from xrel.operators.lookup import strip_private
from xrel.operators.project import project
from xrel.operators.relations import TYPE_GRAPH, type_aliases, type_edges
from xrel.session import cut_lineage
from xrel.sources.entities import EntitySet


class BadRequest(ValueError):
    """The request cannot be served; `code` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Request:
    """`views`: wanted types, comma-separated, in order of budget. `edges`: type pairs to walk, or none to let
    routes be chosen. `include` and `exclude`: projection keys per type, `all` for every type."""

    root_type: str
    views: str
    edges: str | None = None
    max_items: int | None = None
    include: dict[str, list[str]] = field(default_factory=dict)
    exclude: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Response:
    # Rows of each type with their position within the request, without private columns.
    items: dict[str, DataFrame]
    limit: int
    shape: DataFrame
    counts: DataFrame
    pages: DataFrame
    routes: list[A.Route]


def wanted_types(views: str) -> list[str]:
    types = list(dict.fromkeys(v.strip() for v in views.split(",") if v.strip()))
    if not types:
        raise BadRequest("NO_VIEWS", "name at least one type")
    unknown = [t for t in types if t not in TYPE_GRAPH]
    if unknown:
        raise BadRequest("UNKNOWN_TYPE", ", ".join(unknown))
    return types


def choose_routes(spark, request: Request, types: list[str]) -> list[A.Route]:
    """Routes over the given edges if there are any, else the best one per type.

    The search runs over the type graph, so what comes to the driver is a few short rows.
    """
    graph = type_edges(spark)
    rows = []
    if request.edges:
        spec = spark.createDataFrame(
            [(1, request.root_type, request.edges, types)], "spec_id int, root string, edges string, views array<string>"
        )
        rows = P.allowed_edge_routes(spec, graph, type_aliases(spark)).orderBy("route_no").collect()
    if not rows:
        asked = spark.createDataFrame([(1, request.root_type, t) for t in types], "request_id int, root string, target string")
        found, errors = P.derive_routes(asked, graph, P.REQUEST_DEPTH)
        lost = [r.target for r in errors.collect()]
        if lost:
            raise BadRequest("UNREACHABLE_AUTO_ROUTE", ", ".join(sorted(lost)))
        rows = found.orderBy("target").collect()
    ends = {r.target for r in rows} | {request.root_type}
    missed = [t for t in types if t not in ends]
    if missed:
        raise BadRequest("UNREACHABLE_BY_ROUTES", ", ".join(missed))
    return [A.route(*r.via.split("|")) for r in rows]


def answer(entities: EntitySet, read: EdgeReader, roots: DataFrame, request: Request) -> Response:
    """Serve the request for every root, given as (request_id, root_key)."""
    types = wanted_types(request.views)
    if "keyMoment" in types and request.root_type != "event":
        raise BadRequest("KEY_MOMENT_ROOT", "key moments can only be read from an event")
    routes = choose_routes(roots.sparkSession, request, types)
    # Only rows of the wanted keys are read from here on.
    chosen = cut_lineage(A.root_select(roots, entities.rows(request.root_type)))
    got = A.assemble(chosen, request.root_type, routes, types, read, request.max_items)
    included, rest = cut_lineage(got.included), cut_lineage(got.overflow)
    items = {}
    places = A.sort_items(included, entities, types).select("request_id", "dst_type", "id", "position")
    for t, rows in A.materialise(included, {t: strip_private(entities.rows(t)) for t in types}).items():
        rows = rows.join(places.where(F.col("dst_type") == t).drop("dst_type"), ["request_id", "id"])
        include = [*request.include.get("all", []), *request.include.get(t, [])]
        exclude = [*request.exclude.get("all", []), *request.exclude.get(t, [])]
        items[t] = project(rows, ["request_id", "position", *include] if include else [], exclude)
    return Response(
        items,
        A.item_limit(request.max_items),
        A.result_shape(chosen, included, rest, types, routes),
        A.counts(got.ids),
        A.overflow_pages(rest, A.item_limit(request.max_items)),
        routes,
    )
