"""Route search over graphs that come from the tables: who orders what, from where, and how urgently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.operators import paths as P
from xrel.operators.edges import all_edges
from xrel.operators.relations import TYPE_GRAPH, type_edges
from xrel.plans import oracle
from xrel.plans.registry import register
from xrel.session import cut_lineage
from xrel.sources import tpch

_TYPE_GRAPH_SQL = "select * from (values " + ", ".join(
    f"('{s}', '{f}', '{t}')" for s, fields in TYPE_GRAPH.items() for f, t in fields.items()
) + ") g(from_type, field, to_type)"

# Nodes are named kind:value; a field is named after the node it leads to.
_LINKS_SQL = (
    "select distinct 'region:' || n_regionkey as from_type, 'nation:' || n_nationkey as to_type from nation union "
    "select distinct 'nation:' || c_nationkey, 'segment:' || c_mktsegment from customer union "
    "select distinct 'segment:' || c_mktsegment, 'priority:' || o_orderpriority from orders join customer on o_custkey = c_custkey union "
    "select distinct 'priority:' || o_orderpriority, 'region:' || n_regionkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
)
_GRAPH_SQL = f"select from_type, replace(to_type, ':', '_') as field, to_type from ({_LINKS_SQL})"
# Every customer asks from its region for its segment, its nation, the priority of urgent orders, or what nobody has.
_REQUESTS_SQL = (
    "select c_custkey as request_id, 'region:' || n_regionkey as root, case c_custkey % 4 when 0 then 'segment:' || c_mktsegment "
    "when 1 then 'nation:' || c_nationkey when 2 then 'priority:' || coalesce(p, 'none') else 'segment:' || upper(c_name) end as target "
    "from customer join nation on c_nationkey = n_nationkey left join (select o_custkey, min(o_orderpriority) as p from orders group by 1) on o_custkey = c_custkey"
)


def _graph(spark, sf_dir) -> DataFrame:
    nations = tpch.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customers = tpch.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    orders = tpch.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "c_nationkey", "o_orderpriority").distinct()
    links = (
        nations.select(node("region", "n_regionkey").alias("from_type"), node("nation", "n_nationkey").alias("to_type"))
        .union(customers.select(node("nation", "c_nationkey"), node("segment", "c_mktsegment")))
        .union(bought.select(node("segment", "c_mktsegment"), node("priority", "o_orderpriority")))
        .union(bought.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(node("priority", "o_orderpriority"), node("region", "n_regionkey")))
        .distinct()
    )
    # Read once per hop.
    return cut_lineage(links.select("from_type", F.replace("to_type", F.lit(":"), F.lit("_")).alias("field"), "to_type"))


def _requests(spark, sf_dir) -> DataFrame:
    nations = tpch.table(spark, sf_dir, "nation")
    customers = tpch.table(spark, sf_dir, "customer")
    first = tpch.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"))
    turn = F.col("c_custkey") % 4
    target = (
        F.when(turn == 0, F.concat(F.lit("segment:"), "c_mktsegment"))
        .when(turn == 1, F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")))
        .when(turn == 2, F.concat(F.lit("priority:"), F.coalesce("p", F.lit("none"))))
        .otherwise(F.concat(F.lit("segment:"), F.upper("c_name")))
    )
    return (
        customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(first, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("root"), target.alias("target"))
    )


def _of_orders(node: Column) -> Column:
    """Nodes on the side of the orders are scoped."""
    return node.startswith("segment:") | node.startswith("priority:")


def _scoped_sql(node: str) -> str:
    return f"regexp_matches({node}, '^(segment|priority):')"


def _paths_sql(depth: int) -> str:
    root, src, dst = (_scoped_sql(c) for c in ("p.root", "g.from_type", "g.to_type"))
    return (
        f"select root, root as target, [root] as visited, 0 as hops, 0 as toggles, '' as path from (select distinct root from r_requests) "
        f"union all select p.root, g.to_type, list_append(p.visited, g.to_type), p.hops + 1, "
        f"p.toggles + case when {src} <> {dst} then 1 else 0 end, "
        f"p.path || case when p.hops > 0 then '|' else '' end || g.from_type || '.' || g.field || '->' || g.to_type "
        f"from r_paths p join r_graph g on p.target = g.from_type where p.hops < {depth} and not list_contains(p.visited, g.to_type) "
        f"and case when {root} then {src} or not {dst} else not ({src} and {dst}) end"
    )


def _route_parts(depth: int = P.DERIVED_DEPTH) -> dict[str, str]:
    return {
        "r_graph": _GRAPH_SQL,
        "r_requests": _REQUESTS_SQL,
        "r_paths": _paths_sql(depth),
        "r_best": "select * from (select *, row_number() over (partition by root, target order by toggles, hops, path) as rn from r_paths where hops > 0) where rn = 1",
    }


@register(
    "type_edges",
    oracle.query(
        "select g.from_type, g.field, g.to_type, count(e.src_id) as n from r_graph g left join all_edges e "
        "on e.src_type = g.from_type and e.field = g.field group by all",
        r_graph=_TYPE_GRAPH_SQL,
    ),
)
def type_edges_query(spark, sf_dir):
    """Declared edges with the number of rows behind each."""
    seen = all_edges(tpch.entities(spark, sf_dir)).groupBy(F.col("src_type").alias("from_type"), "field").agg(F.count("*").alias("n"))
    return type_edges(spark).join(seen, ["from_type", "field"], "left").fillna(0, ["n"])


_ALIAS_SQL = (
    "select distinct lower(c_mktsegment) as alias, 'segment:' || c_mktsegment as type from customer union "
    "select distinct lower(c_mktsegment[1:2]), 'segment:' || c_mktsegment from customer"
)


def _aliases(spark, sf_dir) -> DataFrame:
    """Every accepted spelling of a segment, in lower case: its name, and its first two letters."""
    segments = tpch.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    spelled = F.explode(F.array(F.lower("c_mktsegment"), F.lower(F.substring("c_mktsegment", 1, 2))))
    return segments.select(spelled.alias("alias"), F.concat(F.lit("segment:"), "c_mktsegment").alias("type")).distinct()


@register(
    "type_alias",
    oracle.query(
        "select c_custkey, spelled, type from (select c_custkey, case c_custkey % 4 when 0 then lower(c_mktsegment) when 1 then c_mktsegment[1:2] "
        "when 2 then c_name else c_mktsegment end as spelled from customer) left join r_alias on lower(spelled) = alias",
        r_alias=_ALIAS_SQL,
    ),
)
def type_alias_query(spark, sf_dir):
    turn = F.col("c_custkey") % 4
    spelled = F.when(turn == 0, F.lower("c_mktsegment")).when(turn == 1, F.substring("c_mktsegment", 1, 2)).when(turn == 2, F.col("c_name"))
    rows = tpch.table(spark, sf_dir, "customer").select("c_custkey", spelled.otherwise(F.col("c_mktsegment")).alias("spelled"))
    return rows.join(_aliases(spark, sf_dir), F.lower("spelled") == F.col("alias"), "left").select("c_custkey", "spelled", "type")


@register(
    "reachable_types",
    oracle.query(
        "select q.request_id, q.root, x.target, x.root is not null as reached from r_requests q left join "
        "(select distinct root, target from r_reach) x on x.root = q.root and x.target = q.target".replace("x.target, x.root", "q.target, x.root"),
        r_graph=_GRAPH_SQL,
        r_requests=_REQUESTS_SQL,
        r_reach="select root, root as target from (select distinct root from r_requests) union select p.root, g.to_type from r_reach p join r_graph g on p.target = g.from_type",
    ),
)
def reachable_types(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    reach = P.reachable_types(_graph(spark, sf_dir), requests.select("root").distinct())
    reach = reach.select("root", F.col("type").alias("target"), F.lit(True).alias("reached"))
    return requests.join(reach, ["root", "target"], "left").fillna(False, ["reached"])


@register(
    "constrained_paths",
    oracle.query(
        "select q.request_id, q.root, q.target, count(p.path) as n, min(p.hops)::bigint as fewest, max(p.hops)::bigint as most, min(p.path) as first_path "
        "from r_requests q left join (select * from r_paths where hops > 0) p on p.root = q.root and p.target = q.target group by all",
        **_route_parts(),
    ),
)
def constrained_paths(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    found = P.constrained_paths(_graph(spark, sf_dir), requests, scoped=_of_orders).groupBy("root", "target").agg(
        F.count("*").alias("n"), F.min("hops").cast("bigint").alias("fewest"),
        F.max("hops").cast("bigint").alias("most"), F.min("path").alias("first_path"),
    )
    return requests.join(found, ["root", "target"], "left").fillna(0, ["n"])


@register(
    "best_path",
    oracle.query(
        "select q.request_id, q.root, q.target, b.toggles::int as toggles, b.hops::int as hops, b.path from r_requests q join r_best b on b.root = q.root and b.target = q.target",
        **_route_parts(P.REQUEST_DEPTH),
    ),
)
def best_path(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    best = P.best_paths(P.constrained_paths(_graph(spark, sf_dir), requests, P.REQUEST_DEPTH, _of_orders))
    return requests.join(best, ["root", "target"])


@register(
    "derive_routes",
    oracle.query(
        "select q.request_id, q.root, q.target, b.target || '_' || b.hops || 'hops' as route_key, b.path as via, "
        "case when b.path is null then 'UNREACHABLE_AUTO_ROUTE' end as error from r_requests q left join r_best b "
        "on b.root = q.root and b.target = q.target where q.root <> q.target",
        **_route_parts(),
    ),
)
def derive_routes(spark, sf_dir):
    routes, errors = P.derive_routes(_requests(spark, sf_dir), _graph(spark, sf_dir), scoped=_of_orders)
    return routes.drop("hops").unionByName(errors, allowMissingColumns=True)


# One list of allowed edges per nation, as text: from its region to it, on to its segments and their priorities, and a
# part that names no edge. Its customers' segments and the priorities of their orders are wanted.
_SPEC_SQL = (
    "select n_nationkey as spec_id, 'region:' || n_regionkey as root, "
    "'no edge,region:' || n_regionkey || ' . NATION:' || n_nationkey || ',' || (select string_agg(from_type || '.' || to_type, ',') from r_graph g "
    "where g.from_type = 'nation:' || n_nationkey or g.from_type like 'segment:%') as edges, "
    "(select list(distinct to_type) from r_graph g where g.from_type = 'nation:' || n_nationkey or g.to_type like 'priority:%') as views from nation"
)
_ALLOWED_PARTS = {
    "r_graph": _GRAPH_SQL,
    "r_alias": "select distinct lower(from_type) as alias, from_type as type from r_graph union select distinct lower(to_type), to_type from r_graph",
    "r_spec": _SPEC_SQL,
    "r_pair": "select spec_id, string_split(trim(unnest(string_split(edges, ','))), '.') as p from r_spec",
    "r_allowed": "select distinct spec_id, g.from_type, g.field, g.to_type from r_pair join r_alias a on lower(trim(p[1])) = a.alias "
    "join r_alias b on lower(trim(p[2])) = b.alias join r_graph g on g.from_type = a.type and g.to_type = b.type where len(p) = 2",
    "r_walk": "select spec_id, root, root as target, [root] as visited, 0 as hops, '' as path from r_spec union all "
    "select w.spec_id, w.root, g.to_type, list_append(w.visited, g.to_type), w.hops + 1, "
    "w.path || case when w.hops > 0 then '|' else '' end || g.from_type || '.' || g.field || '->' || g.to_type "
    "from r_walk w join r_allowed g on g.spec_id = w.spec_id and g.from_type = w.target where not list_contains(w.visited, g.to_type)",
    "r_ends": "select w.*, row_number() over (partition by w.spec_id order by hops, path) as route_no, count(*) over (partition by w.spec_id) as n_routes "
    "from r_walk w join r_spec s on s.spec_id = w.spec_id and list_contains(s.views, w.target) where hops > 0",
}


@register(
    "allowed_edge_routes",
    oracle.query(
        "select spec_id, route_no, n_routes, root, target, target || '_' || substr(sha256(path), 1, 8) as route_key, hops::int as hops, path as via from r_ends",
        **_ALLOWED_PARTS,
    ),
)
def allowed_edge_routes(spark, sf_dir):
    """Routes of every nation's list, without limits."""
    graph = _graph(spark, sf_dir)
    nodes = graph.select(F.col("from_type").alias("type")).union(graph.select("to_type")).distinct()
    nations = tpch.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("spec_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("nation"),
        F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("root"),
    )
    # A nation has a few segments, and they a few priorities.
    own = graph.select(F.col("from_type").alias("nation"), F.concat_ws(".", "from_type", "to_type").alias("pair"), F.col("to_type").alias("view"))
    shared = graph.where(F.col("from_type").startswith("segment:")).agg(F.array_join(F.collect_set(F.concat_ws(".", "from_type", "to_type")), ",").alias("shared"))
    wanted = graph.where(F.col("to_type").startswith("priority:")).agg(F.collect_set("to_type").alias("wanted"))
    mine = own.groupBy("nation").agg(F.array_join(F.collect_list("pair"), ",").alias("pairs"), F.collect_set("view").alias("views"))
    specs = nations.join(mine, "nation", "left").join(F.broadcast(shared)).join(F.broadcast(wanted)).select(
        "spec_id", "root",
        F.concat_ws(",", F.lit("no edge"), F.concat("root", F.lit(" . "), F.regexp_replace("nation", "nation", "NATION")), "pairs", "shared").alias("edges"),
        F.array_distinct(F.concat(F.coalesce("views", F.array().cast("array<string>")), "wanted")).alias("views"),
    )
    aliases = nodes.select(F.lower("type").alias("alias"), "type")
    routes = P.allowed_edge_routes(cut_lineage(specs), graph, aliases, None, None)
    return routes.withColumn("route_no", F.col("route_no").cast("bigint"))


# Every order's route from its region to its priority, most of them spoilt in some way by its number.
_CANDIDATES_SQL = (
    "select o_orderkey as route_key, root, case o_orderkey % 8 when 5 then b else d end as target, case o_orderkey % 8 "
    "when 1 then [root || '.' || replace(b, ':', '_') || '->' || b, c || '.' || replace(d, ':', '_') || '->' || d] "
    "when 2 then [root || '.' || replace(b, ':', '_') || '->' || b, b || '.segment->' || c] "
    "when 3 then [root || '.' || replace(b, ':', '_') || '->' || c] when 4 then [] "
    "when 6 then [h1, h2, h3, d || '.' || replace(root, ':', '_') || '->' || root] when 7 then [h1, replace(h2, '.', ' '), h3] "
    "else [h1, h2, h3] end::varchar[] as via from (select *, root || '.' || replace(b, ':', '_') || '->' || b as h1, "
    "b || '.' || replace(c, ':', '_') || '->' || c as h2, c || '.' || replace(d, ':', '_') || '->' || d as h3 from "
    "(select o_orderkey, 'region:' || n_regionkey as root, 'nation:' || c_nationkey as b, 'segment:' || c_mktsegment as c, 'priority:' || o_orderpriority as d "
    "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey))"
)


def _route_candidates(spark, sf_dir) -> DataFrame:
    orders = tpch.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = tpch.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = tpch.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "o_orderkey", node("region", "n_regionkey").alias("root"), node("nation", "c_nationkey").alias("b"),
        node("segment", "c_mktsegment").alias("c"), node("priority", "o_orderpriority").alias("d"),
    )
    hop = lambda a, b, to=None: F.concat(a, F.lit("."), F.replace(F.col(b), F.lit(":"), F.lit("_")), F.lit("->"), to or b)
    h1, h2, h3 = hop("root", "b"), hop("b", "c"), hop("c", "d")
    turn = F.col("o_orderkey") % 8
    via = (
        F.when(turn == 1, F.array(h1, h3))
        .when(turn == 2, F.array(h1, F.concat("b", F.lit(".segment->"), "c")))
        .when(turn == 3, F.array(hop("root", "b", "c")))
        .when(turn == 4, F.array().cast("array<string>"))
        .when(turn == 6, F.array(h1, h2, h3, hop("d", "root")))
        .when(turn == 7, F.array(h1, F.replace(h2, F.lit("."), F.lit(" ")), h3))
        .otherwise(F.array(h1, h2, h3))
    )
    target = F.when(turn == 5, F.col("b")).otherwise(F.col("d"))
    return rows.select(F.col("o_orderkey").alias("route_key"), "root", target.alias("target"), via.alias("via"))


@register(
    "validate_routes",
    oracle.query(
        "select route_key, min(hop_no)::int as hop_no, arg_min(reason, hop_no) as reason from r_faults where reason is not null group by 1",
        r_graph=_GRAPH_SQL,
        r_routes=_CANDIDATES_SQL,
        r_hops="select route_key, root, target, len(via) as n, i - 1 as hop_no, regexp_extract(via[i], '^([^.]+)\\.(.*?)->(.+)$', ['f', 'field', 't']) as h, via[i] as hop "
        "from (select *, unnest(range(1, len(via) + 1)) as i from r_routes)".replace("\\\\", "\\"),
        r_seen="select *, coalesce(lag(h.t) over (partition by route_key order by hop_no), root) as expected, "
        "row_number() over (partition by route_key, hop order by hop_no) as used, row_number() over (partition by route_key, h.t order by hop_no) as reached from r_hops",
        r_faults="select route_key, hop_no, case when h.f = '' then 'bad_edge' when h.f <> expected then 'non_contiguous' when g.to_type is null then 'unknown_edge' "
        "when g.to_type <> h.t then 'wrong_target' when used > 1 then 'duplicate_edge' when h.t = root or reached > 1 then 'cycle' "
        "when hop_no = n - 1 and h.t <> target then 'wrong_end' end as reason from r_seen left join r_graph g on g.from_type = h.f and g.field = h.field "
        "union all select route_key, 0, 'empty' from r_routes where len(via) = 0",
    ),
)
def validate_routes(spark, sf_dir):
    return P.validate_routes(_route_candidates(spark, sf_dir), _graph(spark, sf_dir))


@register(
    "reachability_check",
    oracle.query(
        "select request_id, root, target as type, 'UNREACHABLE_BY_ROUTES' as reason from r_requests q "
        "where root <> target and exists (select 1 from r_reach x where x.root = q.root and x.target = q.target) "
        "and not exists (select 1 from r_graph g where g.from_type = q.root and g.to_type = q.target) "
        "union all select request_id, root, target, 'UNREACHABLE_BY_GRAPH' from r_requests where not exists (select 1 from r_reach x where x.root = r_requests.root and x.target = r_requests.target)",
        r_graph=_GRAPH_SQL,
        r_requests=_REQUESTS_SQL,
        r_reach="select root, root as target from (select distinct root from r_requests) union select p.root, g.to_type from r_reach p join r_graph g on p.target = g.from_type",
    ),
)
def reachability_check(spark, sf_dir):
    """Routes of one hop each; a quarter of the requests ask for a node the graph does not have."""
    asked = _requests(spark, sf_dir).withColumnRenamed("target", "type")
    graph = _graph(spark, sf_dir)
    one_hop = asked.join(graph, (F.col("root") == F.col("from_type")) & (F.col("type") == F.col("to_type"))).select("request_id", "type")
    return P.reachability_check(asked, graph, one_hop)


@register(
    "key_moment_rule",
    "select event_id, case when event_id % 2 = 0 then 'event' else 'team' end as root, case event_type when 'view' then 'KeyMoment ' else event_type end as view "
    "from events where event_type = 'view' and event_id % 2 = 1",
)
def key_moment_rule(spark, sf_dir):
    """Every event record as a request: views ask for key moments, half of them from a team."""
    rows = tpch.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "event").otherwise("team").alias("root"),
        F.when(F.col("event_type") == "view", "KeyMoment ").otherwise(F.col("event_type")).alias("view"),
    )
    return P.key_moment_rule(rows)
