"""Multi-hop reads over the test tables: every entity of a type is a root."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.functions.text import localised
from xrel.operators import assemble as A
from xrel.operators.edges import derived_often, edges_of, reader, written_once
from xrel.operators.lookup import PRIVATE
from xrel.operators.relations import TYPE_GRAPH
from xrel.plans import oracle
from xrel.plans.registry import register
from xrel.plans.request import Request, answer
from xrel.session import cut_lineage
from xrel.sources import tpch

STAGES, EVENTS = "competition.stages->stage", "stage.events->event"
TEAMS, VENUES, PERSONS = "event.teams->team", "event.venues->venue", "event.sportsPersons->sportsPerson"
SGOS, SGO_TEAMS, TEAM_SGOS = "competition.sgos->sgo", "sgo.teams->team", "team.sgos->sgo"

# Two routes lead to teams and two to governing bodies.
TYPES = ["stage", "team", "event", "sgo"]
ROUTES = [
    A.route(STAGES),
    A.route(STAGES, EVENTS, TEAMS),
    A.route(SGOS, SGO_TEAMS),
    A.route(STAGES, EVENTS),
    A.route(SGOS),
    A.route(STAGES, EVENTS, TEAMS, TEAM_SGOS),
]


def roots_of(entities, root_type: str) -> DataFrame:
    """Every row of a type as a request of its own."""
    return entities.tables[root_type].select(F.col("id").alias("request_id"), F.col("id").alias("dst_id"))


def walk_sql(root_type: str, via: tuple[str, ...]) -> str:
    """Distinct (request_id, dst_id) at the end of a route, deduplicated hop by hop."""
    sql = f"select id as request_id, id as dst_id from {oracle.table_of(root_type)}"
    for hop in via:
        src, field, _ = A.hop_parts(hop)
        sql = f"select distinct w.request_id, x.dst_id from ({sql}) w join e_{src}_{field} x on x.src_id = w.dst_id"
    return sql


def ids_sql(root_type: str, routes: list[A.Route], types: list[str]) -> str:
    parts = []
    for order, t in enumerate(types, start=1):
        for r in routes:
            if r.to == t:
                parts.append(f"select request_id, {order} as type_order, '{t}' as dst_type, dst_id from ({walk_sql(root_type, r.via)})")
    sql = " union ".join(parts)
    if root_type in types:
        sql += f" union select id, 0, '{root_type}', id from {oracle.table_of(root_type)}"
    return sql


def _parts(root_type, routes, types, limit) -> dict[str, str]:
    return {
        "w_ids": ids_sql(root_type, routes, types),
        "w_ranked": "select *, row_number() over (partition by request_id order by type_order, dst_id) as place from w_ids",
        "w_in": f"select * from w_ranked where place <= {limit}",
        "w_rest": f"select * from w_ranked where place > {limit}",
    }


def _competitions(limit: int) -> dict[str, str]:
    return _parts("competition", ROUTES, TYPES, limit)


def _from_competitions(spark, sf_dir, limit: int | None) -> tuple[object, A.Result]:
    es = tpch.entities(spark, sf_dir)
    return es, A.assemble(roots_of(es, "competition"), "competition", ROUTES, TYPES, reader(es), limit)


@register(
    "root_select",
    oracle.query("select 'r' || event_id as request_id, e.id as dst_id from events join event e on event_id || ' @ tpch' = e.external_key"),
)
def root_select(spark, sf_dir):
    requests = tpch.table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.concat(F.col("event_id").cast("string"), F.lit(" @ tpch")).alias("root_key"),
    )
    return A.root_select(requests, tpch.entities(spark, sf_dir).rows("event"))


@register("first_hop", oracle.query(walk_sql("event", (TEAMS,))))
def first_hop(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    return A.next_hop(roots_of(es, "event"), edges_of(es, "event", "teams"))


@register("next_hop", oracle.query(walk_sql("stage", (EVENTS, PERSONS))))
def next_hop(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    events = A.next_hop(roots_of(es, "stage"), edges_of(es, "stage", "events"))
    return A.next_hop(events, edges_of(es, "event", "sportsPersons"))


_SHARED = [A.route(STAGES, EVENTS, h) for h in (TEAMS, VENUES, PERSONS)] + [A.route(STAGES, EVENTS, TEAMS, "team.staff->staff")]
_PREFIXES = sorted({r.via[:n] for r in _SHARED for n in range(1, len(r.via) + 1)})


@register(
    "shared_hops",
    oracle.query(
        " union all ".join(
            f"select '{'|'.join(p)}' as prefix, request_id, count(*) as n, min(dst_id) as first_id from ({walk_sql('competition', p)}) group by all"
            for p in _PREFIXES
        )
    ),
)
def shared_hops(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    reached = A.shared_hops(roots_of(es, "competition"), _SHARED, reader(es))
    parts = [reached[p].select(F.lit("|".join(p)).alias("prefix"), "request_id", "dst_id") for p in _PREFIXES]
    return reduce(DataFrame.unionByName, parts).groupBy("prefix", "request_id").agg(
        F.count("*").alias("n"), F.min("dst_id").alias("first_id")
    )


_ENDS = [A.Route("team"), A.route("team.clubs->club"), A.route("team.events->event", VENUES)]


@register(
    "route_ids",
    oracle.query(
        " union all ".join(
            f"select '{'|'.join(r.via)}' as route, request_id, dst_id from ({walk_sql('team', r.via)})" for r in _ENDS
        )
    ),
)
def route_ids(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    reached = A.shared_hops(roots_of(es, "team"), _ENDS, reader(es))
    parts = [reached[r.via].select(F.lit("|".join(r.via)).alias("route"), "request_id", "dst_id") for r in _ENDS]
    return reduce(DataFrame.unionByName, parts)


@register("union_by_type", oracle.query("select request_id, dst_type, dst_id from w_ids", **_competitions(50)))
def union_by_type(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    reached = A.shared_hops(roots_of(es, "competition"), ROUTES, reader(es))
    return A.union_by_type(reached, ROUTES, TYPES).select("request_id", "dst_type", "dst_id")


@register("budget", oracle.query("select request_id, dst_type, dst_id, place from w_in", **_competitions(25)))
def budget(spark, sf_dir):
    _, got = _from_competitions(spark, sf_dir, 25)
    return got.included.select("request_id", "dst_type", "dst_id", F.col("place").cast("bigint").alias("place"))


_OTHER = [A.route("team.events->event"), A.route("team.clubs->club"), A.route("team.sportsPersons->sportsPerson"), A.route("team.events->event", VENUES)]
_OTHER_TYPES = ["team", "event", "club", "sportsPerson", "venue"]


@register(
    "budget_with_root",
    oracle.query("select request_id, dst_type, dst_id, place from w_in", **_parts("team", _OTHER, _OTHER_TYPES, 15)),
)
def budget_with_root(spark, sf_dir):
    """Teams as roots that ask for themselves too."""
    es = tpch.entities(spark, sf_dir)
    got = A.assemble(roots_of(es, "team"), "team", _OTHER, _OTHER_TYPES, reader(es), 15)
    return got.included.select("request_id", "dst_type", "dst_id", F.col("place").cast("bigint").alias("place"))


@register("overflow", oracle.query("select request_id, dst_type, dst_id from w_rest", **_competitions(5)))
def overflow(spark, sf_dir):
    _, got = _from_competitions(spark, sf_dir, 5)
    return got.overflow.select("request_id", "dst_type", "dst_id")


@register("overflow_zero_budget", oracle.query("select request_id, dst_type, count(*) as n from w_ids group by all", **_competitions(0)))
def overflow_zero_budget(spark, sf_dir):
    _, got = _from_competitions(spark, sf_dir, 0)
    return got.overflow.unionByName(got.included.drop("place")).groupBy("request_id", "dst_type").agg(F.count("*").alias("n"))


_SORT_ROUTES = [
    A.route("team.rankings->ranking"), A.route("team.events->event"), A.route("team.staff->staff"),
    A.route("team.clubs->club"), A.route("team.events->event", VENUES),
]
_SORT_TYPES = ["ranking", "club", "staff", "event", "venue"]


@register(
    "sort_items",
    oracle.query(
        "select request_id, dst_type, row_number() over (partition by request_id, dst_type order by k1 desc nulls last, k2 desc nulls last, "
        "k3 desc nulls last, id) as position, id from ("
        "select request_id, dst_type, t.id, t.stage_id as k1, t.event_id as k2, t.ranking as k3 from w_in join ranking t on dst_id = t.id "
        "union all select request_id, dst_type, t.id, t.name_en, null, null from w_in join club t on dst_id = t.id "
        "union all select request_id, dst_type, t.id, t.name_en, null, null from w_in join staff t on dst_id = t.id "
        "union all select request_id, dst_type, t.id, strftime(t.date_time, '%Y-%m-%d'), null, null from w_in join event t on dst_id = t.id "
        "union all select request_id, dst_type, t.id, case when lang = 'en' then t.name_en end, null, null from w_in join venue t on dst_id = t.id)",
        **_parts("team", _SORT_ROUTES, _SORT_TYPES, 50),
    ),
)
def sort_items(spark, sf_dir):
    # Rankings and staff are walked over and then sorted: their rows are worked out once.
    es = written_once(tpch.entities(spark, sf_dir), derived_often())
    got = A.assemble(roots_of(es, "team"), "team", _SORT_ROUTES, _SORT_TYPES, reader(es))
    placed = A.sort_items(cut_lineage(got.included), es, _SORT_TYPES)
    return placed.select("request_id", "dst_type", F.col("position").cast("bigint").alias("position"), "id")


@register(
    "materialise",
    oracle.query(
        "select request_id, dst_type, t.id, t.external_key, t.name_en as name from w_in join team t on dst_id = t.id "
        "union all select request_id, dst_type, t.id, t.external_key, t.name_en from w_in join stage t on dst_id = t.id "
        "union all select request_id, dst_type, t.id, t.external_key, t.name_en from w_in join event t on dst_id = t.id "
        "union all select request_id, dst_type, t.id, t.external_key, t.name_en from w_in join sgo t on dst_id = t.id",
        **_competitions(50),
    ),
)
def materialise(spark, sf_dir):
    es, got = _from_competitions(spark, sf_dir, None)
    rows = {t: es.rows(t) for t in TYPES}
    items = A.materialise(cut_lineage(got.included), rows)
    parts = [
        items[t].select(
            "request_id", F.lit(t).alias("dst_type"), "id", "external_key",
            localised(F.col("name"), F.col("default_language")).alias("name"),
        )
        for t in TYPES
    ]
    return reduce(DataFrame.unionByName, parts)


_SHAPE_TYPES = [*TYPES, "ranking"]
_USED = ",".join(
    f"{d - 1}:{h}" for d, h in sorted({(n, r.via[n - 1]) for r in ROUTES for n in range(1, len(r.via) + 1)})
)


@register(
    "result_shape",
    oracle.query(
        "select c.id as request_id, c.id as root_id, t.dst_type, "
        "(select count(*) from w_in i where i.request_id = c.id and i.dst_type = t.dst_type) as items, "
        "(select count(*) from w_rest o where o.request_id = c.id and o.dst_type = t.dst_type) as overflow, "
        f"'{_USED}' as edges_used from competition c, (values {', '.join(f'({chr(39)}{t}{chr(39)})' for t in _SHAPE_TYPES)}) t(dst_type)",
        **_competitions(50),
    ),
)
def result_shape(spark, sf_dir):
    """Rankings are asked for but no route leads there: an empty result, not a missing one."""
    es, got = _from_competitions(spark, sf_dir, None)
    return A.result_shape(roots_of(es, "competition"), got.included, got.overflow, _SHAPE_TYPES, ROUTES)


@register(
    "counts",
    oracle.query(
        "select request_id, dst_type, count(*) as n from w_ids group by all union all select request_id, null, count(*) from w_ids group by all",
        **_competitions(50),
    ),
)
def counts(spark, sf_dir):
    _, got = _from_competitions(spark, sf_dir, None)
    return A.counts(got.ids)


@register(
    "overflow_pages",
    oracle.query(
        "select request_id, dst_type, page, count(*) as n, case when count(*) > 1 then '(or ' || string_agg(t, ' ' order by rn) || ')' else min(t) end as query "
        "from (select request_id, dst_type, rn, ((rn - 1) // 50)::bigint as page, '_id==`' || dst_id || '`' as t "
        "from (select *, row_number() over (partition by request_id, dst_type order by dst_id) as rn from w_rest)) group by all",
        **_competitions(50),
    ),
)
def overflow_pages(spark, sf_dir):
    _, got = _from_competitions(spark, sf_dir, None)
    return A.overflow_pages(cut_lineage(got.overflow), 50)


@register(
    "root_key_by_type",
    oracle.query(" union all ".join(f"select '{t}' as root_type, id, external_key as root_key from {oracle.table_of(t)}" for t in TYPE_GRAPH)),
)
def root_key_by_type(spark, sf_dir):
    return A.root_keys(tpch.entities(spark, sf_dir), list(TYPE_GRAPH))


@register(
    "views_normalise",
    "select c_custkey, (rn - 1)::int as view_no, view from (select c_custkey, view, row_number() over (partition by c_custkey order by p) as rn from "
    "(select c_custkey, trim(v) as view, min(p) as p from (select c_custkey, unnest(string_split(t, ',')) as v, "
    "generate_subscripts(string_split(t, ','), 1) as p from (select c_custkey, ' team, ' || lower(c_mktsegment) || ',,venue ,team, c' || c_nationkey || ' ,  ' as t from customer)) "
    "where trim(v) <> '' group by all))",
)
def views_normalise(spark, sf_dir):
    text = F.concat(
        F.lit(" team, "), F.lower("c_mktsegment"), F.lit(",,venue ,team, c"), F.col("c_nationkey").cast("string"), F.lit(" ,  ")
    )
    return A.views_normalise(tpch.table(spark, sf_dir, "customer").select("c_custkey", text.alias("views")))


_DEEP = [
    A.route(STAGES, EVENTS, TEAMS, "team.clubs->club"),
    A.route(STAGES, EVENTS, TEAMS, "team.nations->nation"),
    A.route(STAGES, EVENTS, "event.keyMoments->keyMoment"),
    A.route(STAGES, "stage.rankings->ranking"),
    A.route(STAGES, EVENTS, "event.rankings->ranking"),
]
_DEEP_TYPES = ["club", "nation", "keyMoment", "ranking"]


@register(
    "assemble_deep",
    oracle.query(
        "select request_id, dst_type, count(*) as n, min(dst_id) as first_id, max(dst_id) as last_id, false as beyond from w_in group by all "
        "union all select request_id, dst_type, count(*), min(dst_id), max(dst_id), true from w_rest group by all",
        **_parts("competition", _DEEP, _DEEP_TYPES, 40),
    ),
)
def assemble_deep(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    got = A.assemble(roots_of(es, "competition"), "competition", _DEEP, _DEEP_TYPES, reader(es), 40)

    def summary(df, beyond):
        return df.groupBy("request_id", "dst_type").agg(
            F.count("*").alias("n"), F.min("dst_id").alias("first_id"), F.max("dst_id").alias("last_id")
        ).withColumn("beyond", F.lit(beyond))

    return summary(got.included, False).unionByName(summary(got.overflow, True))


_EVENT_ROUTES = [A.route(TEAMS), A.route(TEAMS, "team.nations->nation"), A.route(VENUES), A.route("event.rankings->ranking")]
_EVENT_TYPES = ["team", "nation", "venue", "ranking"]


@register(
    "assemble_from_events",
    oracle.query("select request_id, dst_type, dst_id, place from w_in", **_parts("event", _EVENT_ROUTES, _EVENT_TYPES, 5)),
)
def assemble_from_events(spark, sf_dir):
    """Every event is a root; a budget of five rows each."""
    es = tpch.entities(spark, sf_dir)
    got = A.assemble(roots_of(es, "event"), "event", _EVENT_ROUTES, _EVENT_TYPES, reader(es), 5)
    return got.included.select("request_id", "dst_type", "dst_id", F.col("place").cast("bigint").alias("place"))


# What the search finds for these views: bodies lead to venues in two hops, events in three.
_ANSWER_ROUTES = [A.route(STAGES), A.route(STAGES, EVENTS, TEAMS), A.route(SGOS, "sgo.venues->venue")]
_ANSWER_TYPES = ["team", "venue", "stage"]


@register(
    "request",
    oracle.query(
        "select i.request_id, i.dst_type, i.dst_id as id, coalesce(t.name_en, s.name_en, case when v.lang = 'en' then v.name_en end) as name, "
        "row_number() over (partition by i.request_id, i.dst_type order by coalesce(t.name_en, case when v.lang = 'en' then v.name_en end) desc nulls last, i.dst_id) as position, "
        "(select count(*) from w_rest o where o.request_id = i.request_id and o.dst_type = i.dst_type) as beyond, 0 as private_columns "
        "from w_in i left join team t on i.dst_id = t.id left join stage s on i.dst_id = s.id left join venue v on i.dst_id = v.id",
        **_parts("competition", _ANSWER_ROUTES, _ANSWER_TYPES, 40),
    ),
)
def request(spark, sf_dir):
    """The whole read: views as text, routes chosen, rows fetched and projected, counts of what lies beyond."""
    es = tpch.entities(spark, sf_dir)
    roots = es.rows("competition").select(F.col("id").alias("request_id"), F.col("external_key").alias("root_key"))
    asked = Request("competition", " team, venue,,stage,team", max_items=40, include={"all": ["name.en", "default_language"]})
    got = answer(es, reader(es), roots, asked)
    parts = [
        rows.select(
            "request_id", F.lit(t).alias("dst_type"), "id", localised(F.col("name"), F.col("default_language")).alias("name"), "position",
            F.lit(sum(c in rows.columns for c in ("stickies", *PRIVATE))).alias("private_columns"),
        )
        for t, rows in got.items.items()
    ]
    beyond = got.shape.select("request_id", "dst_type", F.col("overflow").alias("beyond"))
    return reduce(DataFrame.unionByName, parts).join(beyond, ["request_id", "dst_type"])
