"""One-hop edges and documents over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.operators.docs import PART_ROWS, build_docs, collapse_edges, flat_docs
from xrel.operators.edges import all_edges, derived_often, edges_from_type, edges_of, labelled, written_once
from xrel.operators.relations import TYPE_GRAPH
from xrel.plans import oracle
from xrel.plans.registry import register
from xrel.session import SLICE_ROWS, cut_lineage
from xrel.sources import tpch

# Kind of join -> the edges it gives.
EDGE_KINDS = {
    "edge_fk_out": [
        ("event", "venues"), ("team", "venues"), ("club", "venues"), ("nation", "venues"), ("team", "clubs"),
        ("staff", "clubs"), ("stage", "competitions"), ("event", "stages"), ("ranking", "stages"), ("ranking", "events"),
        ("keyMoment", "events"), ("team", "nations"), ("staff", "nations"), ("ranking", "teams"), ("staff", "teams"),
        ("ranking", "sportsPersons"), ("staff", "sportsPersons"),
    ],
    "edge_fk_in": [
        ("competition", "stages"), ("stage", "events"), ("club", "teams"), ("nation", "teams"), ("venue", "clubs"),
        ("venue", "events"), ("venue", "nations"), ("venue", "teams"),
    ],
    "edge_participant_person": [("event", "sportsPersons"), ("keyMoment", "sportsPersons")],
    "edge_participant_team": [("event", "teams"), ("keyMoment", "teams")],
    "edge_members_person": [("team", "sportsPersons"), ("club", "sportsPersons")],
    "edge_membership_out": [("competition", "sgos"), ("team", "sgos"), ("club", "sgos"), ("nation", "sgos")],
    "edge_membership_in": [("sgo", "competitions"), ("sgo", "teams"), ("sgo", "clubs"), ("sgo", "venues"), ("sgo", "nations")],
    "edge_member_in": [("sportsPerson", "teams"), ("sportsPerson", "clubs")],
    "edge_participant_in": [("sportsPerson", "events"), ("team", "events")],
    "edge_rankings_in": [("stage", "rankings"), ("event", "rankings"), ("team", "rankings"), ("sportsPerson", "rankings")],
    "edge_staff_in": [("team", "staff"), ("club", "staff"), ("nation", "staff"), ("sportsPerson", "staff")],
    "edge_key_moments_in": [("event", "keyMoments"), ("sportsPerson", "keyMoments")],
    "union_in_out": [("sgo", "sgos"), ("venue", "sgos")],
}

_LABELS = {(s, f): (s, f, d) for s, f, d in oracle.EDGES}


def _kind_query(pairs):
    def run(spark, sf_dir):
        es = tpch.entities(spark, sf_dir)
        return reduce(DataFrame.unionByName, [labelled(edges_of(es, s, f), s, f) for s, f in pairs])

    return run


for _name, _pairs in EDGE_KINDS.items():
    _sql = " union all ".join(oracle.labelled(*_LABELS[p]) for p in _pairs if p in _LABELS)
    register(_name, oracle.query(_sql))(_kind_query(_pairs))


@register(
    "all_edges",
    oracle.query(
        "select src_type, field, dst_type, count(*) as n, count(distinct src_id) as n_src, count(distinct dst_key) as n_dst, "
        "min(src_key) as first_src, max(dst_key) as last_dst from all_edges group by all"
    ),
)
def all_edges_query(spark, sf_dir):
    return edge_counts(all_edges(tpch.entities(spark, sf_dir)))


def edge_counts(edges: DataFrame, least: int = SLICE_ROWS) -> DataFrame:
    """What each field has. Beyond `least` edges a run counts the distinct values of one share of hashes only."""
    shares = 4 if edges.count() > least else 1
    field = ["src_type", "field", "dst_type"]

    def share(c: str, i: int) -> Column:
        return F.when(F.pmod(F.xxhash64(c), F.lit(shares)) == i, F.col(c))

    parts = [
        cut_lineage(edges.groupBy(*field).agg(
            F.count("*").alias("n"), F.countDistinct(share("src_id", i)).alias("n_src"),
            F.countDistinct(share("dst_key", i)).alias("n_dst"),
            F.min("src_key").alias("first_src"), F.max("dst_key").alias("last_dst"),
        ))
        for i in range(shares)
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*field).agg(
        F.max("n").alias("n"), F.sum("n_src").alias("n_src"), F.sum("n_dst").alias("n_dst"),
        F.min("first_src").alias("first_src"), F.max("last_dst").alias("last_dst"),
    )


# Small parts, so that the test tables hold hubs.
HUB_ROWS = 10


def part_sql(edges: str, part_rows: int) -> str:
    """Edges (src_id, field, dst_id, dst_key) with the part each belongs to and how many parts its field has."""
    counted = f"select *, ceil(count(*) over (partition by src_id, field) / {part_rows}.0)::bigint as parts from ({edges})"
    digits = "('0x' || substr(md5(coalesce(dst_key, dst_id)), 1, 8))::bigint"
    return f"select *, case when parts > 1 then {digits} % parts else 0 end as part_no from ({counted})"


@register(
    "collapse_edges",
    oracle.query(
        "select src_id, field, part_no::int as part_no, string_agg(dst_id, ',' order by dst_id) as ids, string_agg(dst_key || '=' || dst_id, ',' order by dst_key || '=' || dst_id) as keys "
        "from p_all group by all",
        p_all=part_sql("select src_id, 'events' as field, dst_id, dst_key from e_team_events union all select src_id, 'sportsPersons', dst_id, dst_key from e_event_sportsPersons", HUB_ROWS),
    ),
)
def collapse_edges_query(spark, sf_dir):
    """Ids and key maps in parts of about HUB_ROWS references; teams have several of them."""
    es = tpch.entities(spark, sf_dir)
    edges = labelled(edges_of(es, "team", "events"), "team", "events").unionByName(
        labelled(edges_of(es, "event", "sportsPersons"), "event", "sportsPersons")
    )
    pairs = F.sort_array(F.transform(F.map_entries("keys"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return collapse_edges(cut_lineage(edges), HUB_ROWS).select(
        "src_id", "field", "part_no", F.array_join("ids", ",").alias("ids"), F.array_join(pairs, ",").alias("keys")
    )


def doc_sql(doc_type: str, part_rows: int = PART_ROWS) -> str:
    """Documents of one type: header joined to one grouped list per field and part."""
    name = "case when h.lang = 'en' then h.name_en end" if doc_type == "venue" else "h.name_en"
    columns, joins, parted = [], [], []
    known = dict(oracle.fields_of(doc_type))
    for i, (f, dst) in enumerate(TYPE_GRAPH[doc_type].items()):
        if f not in known:
            columns.append(f"'' as \"{f}\", 0::bigint as \"n_{f}\", '' as \"{dst}Keys\"")
            continue
        own = part_sql(f"select src_id, '{f}' as field, dst_id, dst_key from e_{doc_type}_{f}", part_rows)
        parted.append(f"select src_id, part_no, parts from ({own})")
        joins.append(
            f"left join (select src_id, part_no, string_agg(dst_id, ',' order by dst_id) as ids, count(*) as n, "
            f"string_agg(dst_key || '=' || dst_id, ',' order by dst_key || '=' || dst_id) as k from ({own}) group by 1, 2) j{i} "
            f"on j{i}.src_id = h.id and j{i}.part_no = coalesce(k.part_no, 0)"
        )
        columns.append(
            f"coalesce(j{i}.ids, '') as \"{f}\", coalesce(j{i}.n, 0)::bigint as \"n_{f}\", coalesce(j{i}.k, '') as \"{dst}Keys\""
        )
    every = " union all ".join(parted)
    places = f"left join (select distinct src_id, part_no, max(parts) over (partition by src_id) as n_parts from ({every})) k on k.src_id = h.id"
    header = f"h.external_key, h.id, {name} as name, coalesce(k.part_no, 0)::int as part_no, coalesce(k.n_parts, 1)::int as n_parts"
    return f"select {header}, {', '.join(columns)} from {oracle.table_of(doc_type)} h {places} {' '.join(joins)}"


@register("doc_hubs", oracle.query(doc_sql("sgo", HUB_ROWS)))
def doc_hubs(spark, sf_dir):
    """Documents of governing bodies in parts of about HUB_ROWS references: each of them is a hub."""
    es = tpch.entities(spark, sf_dir)
    edges = cut_lineage(edges_from_type(es, "sgo").select("src_id", "field", "dst_id", "dst_key"))
    return flat_docs(build_docs(es, "sgo", HUB_ROWS, edges=edges), "sgo")


def _doc_query(doc_type):
    def run(spark, sf_dir):
        es = tpch.entities(spark, sf_dir)
        if doc_type in derived_often():
            # Their edges and the headers of their documents are worked out from the same rows.
            es = written_once(es, {doc_type})
        # The edges are read twice (to find hubs, then to gather), so they are written out once.
        edges = cut_lineage(edges_from_type(es, doc_type).select("src_id", "field", "dst_id", "dst_key"))
        return flat_docs(build_docs(es, doc_type, edges=edges), doc_type)

    return run


DOC_QUERIES = {
    "doc_competition": "competition", "doc_stage": "stage", "doc_event": "event", "doc_team": "team", "doc_club": "club",
    "doc_nation": "nation", "doc_venue": "venue", "doc_sgo": "sgo", "doc_sports_person": "sportsPerson",
    "doc_staff": "staff", "doc_ranking": "ranking", "doc_key_moment": "keyMoment",
}
for _name, _type in DOC_QUERIES.items():
    register(_name, oracle.query(doc_sql(_type)))(_doc_query(_type))
