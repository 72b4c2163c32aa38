"""Maintenance, closures, change detection and streaming over the test tables.

The older state holds the lines shipped before 2000; the newer one holds all lines but returned ones.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.functions import keys
from xrel.operators import maintain as M
from xrel.operators.assemble import route
from xrel.operators.docs import build_docs, flat_docs
from xrel.operators.edges import all_edges, edges_from_type, edges_of, labelled, reader, stored_reader
from xrel.plans import oracle
from xrel.plans.assemble_queries import EVENTS, SGO_TEAMS, SGOS, STAGES, TEAMS, walk_sql
from xrel.plans.edge_queries import doc_sql
from xrel.plans.registry import register
from xrel.session import cut_lineage, shared_dir
from xrel.sources import tpch
from xrel.streaming.materialise import Materialiser, stream_materialise as run_stream

OLD, NEW = "l_shipdate < timestamp_ntz'2000-01-01 00:00:00'", "l_returnflag <> 'R'"
_OLD_SQL, _NEW_SQL = "l_shipdate < timestamp '2000-01-01 00:00:00'", NEW


def _states(spark, sf_dir):
    lines = tpch.table(spark, sf_dir, "lineitem")
    return (tpch.entities(spark, sf_dir, lines=lines.where(c)) for c in (OLD, NEW))


def _members_sql(condition: str) -> str:
    return (
        "select distinct l_suppkey || ' @ tpch' as team_key, 'team:' || l_suppkey as team_id, l_partkey || ' @ tpch' as person_key, "
        f"'sportsPerson:' || l_partkey as person_id, l_partkey from lineitem where l_linenumber = 1 and {condition}"
    )


def _event_teams_sql(condition: str) -> str:
    return (
        "select distinct 'event:' || l_orderkey as src_id, l_orderkey || ' @ tpch' as src_key, 'team:' || l_suppkey as dst_id, "
        f"l_suppkey || ' @ tpch' as dst_key from lineitem where l_linenumber % 2 = 1 and {condition}"
    )


_DIFF = {
    "m_old": _members_sql(_OLD_SQL),
    "m_new": _members_sql(_NEW_SQL),
    "m_ops": "select 'remove' as op, * from (select * from m_old except select * from m_new) union all select 'add', * from (select * from m_new except select * from m_old)",
}


@register(
    "reference_diff",
    oracle.query(
        "select op, 'event' as src_type, src_id, src_key, 'teams' as field, 'team' as dst_type, dst_id, dst_key from ("
        "select 'remove' as op, * from (select * from d_old except select * from d_new) union all select 'add', * from (select * from d_new except select * from d_old))",
        d_old=_event_teams_sql(_OLD_SQL),
        d_new=_event_teams_sql(_NEW_SQL),
    ),
)
def reference_diff(spark, sf_dir):
    old, new = (labelled(edges_of(es, "event", "teams"), "event", "teams") for es in _states(spark, sf_dir))
    return M.reference_diff(old, new)


def _new_state_sql() -> str:
    """All edges of the newer state: the same SQL over the lines of that state."""
    parts = {k: re.sub(r"\bfrom lineitem\b", "from new_lineitem", v) for k, v in oracle.PARTS.items()}
    parts = {"new_lineitem": f"select * from lineitem where {_NEW_SQL}", **parts}
    return oracle.query("select * from all_edges", **parts)


@register("maintain_all", _new_state_sql())
def maintain_all(spark, sf_dir):
    """The older state's edges, maintained for every changed row of every type, are the newer state's edges."""
    before, after = _states(spark, sf_dir)
    return M.apply_ops(all_edges(before), M.maintain_ops(before, after))


def _member_ops(spark, sf_dir):
    before, after = _states(spark, sf_dir)
    old, new = (labelled(edges_of(es, "team", "sportsPersons"), "team", "sportsPersons") for es in (before, after))
    ops = cut_lineage(M.inverse_ops(M.reference_diff(old, new)))
    return before, ops


@register(
    "apply_reference_ops",
    oracle.query(
        "select 'sportsPerson' as src_type, person_id as src_id, person_key as src_key, 'teams' as field, 'team' as dst_type, team_id as dst_id, team_key as dst_key from m_new",
        **_DIFF,
    ),
)
def apply_reference_ops(spark, sf_dir):
    """Old person edges plus the ops from the teams' side give the new person edges."""
    before, ops = _member_ops(spark, sf_dir)
    stored = labelled(edges_of(before, "sportsPerson", "teams"), "sportsPerson", "teams")
    return M.apply_ops(stored, ops)


def _some_docs(spark, sf_dir):
    """Documents exist so far only for parts of size 10 and more."""
    parts = tpch.table(spark, sf_dir, "part").where("p_size >= 10")
    key = keys.pair_key(F.col("p_partkey").cast("string"), F.lit(tpch.SCOPE))
    return parts.select(F.lit("sportsPerson").alias("resource_type"), key.alias("external_key"))


@register(
    "stub_docs",
    oracle.query(
        "select distinct 'sportsPerson' as resource_type, person_key as external_key, person_id as id from m_ops join part on l_partkey = p_partkey where op = 'add' and p_size < 10",
        **_DIFF,
    ),
)
def stub_docs(spark, sf_dir):
    _, ops = _member_ops(spark, sf_dir)
    return M.stub_docs(ops, _some_docs(spark, sf_dir))


@register(
    "apply_summary",
    oracle.query(
        "select op, count(*) as ops, count_if(p_size >= 10)::bigint as matched, count_if(p_size >= 10)::bigint as modified, "
        "count(distinct case when op = 'add' and p_size < 10 then person_key end) as upserted from m_ops join part on l_partkey = p_partkey group by op",
        **_DIFF,
    ),
)
def apply_summary(spark, sf_dir):
    before, ops = _member_ops(spark, sf_dir)
    stored = labelled(edges_of(before, "sportsPerson", "teams"), "sportsPerson", "teams")
    return M.apply_summary(ops, stored, _some_docs(spark, sf_dir))


@register(
    "build_one",
    oracle.query(
        "select a.external_key, case when d.id is null then 'not_found' else 'ok' end as status, d.id, d.n_events, d.sgos, d.clubs, d.staff from "
        "(select distinct (l_quantity::bigint * 10) || ' @ tpch' as external_key from lineitem) a "
        f"left join ({doc_sql('team')}) d on d.external_key = a.external_key"
    ),
)
def build_one(spark, sf_dir):
    """Team documents for the keys that lines name, some of which are no team."""
    lines = tpch.table(spark, sf_dir, "lineitem")
    named = (F.col("l_quantity").cast("bigint") * 10).cast("string")
    asked = lines.select(keys.pair_key(named, F.lit(tpch.SCOPE)).alias("external_key")).distinct()
    docs, status = M.build_one(tpch.entities(spark, sf_dir), "team", asked)
    return status.join(flat_docs(docs, "team"), "external_key", "left").select(
        "external_key", "status", "id", "n_events", "sgos", "clubs", "staff"
    )


@register(
    "collect_keys",
    oracle.query(
        "select src_key as external_key, 'eventKeys' as key_type, dst_key as key from e_stage_events union all "
        "select src_key, 'rankingKeys', dst_key from e_stage_rankings"
    ),
)
def collect_keys(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    docs = build_docs(es, "stage", edges=cut_lineage(edges_from_type(es, "stage")))
    return M.collect_keys(docs, ["eventKeys", "rankingKeys"])


def _closure_parts() -> dict[str, str]:
    parts = {
        "c_sgo": "select request_id, dst_id from (" + walk_sql("competition", (SGOS,)) + ") union select c.request_id, x.dst_id from c_sgo c join e_sgo_sgos x on x.src_id = c.dst_id",
        "c_competition": "select id as request_id, id as dst_id from competition",
    }
    for level, sources in M.REBUILD_LEVELS.items():
        parts[f"c_{level}"] = " union ".join(
            f"select c.request_id, x.dst_id from c_{s} c join e_{s}_{f} x on x.src_id = c.dst_id" for s, f in sources
        )
    return parts


_CLOSURE_TYPES = ["competition", "sgo", *M.REBUILD_LEVELS]


@register(
    "rebuild_closure",
    oracle.query(
        " union all ".join(
            f"select request_id, '{t}' as type, dst_id as id, external_key as key from c_{t} join {oracle.table_of(t)} e on e.id = dst_id" for t in _CLOSURE_TYPES
        ),
        **_closure_parts(),
    ),
)
def rebuild_closure(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    roots = es.rows("competition").select(F.col("id").alias("request_id"), "id", F.col("external_key").alias("key"))
    return M.rebuild_closure(roots, reader(es))


@register(
    "recursive_closure",
    oracle.query(
        "select request_id, split_part(id, ':', 1) as type, id from c_all",
        c_step="select src_id, dst_id from e_team_clubs union all select src_id, dst_id from e_team_nations union all select src_id, dst_id from e_team_sgos "
        "union all select src_id, dst_id from e_club_sgos union all select src_id, dst_id from e_nation_sgos union all select src_id, dst_id from e_sgo_clubs "
        "union all select src_id, dst_id from e_sgo_nations union all select src_id, dst_id from e_sgo_sgos",
        c_all="select id as request_id, id from team union select c.request_id, s.dst_id from c_all c join c_step s on s.src_id = c.id",
    ),
)
def recursive_closure(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    roots = es.rows("team").select(F.col("id").alias("request_id"), F.lit("team").alias("type"), "id", F.col("external_key").alias("key"))
    return M.recursive_closure(roots, ["club", "nation", "sgo"], reader(es)).select("request_id", "type", "id")


@register(
    "rebuild",
    oracle.query(
        "select x.type, x.id, x.key as external_key, (select count(*) from all_edges a where a.src_type = x.type and a.src_id = x.id) as related, 'ok' as status from ("
        + " union all ".join(
            f"select '{t}' as type, dst_id as id, external_key as key from (select distinct dst_id from c_{t}) join {oracle.table_of(t)} e on e.id = dst_id"
            for t in _CLOSURE_TYPES
        )
        + ") x",
        **_closure_parts(),
    ),
)
def rebuild(spark, sf_dir):
    """Every document that the rebuild of any season touches, built from stored edges."""
    es = tpch.entities(spark, sf_dir)
    edges = cut_lineage(all_edges(es))
    roots = es.rows("competition").select(F.col("id").alias("request_id"), "id", F.col("external_key").alias("key"))
    touched = M.rebuild_closure(roots, stored_reader(edges))
    return M.rebuild(es, edges, touched)


@register(
    "rebuild_tracking",
    oracle.query(
        "select type, status, count(*) as n from ("
        "select 'event' as type, case when o_orderstatus = 'P' then 'failed' else 'completed' end as status from orders union all "
        "select 'sportsPerson', case when p.p_partkey is null then 'not_found' else 'completed' end from (select distinct l_partkey * 3 as k from lineitem) left join part p on p.p_partkey = k "
        "union all select 'keyMoment', 'skipped' from events) group by all"
    ),
)
def rebuild_tracking(spark, sf_dir):
    """Attempts on all events, some of which failed, on persons of which some are missing, and on key moments, which have no handler."""
    es = tpch.entities(spark, sf_dir)
    none = F.lit(None).cast("string").alias("error")
    key_of = lambda c: keys.pair_key(c.cast("string"), F.lit(tpch.SCOPE)).alias("key")
    attempted = reduce(
        DataFrame.unionByName,
        [
            tpch.table(spark, sf_dir, "orders").select(
                F.lit("event").alias("type"), key_of(F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "P", "pending").alias("error")
            ),
            tpch.table(spark, sf_dir, "lineitem").select(F.lit("sportsPerson").alias("type"), key_of(F.col("l_partkey") * 3), none).distinct(),
            es.rows("keyMoment").select(F.lit("keyMoment").alias("type"), F.col("external_key").alias("key"), none),
        ],
    )
    return M.rebuild_tracking(attempted, es).groupBy("type", "status").agg(F.count("*").alias("n"))


@register(
    "rebuild_report",
    oracle.query(
        "select request_id, stage_key, count_if(not lost)::bigint as ok, count_if(lost)::bigint as failed, "
        "string_agg(event_key, ',' order by event_key) filter (where lost and rn <= 10) as first_failed, greatest(count_if(lost) - 10, 0)::bigint as more "
        "from (select *, row_number() over (partition by request_id, stage_key, lost order by event_key) as rn from ("
        "select c.src_id as request_id, s.src_key as stage_key, s.dst_key as event_key, o.o_orderstatus = 'F' as lost "
        "from e_competition_stages c join e_stage_events s on s.src_id = c.dst_id join orders o on 'event:' || o.o_orderkey = s.dst_id)) group by all"
    ),
)
def rebuild_report(spark, sf_dir):
    """Builds of finished orders count as failed."""
    es = tpch.entities(spark, sf_dir)
    roots = es.rows("competition").select(F.col("id").alias("request_id"), "id", F.col("external_key").alias("key"))
    failed = tpch.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        keys.pair_key(F.col("o_orderkey").cast("string"), F.lit(tpch.SCOPE)).alias("key")
    )
    return M.rebuild_report(roots, reader(es), failed)


@register(
    "change_detect",
    "select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'new' when b.o_orderkey is null then 'gone' "
    "when b.o_orderpriority = '1-URGENT' then 'changed' else 'unchanged' end as state "
    "from (select * from orders where o_orderdate < timestamp '2001-01-01') a full join (select * from orders where o_orderstatus <> 'F') b on a.o_orderkey = b.o_orderkey",
)
def change_detect(spark, sf_dir):
    orders = tpch.table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]
    old = orders.where("o_orderdate < timestamp_ntz'2001-01-01 00:00:00'").select(*columns)
    raised = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = orders.where("o_orderstatus <> 'F'").select(*columns).withColumn("o_totalprice", raised)
    return M.change_detect(old, new, "o_orderkey").select("o_orderkey", "state")


@register(
    "affected_roots",
    oracle.query(
        f"select distinct request_id as root_id, dst_id as changed_id from (select * from ({walk_sql('competition', (STAGES, EVENTS, TEAMS))}) "
        f"union all select * from ({walk_sql('competition', (SGOS, SGO_TEAMS))})) join supplier on dst_id = 'team:' || s_suppkey where s_acctbal < 3000"
    ),
)
def affected_roots(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    changed = tpch.table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(
        F.concat(F.lit("team:"), F.col("s_suppkey").cast("string")).alias("id")
    )
    return M.affected_roots(changed, "team", [route(STAGES, EVENTS, TEAMS), route(SGOS, SGO_TEAMS)], reader(es))


@register("stream_materialise", oracle.query(doc_sql("keyMoment")))
def stream_materialise(spark, sf_dir):
    """Key moment documents from three batches of files made from the event table.

    The first batch holds every second event with another person, the second takes each tenth away again and brings the
    stale state of some, the third brings all events as they are, some of them twice with the older state last.
    """
    es = tpch.entities(spark, sf_dir)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    target = Materialiser(spark, f"{folder}/tables", "keyMoment", compact_every=2)
    events = tpch.table(spark, sf_dir, "events")
    other = events.withColumn("user_id", F.greatest(F.col("user_id") - 1, F.lit(0)))
    flags = lambda df, seq, gone: df.withColumns({"seq": F.lit(seq), "gone": F.lit(gone)})
    batches = [
        flags(other.where("event_id % 2 = 0"), 1, False),
        flags(other.where("event_id % 10 = 0"), 2, True).unionByName(flags(events.where("event_id % 10 = 2"), 0, False)),
        flags(events, 4, False).unionByName(flags(other.where("event_id % 7 = 0"), 3, False)),
    ]

    def to_rows(records):
        return tpch.key_moments(records, "seq", "gone")

    def entities_with(rows):
        refs = rows.select(
            F.col("id").alias("owner_id"), F.col("external_key").alias("owner_key"),
            *(F.lit(None).cast("string").alias(c) for c in ("team_id", "team_scope")), "sp_id", "sp_scope",
        )
        return es.replaced(
            {"keyMoment": rows.drop("external_key", "sp_id", "sp_scope")}, {("keyMoment", "participants"): refs}
        )

    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/inbox")
        arriving = spark.readStream.schema(batch.schema).parquet(f"{folder}/inbox")
        run_stream(arriving, to_rows, entities_with, target, f"{folder}/checkpoint", "seq", "gone").awaitTermination()
    docs = target.docs.read().where("resource_type = 'keyMoment'")
    return flat_docs(docs, "keyMoment")
