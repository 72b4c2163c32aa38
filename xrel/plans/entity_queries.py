"""Loading, lookups, keys and scalar columns over the test tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.functions import keys
from xrel.functions.dates import normalise_date
from xrel.functions.text import WHITE_SPACE, camel_to_snake, localised, nbsp_to_space, non_empty, split_camel
from xrel.functions.version import content_version
from xrel.operators import lookup
from xrel.operators.docs import build_docs, flat_docs
from xrel.operators.edges import edges_from_type, edges_of, edges_touching
from xrel.plans import oracle
from xrel.plans.edge_queries import HUB_ROWS, doc_sql
from xrel.plans.registry import register
from xrel.session import cut_lineage, shared_dir
from xrel.sources import schemas, tpch
from xrel.sources.entities import meta
from xrel.sources.store import VersionedTable

T = oracle.table_of
_union = lambda parts: " union all ".join(parts)


@register(
    "load_resources",
    oracle.query(
        _union(
            f"select '{t}' as resource_type, count(*) as n, count(distinct id) as n_ids, min(ext_id) as first_ext_id, "
            f"max(ext_id) as last_ext_id from {T(t)}"
            for t in schemas.TYPES
        )
    ),
)
def load_resources(spark, sf_dir):
    tables = tpch.entities(spark, sf_dir).tables
    narrow = [tables[t].select("resource_type", "id", "ext_id") for t in schemas.TYPES]
    return (
        reduce(DataFrame.unionByName, narrow)
        .groupBy("resource_type")
        .agg(
            F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"),
            F.min("ext_id").alias("first_ext_id"), F.max("ext_id").alias("last_ext_id"),
        )
    )


@register(
    "lookup_by_key",
    oracle.query(
        "select event_id, case when event_type = 'view' then 'Internal' else 'tpch' end as scope, "
        "case when event_type = 'view' then 'sportsPerson:' else '' end || (user_id * 20) as key_id, p.id as found_id, "
        "p.name_en as found_name from events left join sportsPerson p on (user_id * 20)::varchar = p.ext_id"
    ),
)
def lookup_by_key(spark, sf_dir):
    internal = F.col("event_type") == "view"
    wanted = (F.col("user_id") * 20).cast("string")
    requests = tpch.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(internal, F.lit("Internal")).otherwise(F.lit("tpch")).alias("scope"),
        F.when(internal, F.concat(F.lit("sportsPerson:"), wanted)).otherwise(wanted).alias("key_id"),
    )
    persons = tpch.entities(spark, sf_dir).tables["sportsPerson"].select(
        "id", "ext_id", "ext_scope", localised(F.col("name"), F.col("default_language")).alias("found_name")
    )
    found = lookup.lookup_by_key(requests, persons)
    return found.select("event_id", "scope", "key_id", F.col("id").alias("found_id"), "found_name")


@register(
    "strip_private",
    "select c_custkey, c_name, c_name || '/' || c_mktsegment as _original from customer",
)
def strip_private(spark, sf_dir):
    rows = tpch.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("_original"),
        F.col("c_acctbal").alias("_stickies"), F.col("c_nationkey").alias("stickies"),
    )
    return lookup.strip_private(rows, include_original=True)


@register(
    "exists_check",
    oracle.query(
        "select l_linenumber::bigint as line_number, case when v.id is null then 'not_found' else 'ok' end as status, "
        "count(*) as n, count(distinct l_partkey) as n_keys "
        "from lineitem left join venue v on l_partkey::varchar = v.ext_id group by all"
    ),
)
def exists_check(spark, sf_dir):
    requests = tpch.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("line_number"),
        F.col("l_partkey").cast("string").alias("ext_id"), F.lit(tpch.SCOPE).alias("ext_scope"),
    )
    venues = tpch.entities(spark, sf_dir).tables["venue"]
    checked = lookup.exists_check(requests, venues, ["ext_id", "ext_scope"])
    return checked.groupBy("line_number", "status").agg(
        F.count("*").alias("n"), F.countDistinct("ext_id").alias("n_keys")
    )


_OLD_TEAMS = "upper(name_en)"


@register(
    "upsert_agg_docs",
    oracle.query(
        "select 'venue' as resource_type, external_key, 'old ' || external_key as state from venue "
        "where external_key not in (select v.external_key from orders join venue v on o_custkey::varchar = v.ext_id "
        "where o_orderdate >= timestamp '2001-01-01') "
        "union all select distinct 'venue', v.external_key, 'new ' || v.external_key from orders "
        "join venue v on o_custkey::varchar = v.ext_id where o_orderdate >= timestamp '2001-01-01' "
        "union all select 'team', external_key, 'new ' || external_key from team"
    ),
)
def upsert_agg_docs(spark, sf_dir):
    """Documents of venues with a recent order, and all teams, replace or join the stored venue documents."""
    es = tpch.entities(spark, sf_dir)
    key = ["resource_type", "external_key"]
    stored = meta(es, "venue").select(*key, F.concat(F.lit("old "), "external_key").alias("state"))
    recent = es.tables["event"].where("date_time >= timestamp_ntz'2001-01-01'").select(F.col("venue_id").alias("ext_id")).distinct()
    touched = meta(es, "venue").join(recent, "ext_id", "left_semi")
    change = touched.select(*key).unionByName(meta(es, "team").select(*key))
    store = VersionedTable(spark, f"{shared_dir(spark)}/docs-{uuid.uuid4().hex}", key)
    store.write_full(stored)
    store.upsert(change.withColumn("state", F.concat(F.lit("new "), "external_key")))
    return store.read()


@register(
    "unique_key_check",
    "select 'l_orderkey,l_linenumber' as key, l_orderkey || '|' || l_linenumber as value, count(*) as n "
    "from lineitem group by l_orderkey, l_linenumber having count(*) > 1 "
    "union all select 'l_orderkey,l_partkey,l_suppkey', l_orderkey || '|' || l_partkey || '|' || l_suppkey, count(*) "
    "from lineitem group by l_orderkey, l_partkey, l_suppkey having count(*) > 1",
)
def unique_key_check(spark, sf_dir):
    """Lines repeat their keys here and there; documents, also in many parts, never do."""
    lines = tpch.table(spark, sf_dir, "lineitem")
    es = tpch.entities(spark, sf_dir)
    edges = cut_lineage(edges_from_type(es, "sgo").select("src_id", "field", "dst_id", "dst_key"))
    docs = build_docs(es, "sgo", HUB_ROWS, edges=edges)
    of_lines = lookup.unique_key_violations(lines, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey"])
    of_docs = lookup.unique_key_violations(docs, ["resource_type", "external_key", "part_no"], ["resource_type", "id", "part_no"])
    return of_lines.unionByName(of_docs)


@register(
    "fetch_by_ids",
    oracle.query(
        "select dst_id as id, d.name_en as name, count(*) as n from e_event_teams e join team d on e.dst_id = d.id group by all"
    ),
)
def fetch_by_ids(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    ids = edges_of(es, "event", "teams").groupBy("dst_id").agg(F.count("*").alias("n"))
    rows = es.tables["team"].select("id", localised(F.col("name"), F.col("default_language")).alias("name"))
    return lookup.fetch_by_ids(ids, rows).select("id", "name", "n")


@register("read_agg_doc", oracle.query(f"select * from ({doc_sql('team')}) where external_key = '1 @ tpch'"))
def read_agg_doc(spark, sf_dir):
    """One document: only the edges of that row are resolved."""
    es = tpch.entities(spark, sf_dir)
    asked = cut_lineage(es.rows("team").where("external_key = '1 @ tpch'").select("id"))
    edges = cut_lineage(edges_touching(es, {"team": asked}).where("src_type = 'team'"))
    docs = build_docs(es, "team", edges=edges, only=asked)
    return flat_docs(lookup.read_doc(docs, "team", "1 @ tpch"), "team")


# Keys.

@register("simple_key", oracle.query("select id, external_key from event union all select id, external_key from venue"))
def simple_key(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    return es.rows("event").select("id", "external_key").unionByName(es.rows("venue").select("id", "external_key"))


@register("staff_key", oracle.query("select id, external_key, 1 as orgs from staff"))
def staff_key(spark, sf_dir):
    rows = tpch.entities(spark, sf_dir).rows("staff")
    return rows.select("id", "external_key", keys.staff_org_count().alias("orgs"))


@register("ranking_key", oracle.query("select id, external_key from ranking"))
def ranking_key(spark, sf_dir):
    return tpch.entities(spark, sf_dir).rows("ranking").select("id", "external_key")


@register("key_moment_key", oracle.query("select id, external_key from keyMoment"))
def key_moment_key(spark, sf_dir):
    return tpch.entities(spark, sf_dir).rows("keyMoment").select("id", "external_key")


@register(
    "parse_simple_key",
    "select l_orderkey, l_linenumber::bigint as line_number, case when l_returnflag = 'N' then l_partkey::varchar "
    "when l_partkey = 0 and false then null else l_partkey::varchar end as key_id, "
    "case when l_returnflag = 'N' then null else 'tpch' end as key_scope, count(*) as n from lineitem group by all",
)
def parse_simple_key(spark, sf_dir):
    """Lines not returned carry a key without a scope."""
    part = F.col("l_partkey").cast("string")
    key = F.when(F.col("l_returnflag") == "N", part).otherwise(keys.pair_key(part, F.lit(tpch.SCOPE)))
    parsed = keys.parse_simple_key(key)
    return (
        tpch.table(spark, sf_dir, "lineitem")
        .select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line_number"), parsed["id"].alias("key_id"), parsed["scope"].alias("key_scope"))
        .groupBy("l_orderkey", "line_number", "key_id", "key_scope")
        .agg(F.count("*").alias("n"))
    )


_ORGS = ("team", "club", "nation")


@register(
    "parse_staff_key",
    oracle.query(
        "select id, sp_id, sp_scope, team_id, team_scope, club_id, club_scope, nation_id, nation_scope, true as valid from staff "
        "union all select id, null, null, null, null, null, null, null, null, false from event"
    ),
)
def parse_staff_key(spark, sf_dir):
    """Staff keys split; event keys are no staff keys and come out invalid."""
    es = tpch.entities(spark, sf_dir)
    rows = es.rows("staff").select("id", "external_key").unionByName(es.rows("event").select("id", "external_key"))
    return rows.select("id", keys.parse_staff_key(F.col("external_key")).alias("k")).select("id", "k.*")


@register(
    "parse_ranking_key",
    oracle.query(
        "select id, stage_id, case when stage_id is not null then 'tpch' end as stage_scope, event_id, "
        "case when event_id is not null then 'tpch' end as event_scope, team_id, case when team_id is not null then 'tpch' end as team_scope, "
        "sp_id, case when sp_id is not null then 'tpch' end as sp_scope, date_time_label, ranking, true as valid from ranking"
    ),
)
def parse_ranking_key(spark, sf_dir):
    rows = tpch.entities(spark, sf_dir).rows("ranking")
    return rows.select("id", keys.parse_ranking_key(F.col("external_key")).alias("k")).select("id", "k.*")


_RAW_RANKINGS = (
    "select l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, count(*) as n from lineitem group by all"
)


def _raw_rankings(spark, sf_dir):
    """Candidate ranking rows from order lines, some without subject, owner or label."""
    lines = tpch.table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def pair(prefix, value):
        value = value.cast("string")
        return {f"{prefix}_id": value, f"{prefix}_scope": F.when(value.isNotNull(), F.lit(tpch.SCOPE))}

    shown = lines.groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return shown.withColumns(
        {
            **pair("event", F.when(status == "O", F.col("l_orderkey"))),
            **pair("stage", F.when((flag == "A"), F.lit("1999-01"))),
            **pair("team", F.when(flag != "R", F.col("l_suppkey"))),
            **pair("sp", F.when(status == "O", F.col("l_partkey"))),
            "date_time_label": F.when(F.col("n") == 1, F.lit("latest")),
            "ranking": F.col("n").cast("double"),
        }
    )


@register(
    "ranking_validate",
    "select (l_returnflag <> 'R' or l_linestatus = 'O') and (l_returnflag = 'A' or l_linestatus = 'O') and n = 1 as valid, "
    f"count(*) as n_rows, sum(l_partkey)::bigint as part_sum from ({_RAW_RANKINGS}) group by 1",
)
def ranking_validate(spark, sf_dir):
    return (
        _raw_rankings(spark, sf_dir)
        .groupBy(keys.ranking_is_valid().alias("valid"))
        .agg(F.count("*").alias("n_rows"), F.sum("l_partkey").alias("part_sum"))
    )


@register(
    "ranking_type",
    "select case when l_returnflag = 'A' then 'stage_team' when l_returnflag <> 'R' and l_linestatus = 'O' then 'event_team' "
    "when l_linestatus = 'O' then 'event_person' end as kind, "
    f"count(*) as n_rows, sum(l_partkey)::bigint as part_sum from ({_RAW_RANKINGS}) group by 1",
)
def ranking_type(spark, sf_dir):
    return (
        _raw_rankings(spark, sf_dir)
        .groupBy(keys.ranking_kind().alias("kind"))
        .agg(F.count("*").alias("n_rows"), F.sum("l_partkey").alias("part_sum"))
    )


# Scalar columns.

@register(
    "localised_name",
    oracle.query(
        "select id, case when lang = 'en' then name_en end as name from venue union all select id, name_en from keyMoment "
        "union all select id, name_en from staff"
    ),
)
def localised_name(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    return reduce(DataFrame.unionByName, [meta(es, t).select("id", "name") for t in ("venue", "keyMoment", "staff")])


@register(
    "meta_projection",
    oracle.query(
        _union(
            f"select '{t}' as resource_type, external_key, id, ext_id, ext_scope, "
            f"{'case when lang = chr(101) || chr(110) then name_en end' if t == 'venue' else 'name_en'} as name from {T(t)}"
            for t in schemas.TYPES
        )
    ),
)
def meta_projection(spark, sf_dir):
    es = tpch.entities(spark, sf_dir)
    columns = ["resource_type", "external_key", "id", "ext_id", "ext_scope", "name"]
    return reduce(DataFrame.unionByName, [meta(es, t).select(*columns) for t in schemas.TYPES])


@register(
    "non_empty_string",
    f"select doc_id, regexp_matches(text, '[^{WHITE_SPACE}]') as has_text, "
    f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{WHITE_SPACE}]')))::bigint as n_lines from documents",
)
def non_empty_string(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), non_empty)
    return tpch.table(spark, sf_dir, "documents").select(
        "doc_id", non_empty(F.col("text")).alias("has_text"), F.size(lines).cast("bigint").alias("n_lines")
    )


@register(
    "nbsp_to_space",
    "select doc_id, md5(replace(replace(text, chr(10), chr(160)), chr(160), ' ')) as digest from documents",
)
def nbsp_to_space_query(spark, sf_dir):
    """Whole texts, with line ends turned into non-breaking spaces first."""
    text = F.translate("text", "\n", "\u00a0")
    return tpch.table(spark, sf_dir, "documents").select("doc_id", F.md5(nbsp_to_space(text).cast("binary")).alias("digest"))


_CAMEL_SQL = (
    "(select p_partkey, string_split(p_name, ' ')[1] || upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:] "
    "|| p_type || 'Ab' as text from part)"
)


def _camel(spark, sf_dir):
    words = F.split("p_name", " ")
    text = F.concat(words[0], F.initcap(words[1]), "p_type", F.lit("Ab"))
    return tpch.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


_SNAKE_SQL = (
    "lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'))"
)


@register("camel_to_snake", f"select p_partkey, text, {_SNAKE_SQL} as snake from {_CAMEL_SQL}")
def camel_to_snake_query(spark, sf_dir):
    return _camel(spark, sf_dir).withColumn("snake", camel_to_snake(F.col("text")))


@register(
    "split_camel",
    "select p_partkey, array_to_string(w, ' ') as title_case, w[1] || case when len(w) > 1 then ' ' else '' end || lower(array_to_string(w[2:], ' ')) as sentence_case, "
    f"snake_case from (select p_partkey, regexp_extract_all(text, '([A-Z][a-z0-9]*)', 1) as w, {_SNAKE_SQL} as snake_case from {_CAMEL_SQL})",
)
def split_camel_query(spark, sf_dir):
    return _camel(spark, sf_dir).select("p_partkey", split_camel(F.col("text")).alias("s")).select("p_partkey", "s.*")


@register(
    "normalise_date",
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T12:30:15.000Z' as at_noon, "
    "strftime(o_orderdate, '%Y-%m-%dT') || '10:20:30.000Z' as shifted, strftime(o_orderdate, '%Y-%m-%d') as day_only, "
    "cast(null as varchar) as bad from orders",
)
def normalise_date_query(spark, sf_dir):
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    return tpch.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        normalise_date(day, 12, 30, 15).alias("at_noon"),
        normalise_date(F.concat(day, F.lit("T12:20:30+02:00"))).alias("shifted"),
        normalise_date(F.concat(day, F.lit("T23:59:59Z")), date_only=True).alias("day_only"),
        normalise_date(F.concat(F.lit("on "), day)).alias("bad"),
    )


@register(
    "content_version",
    "select p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_name\":\"' || p_name || '\",\"p_partkey\":' || p_partkey || "
    "',\"p_size\":' || p_size || ',\"price\":' || case when p_retailprice = floor(p_retailprice) then p_retailprice::bigint::varchar "
    "else p_retailprice::varchar end || ',\"tags\":{\"en\":\"' || p_type || '\",\"fr\":null}}') as version from part",
)
def content_version_query(spark, sf_dir):
    rows = tpch.table(spark, sf_dir, "part").select(
        "p_size", "p_partkey", "p_name", "p_brand", F.col("p_retailprice").alias("price"),
        F.create_map(F.lit("fr"), F.lit(None).cast("string"), F.lit("en"), F.col("p_type")).alias("tags"),
    )
    return rows.select("p_partkey", content_version(rows).alias("version"))


@register("doc_last_updated", oracle.query("select 'sgo' as resource_type, count(*) as n, 0::bigint as unstamped, 1::bigint as stamps from sgo"))
def doc_last_updated(spark, sf_dir):
    docs = build_docs(tpch.entities(spark, sf_dir), "sgo")
    return docs.groupBy("resource_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("last_updated").isNull()).alias("unstamped"),
        F.countDistinct("last_updated").alias("stamps"),
    )
