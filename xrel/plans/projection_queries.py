"""Field, tag and participant projections over rows made from order lines, one row per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.operators import project as P
from xrel.plans import oracle
from xrel.plans.registry import register
from xrel.sources import tpch

_TAG = "named_struct('name', {n}, 'value', {v})"


def _tags(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(_TAG.format(n=f"'{n}'", v=v) for n, v in pairs) + ")"


def _tags_sql(*pairs: tuple[str, str]) -> str:
    return "[" + ", ".join(f"{{'name': '{n}', 'value': {v}}}" for n, v in pairs) + "]"


_ROOT_TAGS = (("flag", "l_returnflag"), ("flag.status", "l_linestatus"), ("ship", "cast(year(l_shipdate) as string)"))
_TEAM_TAGS = (("role", "'team'"), ("shirt.no", "cast(l_linenumber as string)"))
_PERSON_TAGS = (("role", "l_returnflag"), ("pos", "cast(l_linenumber as string)"))


def line_rows(spark, sf_dir) -> DataFrame:
    """Two participants each: a team, and a person who on even lines also carries the team."""
    return tpch.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('event:', l_orderkey) as id",
        "map('en', l_returnflag, 'fr', l_linestatus) as name",
        "named_struct('team', l_suppkey, 'person', l_partkey) as line",
        "l_quantity as quantity",
        "l_tax as _original",
        f"{_tags(*_ROOT_TAGS)} as tags",
        "array("
        f"named_struct('team_id', string(l_suppkey), 'team_scope', 'tpch', 'sp_id', string(null), 'sp_scope', string(null), 'tags', {_tags(*_TEAM_TAGS)}),"
        "named_struct('team_id', if(l_linenumber % 2 = 0, string(l_suppkey), null), 'team_scope', if(l_linenumber % 2 = 0, 'tpch', null), "
        f"'sp_id', string(l_partkey), 'sp_scope', 'tpch', 'tags', {_tags(*_PERSON_TAGS)})"
        ") as participants",
    )


_ROWS = {
    "h_rows": "select 'event:' || l_orderkey as id, l_returnflag as name_en, l_linestatus as name_fr, l_suppkey, l_partkey, l_quantity as quantity, "
    f"{_tags_sql(*_ROOT_TAGS)} as tags, [{{'team': l_suppkey::varchar, 'sp': null, 'tags': {_tags_sql(*_TEAM_TAGS)}}}, "
    f"{{'team': case when l_linenumber % 2 = 0 then l_suppkey::varchar end, 'sp': l_partkey::varchar, 'tags': {_tags_sql(*_PERSON_TAGS)}}}] as ps "
    "from lineitem",
}


def _tag_text(tags):
    return F.array_join(F.transform(tags, lambda t: F.concat(t["name"], F.lit("="), t["value"])), ",")


def _participant_text(participants):
    def one(p):
        return F.concat(
            F.coalesce(p["team_id"], F.lit("-")), F.lit("/"), F.coalesce(p["sp_id"], F.lit("-")),
            F.lit("["), F.coalesce(_tag_text(p["tags"]), F.lit("~")), F.lit("]"),
        )

    return F.array_join(F.transform(participants, one), ";")


def _tag_text_sql(tags: str, keep: str = "true") -> str:
    return f"array_to_string(list_transform(list_filter({tags}, lambda t: {keep}), lambda t: t.name || '=' || t.value), ',')"


def _participant_text_sql(participants: str = "ps", keep: str = "true", tags: str | None = None) -> str:
    shown = tags or _tag_text_sql("p.tags")
    return (
        f"array_to_string(list_transform(list_filter({participants}, lambda p: {keep}), lambda p: "
        f"coalesce(p.team, '-') || '/' || coalesce(p.sp, '-') || '[' || {shown} || ']'), ';')"
    )


@register(
    "project_fields",
    oracle.query("select id, name_en, cast(null as varchar) as name_fr, l_suppkey as team, quantity from h_rows", **_ROWS),
)
def project_fields(spark, sf_dir):
    """Nested fields in, a private field asked for and refused."""
    rows = P.project(line_rows(spark, sf_dir), ["name.en", "line.team", "quantity", "_original"], ["_original"])
    assert rows.columns == ["id", "name", "line", "quantity"]
    return rows.select(
        "id", F.try_element_at("name", F.lit("en")).alias("name_en"), F.try_element_at("name", F.lit("fr")).alias("name_fr"),
        F.col("line.team").alias("team"), "quantity",
    )


@register(
    "exclude_nested_fields",
    oracle.query("select id, name_en, cast(null as varchar) as name_fr, l_suppkey as team from h_rows", **_ROWS),
)
def exclude_nested_fields(spark, sf_dir):
    rows = P.project(line_rows(spark, sf_dir), [], ["name.fr", "line.person", "tags", "participants", "quantity", "_original"])
    return rows.select(
        "id", F.try_element_at("name", F.lit("en")).alias("name_en"), F.try_element_at("name", F.lit("fr")).alias("name_fr"), "line.*"
    )


@register(
    "phase_order",
    oracle.query(f"select id, {_tag_text_sql('tags', chr(39) + 'flag' + chr(39) + ' = t.name')} as tags, {_participant_text_sql(keep='p.sp is null')} as participants from h_rows", **_ROWS),
)
def phase_order(spark, sf_dir):
    """What an exclusion takes away no inclusion brings back."""
    rows = P.project(
        line_rows(spark, sf_dir),
        ["tags>flag*", "participants.team", "participants.sp", "quantity"],
        ["tags>flag.status", "participants.sp", "quantity"],
    )
    assert rows.columns == ["id", "tags", "participants"]
    return rows.select("id", _tag_text(F.col("tags")).alias("tags"), _participant_text(F.col("participants")).alias("participants"))


@register(
    "filter_tags",
    oracle.query(
        "select id, " + _tag_text_sql("tags", "t.name = 'ship' or starts_with(t.name, 'flag.')") + " as kept, "
        + _tag_text_sql("tags", "not (t.name = 'ship' or starts_with(t.name, 'flag.'))") + " as removed from h_rows",
        **_ROWS,
    ),
)
def filter_tags(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    names = ["ship", "flag.*"]
    kept, removed = P.TagRule(names), P.TagRule(names, exclude=True)
    return rows.select(
        "id", _tag_text(kept.apply(F.col("tags"))).alias("kept"), _tag_text(removed.apply(F.col("tags"))).alias("removed")
    )


@register(
    "filter_participants",
    oracle.query(
        f"select id, {_participant_text_sql(keep='p.team is not null or p.sp is not null')} as both, "
        f"{_participant_text_sql(keep='p.team is not null')} as teams, {_participant_text_sql(keep='p.team is null')} as no_teams, "
        f"{_participant_text_sql(keep='false')} as none from h_rows",
        **_ROWS,
    ),
)
def filter_participants(spark, sf_dir):
    rows = line_rows(spark, sf_dir)

    def shown(keys, exclude):
        return _participant_text(P.filter_participants(F.col("participants"), P.parse_keys(keys, exclude)))

    return rows.select(
        "id",
        shown(["participants.team", "participants.sp"], False).alias("both"),
        shown(["participants.team"], False).alias("teams"),
        shown(["participants.team"], True).alias("no_teams"),
        shown(["participants.team", "participants.sp"], True).alias("none"),
    )


@register(
    "filter_participant_tags",
    oracle.query(
        "select id, "
        + _participant_text_sql(tags=f"case when p.team is not null then {_tag_text_sql('p.tags', 'starts_with(t.name, chr(115))')} else {_tag_text_sql('p.tags')} end")
        + " as team_kept, "
        + _participant_text_sql(tags=f"case when p.team is null then {_tag_text_sql('p.tags', chr(39) + 'pos' + chr(39) + ' <> t.name')} else {_tag_text_sql('p.tags')} end")
        + " as sp_removed, "
        + _participant_text_sql(tags="'~'")
        + " as dropped from h_rows",
        **_ROWS,
    ),
)
def filter_participant_tags(spark, sf_dir):
    rows = line_rows(spark, sf_dir)

    def shown(keys, exclude):
        return _participant_text(P.filter_participant_tags(F.col("participants"), P.parse_keys(keys, exclude)))

    return rows.select(
        "id",
        shown(["participants.team.tags>s*"], False).alias("team_kept"),
        shown(["participants.sp.tags>pos"], True).alias("sp_removed"),
        shown(["participants.tags"], True).alias("dropped"),
    )


@register(
    "projection_request",
    "with asked as (select c_custkey as request_id, c_nationkey % 2 = 0 as keep from customer) "
    "select request_id, 'event' as type, 'include' as mode, k as key from asked, (values ('name'), ('tags>flag*')) v(k) "
    "union all select c_custkey, 'all', 'exclude', lower(c_mktsegment) from customer "
    "union all select request_id, 'all', 'exclude', '_original' from asked where not keep "
    "union all select request_id, 'all', 'exclude', '_stickies' from asked",
)
def projection_request(spark, sf_dir):
    customers = tpch.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), (F.col("c_nationkey") % 2 == 0).alias("include_original"),
        F.lit(False).alias("include_stickies"), F.lower("c_mktsegment").alias("segment"),
    )
    params = customers.select(
        "request_id",
        F.explode(
            F.array(
                F.struct(F.lit("projection.event").alias("name"), F.lit(" name, tags>flag*,,name").alias("value")),
                F.struct(F.lit("projection~all").alias("name"), F.concat("segment", F.lit(" ,")).alias("value")),
                F.struct(F.lit("aggregationMax").alias("name"), F.lit("5").alias("value")),
            )
        ).alias("p"),
    ).select("request_id", "p.*")
    return P.with_private_defaults(P.parse_request(params), customers.drop("segment"))
