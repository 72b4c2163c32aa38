"""DuckDB SQL for checking: entity tables and edges over the same parquet tables.

`query(body)` puts the named parts a statement refers to in front of it.
"""

from __future__ import annotations

import re

_NO_FK = "cast(null as varchar)"


def _entity(kind: str, ext_id: str, name: str, source: str, extra: str = "") -> str:
    return (
        f"select '{kind}:' || {ext_id} as id, {ext_id} as ext_id, 'tpch' as ext_scope, {name} as name_en, "
        f"{ext_id} || ' @ tpch' as external_key{', ' + extra if extra else ''} from {source}"
    )


def _fk(prefix: str, value: str) -> str:
    return f"{value} as {prefix}_id, case when {value} is not null then 'tpch' end as {prefix}_scope"


def _none(*prefixes: str) -> str:
    return ", ".join(f"{_NO_FK} as {p}_id, {_NO_FK} as {p}_scope" for p in prefixes)


_MONTH = "strftime(o_orderdate, '%Y-%m')"
_YEAR = "strftime(o_orderdate, '%Y')"
_BRAND = "cast(substr(p_brand, 7) as integer)"

# Name -> SQL. Later parts may use earlier ones.
PARTS: dict[str, str] = {
    "competition": _entity(
        "competition", "y", "'Season ' || y", f"(select distinct {_YEAR} as y from orders)",
        "cast(y || '-01-01' as timestamp) as start",
    ),
    "stage": _entity(
        "stage", "m", "'Round ' || m", f"(select distinct {_MONTH} as m from orders)", _fk("competition", "substr(m, 1, 4)")
    ),
    "event": _entity(
        "event", "o_orderkey::varchar", "'Order ' || o_orderkey", "orders",
        f"{_fk('stage', _MONTH)}, {_fk('venue', 'o_custkey::varchar')}, o_orderdate as date_time",
    ),
    "team": _entity(
        "team", "s_suppkey::varchar", "s_name", "supplier",
        _fk("club", "('Brand#' || (s_suppkey % 25 + 1))") + ", " + _fk("nation", "s_nationkey::varchar") + ", "
        + _fk("venue", "(case when s_suppkey % 3 = 0 then s_suppkey::varchar end)"),
    ),
    "venue": _entity(
        "venue", "c_custkey::varchar", "c_name", "customer",
        "case when c_mktsegment = 'HOUSEHOLD' then 'de' else 'en' end as lang",
    ),
    "club": _entity(
        "club", "p_brand", "p_brand", f"(select distinct p_brand, {_BRAND} as b from part)",
        _fk("venue", "(case when b % 2 = 0 then (b * 3)::varchar end)"),
    ),
    "sgo": _entity("sgo", "r_regionkey::varchar", "r_name", "region", _fk("venue", "r_regionkey::varchar")),
    "nation_e": _entity(
        "nation", "n_nationkey::varchar", "n_name", "nation",
        _fk("venue", "(case when n_nationkey % 2 = 0 then (n_nationkey * 2)::varchar end)"),
    ),
    "sportsPerson": _entity("sportsPerson", "p_partkey::varchar", "p_name", "part"),
    "staff_rows": f"""
        select 't:' || l_partkey || ':' || l_suppkey as ext_id, l_partkey::varchar as sp_id, p_name,
               l_suppkey::varchar as team_id, {_NO_FK} as club_id, {_NO_FK} as nation_id
        from (select distinct l_partkey, l_suppkey from lineitem where l_linenumber = 7) join part on l_partkey = p_partkey
        union all
        select 'c:' || p_partkey || ':' || p_brand, p_partkey::varchar, p_name, null, p_brand, null from part where p_type = 'ECONOMY'
        union all
        select 'n:' || p_partkey || ':' || (p_size % 25), p_partkey::varchar, p_name, null, null, (p_size % 25)::varchar
        from part where p_type = 'SMALL'""",
    "staff": """
        select 'staff:' || ext_id as id, ext_id, 'tpch' as ext_scope, p_name as name_en, sp_id, 'tpch' as sp_scope,
               team_id, case when team_id is not null then 'tpch' end as team_scope,
               club_id, case when club_id is not null then 'tpch' end as club_scope,
               nation_id, case when nation_id is not null then 'tpch' end as nation_scope,
               sp_id || ' @ tpch' || case when team_id is not null then ' /team/ ' || team_id
                 when club_id is not null then ' /club/ ' || club_id else ' /nation/ ' || nation_id end || ' @ tpch' as external_key
        from staff_rows""",
    "ranking_rows": f"""
        select 's:' || m || ':' || l_suppkey as ext_id, m as stage_id, {_NO_FK} as event_id, l_suppkey::varchar as team_id,
               {_NO_FK} as sp_id, place
        from (select m, l_suppkey, row_number() over (partition by m order by amount desc, l_suppkey) as place
              from (select {_MONTH} as m, l_suppkey, sum(cast(l_extendedprice as decimal(18,2))) as amount
                    from lineitem join orders on l_orderkey = o_orderkey group by all)) where place <= 10
        union all
        select 'e:' || l_orderkey || ':' || l_partkey, null, l_orderkey::varchar, null, l_partkey::varchar, place
        from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by price desc, l_partkey) as place
              from (select l_orderkey, l_partkey, max(l_extendedprice) as price from lineitem group by all)) where place <= 3""",
    "ranking": """
        select 'ranking:' || ext_id as id, ext_id, 'tpch' as ext_scope, 'Place ' || place as name_en,
               stage_id, event_id, team_id, sp_id, 'latest' as date_time_label, place::double as ranking,
               coalesce(stage_id || ' @ tpch /st/ ' || team_id, event_id || ' @ tpch /esp/ ' || sp_id)
                 || ' @ tpch /label/ latest /rank/ ' || place as external_key
        from ranking_rows""",
    "keyMoment": """
        select 'keyMoment:' || event_id as id, event_id::varchar as ext_id, 'tpch' as ext_scope,
               event_id::varchar as event_id, event_type as type, json_extract_string(props, '$.k') as sub_type,
               ts as date_time, user_id::varchar as sp_id, json_extract_string(props, '$.k') as name_en,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' @ ' || event_id || ' @ tpch @ ' || event_type || ' @ '
                 || json_extract_string(props, '$.k') as external_key
        from events""",
    "event_lines": """
        select 'event:' || l_orderkey as owner_id, l_suppkey::varchar as team_id,
               case when l_linenumber % 2 = 0 then l_partkey::varchar end as sp_id
        from lineitem""",
    "membership": """
        select 'competition' as t, 'competition:' || y as owner_id, r_regionkey::varchar as sgo_id
        from (select distinct year(o_orderdate) as y from orders) join region on r_regionkey % 2 = y % 2
        union all select 'team', 'team:' || s_suppkey, n_regionkey::varchar from supplier join nation on s_nationkey = n_nationkey
        union all select 'venue', 'venue:' || c_custkey, n_regionkey::varchar from customer join nation on c_nationkey = n_nationkey
        union all select distinct 'club', 'club:' || p_brand, (cast(substr(p_brand, 7) as integer) % 5)::varchar from part
        union all select 'nation', 'nation:' || n_nationkey, n_regionkey::varchar from nation
        union all select 'sgo', 'sgo:' || r_regionkey, (r_regionkey - 1)::varchar from region where r_regionkey > 0""",
}


def table_of(kind: str) -> str:
    return "nation_e" if kind == "nation" else kind


def _name(src: str, field: str) -> str:
    return f"e_{src}_{field}"


_COLS = "{s}.id as src_id, {s}.external_key as src_key, {d}.id as dst_id, {d}.external_key as dst_key"


def _add(src: str, field: str, dst: str, source: str) -> None:
    cols = _COLS.format(s="s", d="d")
    PARTS[_name(src, field)] = f"select distinct {cols} from {source}"
    EDGES.append((src, field, dst))


EDGES: list[tuple[str, str, str]] = []

# Child, key column, parent, field from the child, field from the parent.
for child, col, parent, fwd, inv in [
    ("stage", "competition", "competition", "competitions", "stages"),
    ("event", "stage", "stage", "stages", "events"),
    ("event", "venue", "venue", "venues", "events"),
    ("team", "club", "club", "clubs", "teams"),
    ("team", "nation", "nation", "nations", "teams"),
    ("team", "venue", "venue", "venues", "teams"),
    ("club", "venue", "venue", "venues", "clubs"),
    ("nation", "venue", "venue", "venues", "nations"),
    ("staff", "team", "team", "teams", "staff"),
    ("staff", "club", "club", "clubs", "staff"),
    ("staff", "nation", "nation", "nations", "staff"),
    ("staff", "sp", "sportsPerson", "sportsPersons", "staff"),
    ("ranking", "stage", "stage", "stages", "rankings"),
    ("ranking", "event", "event", "events", "rankings"),
    ("ranking", "team", "team", "teams", "rankings"),
    ("ranking", "sp", "sportsPerson", "sportsPersons", "rankings"),
    ("keyMoment", "event", "event", "events", "keyMoments"),
    ("keyMoment", "sp", "sportsPerson", "sportsPersons", "keyMoments"),
]:
    c, p = table_of(child), table_of(parent)
    _add(child, fwd, parent, f"{c} s join {p} d on s.{col}_id = d.ext_id")
    _add(parent, inv, child, f"{c} d join {p} s on d.{col}_id = s.ext_id")

_LINES = "event_lines l join {e} on l.owner_id = {e0}.id join {o} on l.{col} = {o0}.ext_id"
_add("event", "sportsPersons", "sportsPerson", _LINES.format(e="event s", e0="s", o="sportsPerson d", o0="d", col="sp_id"))
_add("sportsPerson", "events", "event", _LINES.format(e="event d", e0="d", o="sportsPerson s", o0="s", col="sp_id"))
_add("event", "teams", "team", _LINES.format(e="event s", e0="s", o="team d", o0="d", col="team_id") + " where l.sp_id is null")
_add("team", "events", "event", _LINES.format(e="event d", e0="d", o="team s", o0="s", col="team_id"))

_MEMBERS = "(select l_suppkey, l_partkey from lineitem where l_linenumber = 1) m join team {a} on m.l_suppkey::varchar = {a}.ext_id join sportsPerson {b} on m.l_partkey::varchar = {b}.ext_id"
_add("team", "sportsPersons", "sportsPerson", _MEMBERS.format(a="s", b="d"))
_add("sportsPerson", "teams", "team", _MEMBERS.format(a="d", b="s"))
_CLUB = "part m join club {a} on m.p_brand = {a}.ext_id join sportsPerson {b} on m.p_partkey::varchar = {b}.ext_id"
_add("club", "sportsPersons", "sportsPerson", _CLUB.format(a="s", b="d"))
_add("sportsPerson", "clubs", "club", _CLUB.format(a="d", b="s"))

_IN = "membership m join {o} on m.owner_id = {o0}.id and m.t = '{t}' join sgo {g} on m.sgo_id = {g}.ext_id"
for t, plural in [("competition", "competitions"), ("team", "teams"), ("club", "clubs"), ("nation", "nations"), ("venue", "venues")]:
    e = table_of(t)
    if t != "venue":
        _add(t, "sgos", "sgo", _IN.format(o=f"{e} s", o0="s", t=t, g="d"))
    _add("sgo", plural, t, _IN.format(o=f"{e} d", o0="d", t=t, g="s"))

_cols = _COLS.format(s="s", d="d")
PARTS["e_venue_sgos"] = (
    f"select {_cols} from {_IN.format(o='venue s', o0='s', t='venue', g='d')} "
    f"union select {_cols} from sgo d join venue s on d.venue_id = s.ext_id"
)
PARTS["e_sgo_sgos"] = (
    f"select {_cols} from {_IN.format(o='sgo s', o0='s', t='sgo', g='d')} "
    f"union select {_cols} from {_IN.format(o='sgo d', o0='d', t='sgo', g='s')}"
)
EDGES += [("venue", "sgos", "sgo"), ("sgo", "sgos", "sgo")]


def labelled(src: str, field: str, dst: str) -> str:
    return f"select '{src}' as src_type, src_id, src_key, '{field}' as field, '{dst}' as dst_type, dst_id, dst_key from {_name(src, field)}"


PARTS["all_edges"] = " union all ".join(labelled(*e) for e in EDGES if e not in (("keyMoment", "teams", "team"),))


def fields_of(src: str) -> list[tuple[str, str]]:
    return [(f, d) for s, f, d in EDGES if s == src]


def query(body: str, **extra: str) -> str:
    """`body` with the parts it needs as WITH clauses; `extra` adds parts of its own, in order."""
    parts = {**{k: v for k, v in extra.items() if k.startswith("new_")}, **PARTS, **extra}
    order = list(parts)
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & set(parts) - needed:
            needed.add(name)
            todo.append(parts[name])
    clauses = [f"{name} as ({parts[name]})" for name in order if name in needed]
    return ("with recursive " + ",\n".join(clauses) + "\n" if clauses else "") + body
