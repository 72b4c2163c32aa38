"""A few hand-made entities with the awkward cases."""

from __future__ import annotations

import tempfile
from datetime import datetime

from xrel.sources import schemas
from xrel.sources.entities import EntitySet, load_entities

S = "x"


def pair(prefix, value, scope=S):
    return {f"{prefix}_id": value, f"{prefix}_scope": scope if value is not None else None}


def participant(team=None, person=None, tags=None):
    return {**pair("team", team), **pair("sp", person), "tags": tags}


def person(ext_id):
    return {"sp_id": ext_id, "sp_scope": S}


def body(ext_id):
    return {"sgo_id": ext_id, "sgo_scope": S}


ROWS = {
    "competition": [{"ext_id": "c1", "start": datetime(2024, 1, 1), "memberships": [body("o1"), body("o1"), body("gone"), {"sgo_id": "o2", "sgo_scope": None}]}],
    "stage": [{"ext_id": "s1", **pair("competition", "c1")}, {"ext_id": "s2", **pair("competition", None)}],
    "event": [
        {
            "ext_id": "e1", **pair("stage", "s1"), **pair("venue", "v1"), "date_time": datetime(2024, 5, 1, 20),
            "participants": [
                participant("t1"), participant("t1"), participant("t2", "p1"), participant(None, "p2"),
                participant("t2", ""), participant("nobody"), {**pair("team", "t3"), "sp_id": "p1", "sp_scope": None, "tags": None},
            ],
        },
        {"ext_id": "e2", **pair("stage", "missing"), **pair("venue", None), "participants": []},
        {"ext_id": "", **pair("stage", "s1"), **pair("venue", "v1"), "participants": None},
    ],
    "team": [
        {"ext_id": "t1", **pair("club", "b1"), **pair("nation", "n1"), **pair("venue", "v1"), "members": [person("p1"), person("p1"), person(""), person("gone")], "memberships": [body("o1")]},
        {"ext_id": "t2", **pair("club", None), **pair("nation", "n1"), **pair("venue", None)},
        {"ext_id": "t3"},
    ],
    "venue": [{"ext_id": "v1", "memberships": [body("o1")]}],
    "club": [{"ext_id": "b1", **pair("venue", "v1"), "members": [person("p2")], "memberships": [body("o2")]}],
    "sgo": [{"ext_id": "o1", **pair("venue", "v1"), "memberships": [body("o2")]}, {"ext_id": "o2", "memberships": [body("o1")]}],
    "nation": [{"ext_id": "n1", "memberships": [body("o2")]}],
    "sportsPerson": [{"ext_id": "p1", "last_name": {"en": "One"}}, {"ext_id": "p2", "last_name": {"fr": "Deux"}}],
    "staff": [
        {"ext_id": "f1", **pair("sp", "p1"), **pair("team", "t1")},
        {"ext_id": "f2", **pair("sp", "p2"), **pair("club", "b1")},
        {"ext_id": "f3", **pair("sp", "p2"), **pair("nation", "n1")},
        {"ext_id": "f4", **pair("sp", "p1"), **pair("team", "t2"), **pair("club", "b1")},
        {"ext_id": "f5", **pair("sp", "p1")},
    ],
    "ranking": [
        {"ext_id": "r0", **pair("stage", "s1"), **pair("team", "t1"), "date_time_label": "latest", "ranking": 0.0},
        {"ext_id": "r1", **pair("event", "e1"), **pair("sp", "p1"), "date_time_label": "latest", "ranking": 1.5},
        {"ext_id": "r2", **pair("event", "e1"), **pair("team", "t2"), **pair("sp", "p2"), "date_time_label": "latest", "ranking": 2.0},
        {"ext_id": "r3", **pair("stage", "s1"), "date_time_label": "latest", "ranking": 3.0},
        {"ext_id": "r4", **pair("stage", "s1"), **pair("team", "t2"), "date_time_label": None, "ranking": 4.0},
    ],
    "keyMoment": [
        {"ext_id": "k1", **pair("event", "e1"), "type": "goal", "sub_type": "header", "date_time": datetime(2024, 5, 1, 20, 10, 5, 123456), "participants": [participant("t1"), participant("t2", "p1")]},
        {"ext_id": "k2", **pair("event", "e1"), "type": None, "sub_type": "card", "date_time": datetime(2024, 5, 1, 20, 20), "participants": [participant(None, "p2")]},
    ],
}


def entities(spark) -> EntitySet:
    """The rows above, written once per test run and read back with the declared schemas."""
    global _folder
    if _folder is None:
        _folder = tempfile.mkdtemp(prefix="small-")
        for t, df in _frames(spark).items():
            df.coalesce(1).write.parquet(f"{_folder}/{t}")
    return load_entities(spark, _folder)


_folder: str | None = None


def _frames(spark):
    tables = {}
    for t in schemas.TYPES:
        schema = spark.createDataFrame([], schemas.ddl(t)).schema
        rows = []
        for r in ROWS[t]:
            full = {
                "id": f"{t}:{r['ext_id']}", "ext_scope": S, "resource_type": t, "name": {"en": f"{t} {r['ext_id']}"},
                "default_language": "en", **r,
            }
            rows.append(tuple(full.get(f.name) for f in schema.fields))
        tables[t] = spark.createDataFrame([_nested(r, schema) for r in rows], schema)
    return tables


def _nested(row, schema):
    out = []
    for value, f in zip(row, schema.fields):
        if isinstance(value, list) and value and isinstance(value[0], dict):
            names = f.dataType.elementType.names
            value = [tuple(v.get(n) for n in names) for v in value]
        out.append(value)
    return tuple(out)
