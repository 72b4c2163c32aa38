"""Declared schemas of the twelve entity types, and the reference arrays inside them."""

from __future__ import annotations

COMMON = (
    "id string, ext_id string, ext_scope string, resource_type string, "
    "name map<string,string>, default_language string, tags array<struct<name:string,value:string>>"
)
PARTICIPANTS = (
    "participants array<struct<team_id:string,team_scope:string,sp_id:string,sp_scope:string,"
    "tags:array<struct<name:string,value:string>>>>"
)
MEMBERS = "members array<struct<sp_id:string,sp_scope:string>>"
MEMBERSHIPS = "memberships array<struct<sgo_id:string,sgo_scope:string>>"


def _fk(*prefixes: str) -> str:
    return ", ".join(f"{p}_id string, {p}_scope string" for p in prefixes)


# Extra columns per type, next to the common ones.
EXTRA = {
    "competition": f"start timestamp_ntz, {MEMBERSHIPS}",
    "stage": _fk("competition"),
    "event": f"{_fk('stage', 'venue')}, date_time timestamp_ntz, {PARTICIPANTS}",
    "team": f"{_fk('club', 'nation', 'venue')}, {MEMBERS}, {MEMBERSHIPS}",
    "venue": MEMBERSHIPS,
    "club": f"{_fk('venue')}, {MEMBERS}, {MEMBERSHIPS}",
    "sgo": f"{_fk('venue')}, {MEMBERSHIPS}",
    "nation": f"{_fk('venue')}, {MEMBERSHIPS}",
    "sportsPerson": "last_name map<string,string>",
    "staff": f"{_fk('sp', 'team', 'club', 'nation')}, last_name map<string,string>",
    "ranking": f"{_fk('stage', 'event', 'team', 'sp')}, date_time_label string, ranking double",
    "keyMoment": f"{_fk('event')}, type string, sub_type string, date_time timestamp_ntz, {PARTICIPANTS}",
}

TYPES = tuple(EXTRA)

# Raw tables that are only ever read by key.
LOOKUP_ONLY = ("stickies", "relationships", "stories")

# Reference arrays per type.
ARRAYS = {
    t: tuple(a for a in ("participants", "members", "memberships") if f"{a} array" in extra)
    for t, extra in EXTRA.items()
}


def ddl(entity_type: str) -> str:
    return f"{COMMON}, {EXTRA[entity_type]}"
