from __future__ import annotations

from xrel.operators import paths as P
from xrel.operators.relations import type_aliases, type_edges


def search(spark, root, edges, views, **limits):
    specs = spark.createDataFrame([(1, root, edges, views)], "spec_id int, root string, edges string, views array<string>")
    rows = P.allowed_edge_routes(specs, type_edges(spark), type_aliases(spark), **limits).orderBy("route_no").collect()
    return [(r.target, r.via.split("|")) for r in rows]


STAGES, EVENTS, TEAMS = "competition.stages->stage", "stage.events->event", "event.teams->team"


def test_unordered_edges_and_aliases(spark):
    found = search(spark, "sgo", "club.v, O.Nation, n.team, sgo.club, t.venue", ["venue"])
    assert found == [
        ("venue", ["sgo.clubs->club", "club.venues->venue"]),
        ("venue", ["sgo.nations->nation", "nation.teams->team", "team.venues->venue"]),
    ]


def test_unreachable_and_unknown_edges_are_ignored(spark):
    assert search(spark, "competition", "c.s, venue.event, x.y, e.z, , a.b.c", ["stage", "event"]) == [("stage", [STAGES])]
    assert search(spark, "competition", "venue.event", ["event"]) == []


def test_cycles_duplicates_and_limits(spark):
    edges = "c.s, s.c, s.e, e.s, s.e, C.S"
    assert search(spark, "competition", edges, ["stage", "competition", "event"]) == [("stage", [STAGES]), ("event", [STAGES, EVENTS])]
    deep = "c.s, s.e, e.t"
    assert search(spark, "competition", deep, ["team"], max_depth=2) == []
    assert len(search(spark, "competition", deep, ["team"], max_depth=3)) == 1
    several = "c.s, s.e, e.t, c.o, o.t"
    assert len(search(spark, "competition", several, ["team"], max_routes=1)) == 1
    assert len(search(spark, "competition", several, ["team"], max_routes=2)) == 2


def test_derived_routes_respect_scope(spark):
    requests = spark.createDataFrame(
        [(1, "competition", "team"), (2, "venue", "stage"), (3, "team", "team"), (4, "sgo", "venue"), (5, "competition", "nothing")],
        "request_id int, root string, target string",
    )
    routes, errors = P.derive_routes(requests, type_edges(spark))
    got = {r.request_id: (r.route_key, r.via) for r in routes.collect()}
    assert got[1] == ("team_3hops", f"{STAGES}|{EVENTS}|{TEAMS}")
    assert got[4] == ("venue_1hops", "sgo.venues->venue")
    assert 3 not in got
    # From an unscoped root no path may pass from one scoped type to another.
    assert {r.request_id for r in errors.collect()} == {2, 5}


def test_route_faults(spark):
    rows = [
        ("fine", "competition", "team", [STAGES, EVENTS, TEAMS]),
        ("gap", "competition", "team", [STAGES, TEAMS]),
        ("field", "competition", "stage", ["competition.phases->stage"]),
        ("target", "competition", "event", ["competition.stages->event"]),
        ("cycle", "competition", "competition", [STAGES, "stage.competitions->competition"]),
        ("end", "competition", "team", [STAGES, EVENTS]),
        ("none", "competition", "team", []),
        ("text", "competition", "team", ["competition"]),
    ]
    routes = spark.createDataFrame(rows, "route_key string, root string, target string, via array<string>")
    got = {r.route_key: (r.hop_no, r.reason) for r in P.validate_routes(routes, type_edges(spark)).collect()}
    assert got == {
        "gap": (1, "non_contiguous"), "field": (0, "unknown_edge"), "target": (0, "wrong_target"), "cycle": (1, "cycle"),
        "end": (1, "wrong_end"), "none": (0, "empty"), "text": (0, "bad_edge"),
    }
