from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests import small
from xrel.operators.docs import build_docs, flat_docs, headers
from xrel.operators.edges import all_edges, edges_from_type, edges_of
from xrel.operators.relations import TYPE_GRAPH, inverse_field
from xrel.sources import tpch


@pytest.fixture(scope="module")
def es(spark):
    return small.entities(spark)


def links(df):
    return sorted((r.src_id.split(":")[1], r.dst_id.split(":")[1]) for r in df.collect())


@pytest.mark.parametrize(
    "src,field,expected",
    [
        ("competition", "sgos", [("c1", "o1")]),
        ("competition", "stages", [("c1", "s1")]),
        ("stage", "competitions", [("s1", "c1")]),
        # An event with an empty id is no target.
        ("stage", "events", [("s1", "e1")]),
        ("event", "stages", [("", "s1"), ("e1", "s1")]),
        # A participant with a complete person pair is a person, even when that id is empty.
        ("event", "teams", [("e1", "t1"), ("e1", "t3")]),
        ("event", "sportsPersons", [("e1", "p1"), ("e1", "p2")]),
        ("team", "events", [("t1", "e1"), ("t2", "e1"), ("t3", "e1")]),
        ("sportsPerson", "events", [("p1", "e1"), ("p2", "e1")]),
        ("team", "sportsPersons", [("t1", "p1")]),
        ("club", "sportsPersons", [("b1", "p2")]),
        ("sportsPerson", "clubs", [("p2", "b1")]),
        ("sgo", "sgos", [("o1", "o2"), ("o2", "o1")]),
        ("venue", "sgos", [("v1", "o1")]),
        ("sgo", "venues", [("o1", "v1")]),
        ("team", "staff", [("t1", "f1"), ("t2", "f4")]),
        ("club", "staff", [("b1", "f2"), ("b1", "f4")]),
        ("nation", "staff", [("n1", "f3")]),
        ("sportsPerson", "staff", [("p1", "f1"), ("p1", "f4"), ("p2", "f2"), ("p2", "f3")]),
        ("stage", "rankings", [("s1", "r0")]),
        ("event", "rankings", [("e1", "r1"), ("e1", "r2")]),
        ("team", "rankings", [("t1", "r0"), ("t2", "r2")]),
        ("sportsPerson", "rankings", [("p1", "r1"), ("p2", "r2")]),
        # The kind of r2 is event and team, so its person is not followed from it.
        ("ranking", "sportsPersons", [("r1", "p1")]),
        ("ranking", "teams", [("r0", "t1"), ("r2", "t2")]),
        ("keyMoment", "teams", [("k1", "t1")]),
        ("team", "keyMoments", [("t1", "k1")]),
        ("keyMoment", "sportsPersons", [("k1", "p1")]),
        ("sportsPerson", "keyMoments", [("p1", "k1")]),
        # A moment without a type has no document but is still listed by its event.
        ("keyMoment", "events", [("k1", "e1")]),
        ("event", "keyMoments", [("e1", "k1"), ("e1", "k2")]),
    ],
)
def test_edges(es, src, field, expected):
    assert links(edges_of(es, src, field)) == expected


def test_both_directions_in_one_pass_match_single_fields(es):
    whole = {tuple(r) for r in all_edges(es).collect()}
    single = {tuple(r) for t in TYPE_GRAPH for r in edges_from_type(es, t).collect()}
    assert whole == single and len(whole) > 50


def test_composite_keys(es):
    keys = {r.dst_id: r.dst_key for r in edges_of(es, "sportsPerson", "rankings").collect()}
    assert keys["ranking:r1"] == "e1 @ x /esp/ p1 @ x /label/ latest /rank/ 1.5"
    assert keys["ranking:r2"] == "e1 @ x /esp/ p2 @ x /label/ latest /rank/ 2"
    own = {r.id: r.external_key for r in es.rows("ranking").collect()}
    assert own["ranking:r2"] == "e1 @ x /et/ t2 @ x /label/ latest /rank/ 2"
    assert own["ranking:r0"].endswith("/rank/ 0") and own["ranking:r3"] is None and own["ranking:r4"] is None
    moments = {r.dst_id: r.dst_key for r in edges_of(es, "event", "keyMoments").collect()}
    assert moments["keyMoment:k1"] == "2024-05-01T20:10:05.123Z @ e1 @ x @ goal @ header"
    assert moments["keyMoment:k2"] == "2024-05-01T20:20:00.000Z @ e1 @ x @  @ card"
    club = {r.dst_id: r.dst_key for r in edges_of(es, "club", "staff").collect()}
    assert club["staff:f4"] == "p1 @ x /club/ b1 @ x"


def test_headers_and_names(es):
    assert {r.id for r in headers(es, "staff").collect()} == {"staff:f1", "staff:f2", "staff:f3"}
    docs = {r.id: r for r in build_docs(es, "event").collect()}
    assert docs["event:e2"].teams == [] and docs["event:e2"].teamKeys == {}
    assert docs["event:e1"].teamKeys == {"t1 @ x": "team:t1", "t3 @ x": "team:t3"}
    assert docs["event:e1"].last_updated is not None
    names = {r.id: r.name for r in headers(es, "sportsPerson").collect()}
    assert names == {"sportsPerson:p1": "One", "sportsPerson:p2": None}
    assert {r.name for r in headers(es, "keyMoment").collect()} == {"keyMoment k1"}


def test_one_id_per_key(es, spark):
    twin = es.tables["venue"].withColumn("id", F.lit("venue:zz"))
    doubled = es.replaced({"venue": es.tables["venue"].unionByName(twin)})
    doc = build_docs(doubled, "club").collect()[0]
    assert doc.venues == ["venue:v1", "venue:zz"] and doc.venueKeys == {"v1 @ x": "venue:zz"}


SF = "/root/testdata/sf0.001"


def test_pairs_of_inverse_fields_agree(spark):
    edges = all_edges(tpch.entities(spark, SF)).select("src_type", "src_id", "dst_type", "dst_id")
    found = {}
    for r in edges.collect():
        found.setdefault((r.src_type, r.dst_type), set()).add((r.src_id, r.dst_id))
    for (src, dst), pairs in found.items():
        if inverse_field(src, dst) is None:
            continue
        back = {(b, a) for a, b in found.get((dst, src), set())}
        if (src, dst) == ("event", "team"):
            assert pairs < back  # teams also list events where only their persons took part
        elif (src, dst) == ("team", "event"):
            assert pairs > back
        elif "sgo" in (src, dst) and "venue" in (src, dst):
            continue  # a venue also lists the bodies based there
        else:
            assert pairs == back, (src, dst)


def test_hubs_are_spread_over_parts_and_stay_whole(spark):
    es = tpch.entities(spark, SF)
    whole = {r.id: r for r in build_docs(es, "team").collect()}
    parts = build_docs(es, "team", part_rows=40).collect()
    assert max(r.part_no for r in parts) > 2
    for doc_id, doc in whole.items():
        mine = [p for p in parts if p.id == doc_id]
        for f in TYPE_GRAPH["team"]:
            assert sorted(i for p in mine for i in p[f]) == doc[f]
        assert sum(len(p.eventKeys) for p in mine) == len(doc.eventKeys)
        assert max(len(p.events) for p in mine) < 80


def test_only_limits_the_work(spark):
    es = tpch.entities(spark, SF)
    some = es.tables["team"].where("ext_id in ('1', '3')").select("id")
    chosen = sorted(map(str, flat_docs(build_docs(es, "team", only=some), "team").collect()))
    every = sorted(str(r) for r in flat_docs(build_docs(es, "team"), "team").collect() if r.id in ("team:1", "team:3"))
    assert chosen == every
