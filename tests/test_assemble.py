from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests import small
from xrel.operators import assemble as A
from xrel.operators.edges import all_edges, reader, stored_reader, write_edges
from xrel.operators.docs import all_docs
from xrel.operators.lookup import lookup_by_key, read_doc, unique_key_violations
from xrel.plans.request import BadRequest, Request, answer
from xrel.sources import schemas, tpch
from xrel.sources.entities import load_entities
from xrel.sources.store import VersionedTable

SF = "/root/testdata/sf0.001"
ROUTES = [
    A.route("competition.stages->stage"),
    A.route("competition.stages->stage", "stage.events->event", "event.teams->team"),
    A.route("competition.sgos->sgo", "sgo.teams->team"),
]
TYPES = ["competition", "team", "stage"]


def run(es, read, limit):
    roots = es.tables["competition"].select(F.col("id").alias("request_id"), F.col("id").alias("dst_id"))
    return A.assemble(roots, "competition", ROUTES, TYPES, read, limit)


@pytest.mark.parametrize("limit", [0, 1, 5, 50])
def test_budget_and_overflow_make_up_the_whole(spark, limit):
    es = tpch.entities(spark, SF)
    got = run(es, reader(es), limit)
    ids = {tuple(r) for r in got.ids.select("request_id", "dst_type", "dst_id").collect()}
    items = [tuple(r) for r in got.included.select("request_id", "dst_type", "dst_id").collect()]
    rest = [tuple(r) for r in got.overflow.select("request_id", "dst_type", "dst_id").collect()]
    assert set(items) | set(rest) == ids and len(items) + len(rest) == len(ids)
    per_request = {r: [i for i in items if i[0] == r] for r, _, _ in ids}
    for request, mine in per_request.items():
        total = sum(i[0] == request for i in ids)
        assert len(mine) == min(limit, total)
        if limit:
            assert (request, "competition", request) in mine


def test_stored_edges_give_the_same(spark, tmp_path):
    es = tpch.entities(spark, SF)
    write_edges(all_edges(es), str(tmp_path / "edges"))
    stored = spark.read.parquet(str(tmp_path / "edges"))
    one, two = (run(es, r, 20).included.drop("place") for r in (reader(es), stored_reader(stored)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_limit_out_of_range_falls_back():
    assert [A.item_limit(n) for n in (None, -1, 51, 0, 7, 50)] == [50, 50, 50, 0, 7, 50]


def test_pages(spark):
    rows = [("r", "team", f"t{i:03d}") for i in range(23)] + [("r", "event", "e1")]
    rest = spark.createDataFrame(rows, "request_id string, dst_type string, dst_id string")
    pages = {(r.dst_type, r.page): r for r in A.overflow_pages(rest, 10, bucket_rows=5).collect()}
    assert pages["team", 2].query == "(or _id==`t020` _id==`t021` _id==`t022`)"
    assert pages["event", 0].query == "_id==`e1`" and len(pages) == 4
    assert A.overflow_pages(rest, 0).count() == 24


def test_views(spark):
    df = spark.createDataFrame([(1, " team, ,venue,team"), (2, "")], "request_id int, views string")
    got = [tuple(r) for r in A.views_normalise(df).orderBy("request_id", "view_no").collect()]
    assert got == [(1, 0, "team"), (1, 1, "venue")]


def test_sort_order(spark):
    es = small.entities(spark)
    rows = [("q", "ranking", f"ranking:r{i}") for i in range(5)] + [("q", "sportsPerson", f"sportsPerson:p{i}") for i in (1, 2)]
    included = spark.createDataFrame(rows, "request_id string, dst_type string, dst_id string")
    placed = A.sort_items(included, es, ["ranking", "sportsPerson"]).orderBy("dst_type", "position").collect()
    assert [r.id for r in placed] == [
        "ranking:r4", "ranking:r3", "ranking:r0", "ranking:r2", "ranking:r1", "sportsPerson:p1", "sportsPerson:p2",
    ]


def test_shape_has_empty_defaults(spark):
    es = tpch.entities(spark, SF)
    got = run(es, reader(es), 3)
    roots = es.tables["competition"].select(F.col("id").alias("request_id"), F.col("id").alias("dst_id"))
    shape = A.result_shape(roots, got.included, got.overflow, [*TYPES, "venue"], ROUTES)
    assert {(r.items, r.overflow) for r in shape.where("dst_type = 'venue'").collect()} == {(0, 0)}


@pytest.mark.parametrize(
    "asked,code",
    [
        (Request("competition", " , "), "NO_VIEWS"),
        (Request("competition", "team,planet"), "UNKNOWN_TYPE"),
        (Request("team", "keyMoment"), "KEY_MOMENT_ROOT"),
        (Request("venue", "stage"), "UNREACHABLE_AUTO_ROUTE"),
        (Request("competition", "team,ranking", edges="c.s,s.e,e.t"), "UNREACHABLE_BY_ROUTES"),
    ],
)
def test_requests_that_cannot_be_served(spark, asked, code):
    es = small.entities(spark)
    roots = spark.createDataFrame([("q", "c1 @ x")], "request_id string, root_key string")
    with pytest.raises(BadRequest) as caught:
        answer(es, reader(es), roots, asked)
    assert caught.value.code == code


def test_request_over_given_edges(spark):
    es = small.entities(spark)
    roots = spark.createDataFrame([("q", "c1 @ x"), ("lost", "none @ x")], "request_id string, root_key string")
    asked = Request("competition", "competition,event,team", "e.t, c.s, s.e", 2, {"event": ["participants.team"]}, {"all": ["tags"]})
    got = answer(es, reader(es), roots, asked)
    assert [r.id for r in got.items["competition"].collect()] == ["competition:c1"]
    event = got.items["event"].collect()
    # Requested columns, and the place of each item within its request.
    assert set(got.items["event"].columns) == {"request_id", "id", "participants", "position"}
    assert [(r.id, r.position) for r in event] == [("event:e1", 1)]
    assert got.items["team"].count() == 0 and "tags" not in got.items["team"].columns
    assert {(r.dst_type, r.n) for r in got.counts.collect()} == {("competition", 1), ("event", 1), ("team", 2), (None, 4)}
    assert [r.query for r in got.pages.collect()] == ["(or _id==`team:t1` _id==`team:t3`)"]


def test_rows_by_natural_or_internal_key(spark, tmp_path):
    es = small.entities(spark)
    asked = spark.createDataFrame([("x", "t1"), ("INTERNAL", "team:t2"), ("x", "team:t2"), ("y", "t1")], "scope string, key_id string")
    got = {(r.scope, r.key_id): r.id for r in lookup_by_key(asked, es.tables["team"]).collect()}
    assert got == {("x", "t1"): "team:t1", ("INTERNAL", "team:t2"): "team:t2", ("x", "team:t2"): None, ("y", "t1"): None}


def test_tables_survive_a_round_trip(spark, tmp_path):
    es = small.entities(spark)
    for t in schemas.TYPES:
        es.tables[t].write.parquet(f"{tmp_path}/{t}")
    back = load_entities(spark, str(tmp_path))
    for t in schemas.TYPES:
        assert sorted(map(str, back.rows(t).collect())) == sorted(map(str, es.rows(t).collect()))


def test_documents_of_all_types_in_one_table(spark, tmp_path):
    es = small.entities(spark)
    table = VersionedTable(spark, str(tmp_path / "docs"), ["resource_type", "external_key"], ("resource_type",))
    docs = all_docs(es)
    table.write_full(docs)
    assert unique_key_violations(table.read(), ["resource_type", "external_key"], ["resource_type", "id"]).isEmpty()
    changed = read_doc(table.read(), "team", "t1 @ x").withColumn("name", F.lit("renamed"))
    table.upsert(changed, es.rows("venue").select(F.lit("venue").alias("resource_type"), "external_key"))
    now = {(r.resource_type, r.external_key): r for r in table.read().collect()}
    assert now["team", "t1 @ x"].name == "renamed" and now["team", "t1 @ x"].clubs == ["club:b1"]
    assert len(now) == docs.count() - 1 and ("venue", "v1 @ x") not in now
    assert now["stage", "s1 @ x"].clubs is None and now["stage", "s1 @ x"].eventKeys == {"e1 @ x": "event:e1"}
