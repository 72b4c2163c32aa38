from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests import small
from xrel.operators import maintain as M
from xrel.operators.docs import build_docs, flat_docs
from xrel.operators.edges import edges_from_type, edges_of, labelled, reader
from xrel.sources import tpch
from xrel.sources.store import VersionedTable
from xrel.functions.version import json_text
from xrel.streaming.materialise import Materialiser, newest_rows, stream_materialise, unplaced

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_diff_then_apply_gives_the_new_state(spark):
    lines = tpch.table(spark, SF, "lineitem")
    old, new = (tpch.entities(spark, SF, lines=lines.where(c)) for c in ("l_linestatus = 'F'", "l_returnflag <> 'R'"))
    before, after = (edges_from_type(e, "team") for e in (old, new))
    ops = M.reference_diff(before, after)
    assert {r.op for r in ops.select("op").distinct().collect()} == {"add", "remove"}
    assert rows(M.apply_ops(before, ops)) == rows(after)
    assert rows(M.apply_ops(after, ops)) == rows(after)
    assert M.reference_diff(after, after).isEmpty()


def test_status_and_stubs(spark):
    es = small.entities(spark)
    asked = spark.createDataFrame([("t1 @ x",), ("none @ x",)], "external_key string")
    docs, status = M.build_one(es, "team", asked)
    assert {tuple(r) for r in status.collect()} == {("t1 @ x", "ok"), ("none @ x", "not_found")}
    assert [r.id for r in docs.collect()] == ["team:t1"]
    ops = M.inverse_ops(M.reference_diff(edges_from_type(es, "club").limit(0), edges_from_type(es, "club")))
    have = spark.createDataFrame([("team", "t1 @ x")], "resource_type string, external_key string")
    assert "t1 @ x" not in {r.external_key for r in M.stub_docs(ops, have).collect()}
    assert {r.resource_type for r in M.stub_docs(ops, have).collect()} == {"sgo", "venue", "sportsPerson", "staff"}


def test_closure_stops_on_cycles(spark):
    es = small.entities(spark)
    roots = es.rows("competition").select(F.col("id").alias("request_id"), F.lit("competition").alias("type"), "id", F.col("external_key").alias("key"))
    got = {r.id for r in M.recursive_closure(roots, ["sgo"], reader(es)).collect()}
    assert got == {"competition:c1", "sgo:o1", "sgo:o2"}
    touched = {r.id for r in M.rebuild_closure(roots.drop("type"), reader(es)).collect()}
    assert {"stage:s1", "event:e1", "team:t2", "staff:f4", "club:b1", "nation:n1", "venue:v1", "ranking:r1"} <= touched
    assert "stage:s2" not in touched and not any(i.startswith("keyMoment") for i in touched)


def test_change_states(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 2.0)], "id int, t string, d double")
    new = spark.createDataFrame([(1.0, 1, "a"), (2.5, 2, "b"), (9.0, 4, "d")], "d double, id int, t string")
    got = {r.id: r.state for r in M.change_detect(old, new, "id").collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "gone", 4: "new"}


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    assert table.is_empty()

    def frame(*items):
        return spark.createDataFrame(list(items), "k int, part int, v string")

    def state():
        return sorted(tuple(r) for r in table.read().select("k", "part", "v").collect())

    table.write_full(frame((1, 0, "a"), (1, 1, "b"), (2, 0, "c")))
    table.upsert(frame((1, 0, "x"), (3, 0, "z")), frame((2, 0, "")), number=2)
    assert state() == [(1, 0, "x"), (3, 0, "z")]
    table.upsert(frame((1, 0, "x"), (3, 0, "z")), frame((2, 0, "")), number=2)
    assert state() == [(1, 0, "x"), (3, 0, "z")]
    assert sorted(r.v for r in table.read(before=2).collect()) == ["a", "b", "c"]
    table.compact()
    table.upsert(frame((2, 0, "again")))
    assert state() == [(1, 0, "x"), (2, 0, "again"), (3, 0, "z")]
    # A write that never finished does not count.
    (tmp_path / "t" / "v0000000009-change").mkdir()
    assert state() == [(1, 0, "x"), (2, 0, "again"), (3, 0, "z")]


def test_versions_after_a_batch_is_run_again(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    frame = lambda *items: spark.createDataFrame(list(items), "k int, v string")
    state = lambda **at: sorted(tuple(r) for r in table.read(**at).select("k", "v").collect())
    table.upsert(frame((1, "a")), number=1)
    table.upsert(frame((1, "b"), (2, "c")), number=2)
    assert table.compact() == table.compact() == 2
    assert not table.is_empty(before=2) and state(before=2) == [(1, "a")]
    table.upsert(frame((1, "x"), (2, "c")), number=2)
    assert state() == [(1, "x"), (2, "c")]
    table.compact()
    table.upsert(frame((3, "d")), frame((2, "")), number=3)
    table.compact()
    table.expire(fulls=1)
    assert table.versions() == [(3, "full")] and state() == [(1, "x"), (3, "d")]


def test_newest_rows(spark):
    rows = spark.createDataFrame([(1, "old", 1, False), (1, "new", 2, False), (2, "a", 1, False), (2, "a", 3, True)], "id int, v string, seq int, gone boolean")
    got = {r.id: (r.v, r["_at"], r["_gone"]) for r in newest_rows(rows, "seq", "gone").collect()}
    assert got == {1: ("new", 2, False), 2: ("a", 3, True)}


def test_rows_without_a_place_are_kept_apart(spark, tmp_path):
    schema = "id int, v string, seq int"
    rows = spark.createDataFrame([(1, "a", 1), (1, "late", None), (None, "no id", 2)], schema)
    assert [(r.id, r.v) for r in newest_rows(rows, "seq").collect()] == [(1, "a")]
    target = Materialiser(spark, str(tmp_path), "keyMoment")
    for _ in range(2):
        target.reject(rows.where(unplaced("seq")), 3)
    target.reject(rows.limit(0), 4)
    assert sorted((r.v, r.batch) for r in target.rejected().collect()) == [("late", 3), ("no id", 3)]


def test_doubles_differ(spark):
    values = [1.2345678901234567e-5, 1.23456789012399e-5, 0.1, -0.001, 123456.789, 1234567890.125, 1e-6, 1.5e300, -2.5e-7, 12345678.5, 0.0001, 1e20, 1.2345678901234567e20, 98765432109876543210.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", json_text(F.col("v"), T.DoubleType()).alias("t")).collect()
    assert len({r.t for r in rows}) == len(values)
    for r in rows:
        assert float(r.t) == r.v and ("e" in r.t) == (not 1e-6 <= abs(r.v) < 1e21)


def test_stream_in_batches_equals_one_build(spark, tmp_path):
    es = tpch.entities(spark, SF)
    events = tpch.table(spark, SF, "events")
    # The second file changes the person of some moments that came first, and brings others again unchanged.
    first = events.where("event_id % 2 = 0").withColumn("user_id", F.when(F.col("event_id") % 10 == 0, 1).otherwise(F.col("user_id")))
    second = events.where("event_id % 2 = 1 or event_id % 5 = 0")
    inbox = str(tmp_path / "in")
    target = Materialiser(spark, str(tmp_path / "out"), "keyMoment", follow=("event",), compact_every=2)
    # All other edges are known before the stream starts.
    others = edges_from_type(es, "event").where("field <> 'keyMoments'")
    target.seed(others)

    def entities_with(changed):
        refs = changed.select(
            F.col("id").alias("owner_id"), F.col("external_key").alias("owner_key"),
            *(F.lit(None).cast("string").alias(c) for c in ("team_id", "team_scope")), "sp_id", "sp_scope",
        )
        return es.replaced({"keyMoment": changed.drop("external_key", "sp_id", "sp_scope")}, {("keyMoment", "participants"): refs})

    for turn, batch in enumerate((first, second)):
        batch = batch.withColumn("seq", F.lit(turn))
        batch.coalesce(1).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(batch.schema).parquet(inbox)
        to_rows = lambda records: tpch.key_moments(records, "seq")
        stream_materialise(arriving, to_rows, entities_with, target, str(tmp_path / "cp"), "seq").awaitTermination()
    want = build_docs(es, "keyMoment")
    docs = target.docs.read()
    events_with_moments = build_docs(es, "event").where("size(keyMoments) > 0")
    assert rows(flat_docs(docs.where("resource_type = 'event'"), "event")) == rows(flat_docs(events_with_moments, "event"))
    assert rows(flat_docs(docs.where("resource_type = 'keyMoment'"), "keyMoment")) == rows(flat_docs(want, "keyMoment"))
    stored = target.edges.read().where("src_type = 'sportsPerson' and field = 'keyMoments'").select("src_id", "dst_id")
    assert rows(stored) == rows(edges_of(es, "sportsPerson", "keyMoments").select("src_id", "dst_id"))
    kept = labelled(edges_of(es, "keyMoment", "sportsPersons"), "keyMoment", "sportsPersons").select("src_id", "dst_id")
    assert rows(target.edges.read().where("src_type = 'keyMoment' and field = 'sportsPersons'").select("src_id", "dst_id")) == rows(kept)
