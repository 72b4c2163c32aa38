"""What a query leaves to its last step, which keeps all its shuffle files until the rows are read."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tests import small
from xrel.operators import docs, edges
from xrel.operators import maintain as M
from xrel.operators.edges import all_edges
from xrel.plans import QUERIES
from xrel.plans.edge_queries import edge_counts
from xrel.session import cut_lineage, in_slices
from xrel.sources.store import VersionedTable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_rebuild_is_written_type_by_type(spark):
    es = small.entities(spark)
    stored = cut_lineage(all_edges(es))
    touched = stored.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"))
    built = M.rebuild(es, stored, touched)
    assert "Exchange" not in plan(built)
    assert built.where("type = 'event' and id = 'event:e1' and status = 'ok'").count() == 1


def test_documents_of_many_edges_are_built_in_slices(spark, monkeypatch):
    es = small.entities(spark)
    stored = cut_lineage(all_edges(es).where("src_type = 'event'"))
    for part_rows in (docs.PART_ROWS, 1):
        want = docs.build_docs(es, "event", part_rows, edges=stored)
        assert "hashpartitioning(src_id" in plan(want)
        with monkeypatch.context() as m:
            m.setattr(docs, "SLICE_ROWS", 0)
            m.setattr(docs, "in_slices", partial(in_slices, least=0))
            got = docs.build_docs(es, "event", part_rows, edges=stored)
        assert "Exchange" not in plan(got) and got.columns == want.columns
        assert sorted(map(str, docs.flat_docs(got, "event").collect())) == sorted(map(str, docs.flat_docs(want, "event").collect()))


def test_documents_without_hubs_are_not_shuffled_again_for_their_headers(spark):
    es = small.entities(spark)
    built = plan(docs.build_docs(es, "event", edges=cut_lineage(all_edges(es).where("src_type = 'event'"))))
    assert "hashpartitioning(src_id, 0" not in built and "hashpartitioning(src_id, part_no" not in built


def test_rankings_are_worked_out_once(spark):
    last = plan(QUERIES["doc_ranking"](spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in last and "Window" not in last


def test_sorted_items_are_not_derived_again(spark):
    assert "lineitem" not in plan(QUERIES["sort_items"](spark, "/root/testdata/sf0.001"))


def test_edges_are_joined_and_counted_in_slices(spark, monkeypatch):
    es = small.entities(spark)
    want = sorted(map(str, all_edges(es).collect()))
    monkeypatch.setattr(edges, "in_slices", partial(in_slices, least=0))
    got = all_edges(es)
    assert sorted(map(str, got.collect())) == want
    once, parts = (sorted(map(str, edge_counts(got, least=n).collect())) for n in (10_000, 0))
    assert once == parts and len(once) > 10


def test_versions_are_compressed_in_the_order_of_their_keys(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    table.write_full(spark.range(1000).selectExpr("string(999 - id) as k", "id as v").coalesce(1))
    (file,) = (tmp_path / "t" / "v0000000001-full").glob("part-*")
    assert file.name.endswith(".zstd.parquet")
    stored = [r.k for r in spark.read.parquet(str(file)).collect()]
    assert stored == sorted(stored) and len(stored) == 1000
