from __future__ import annotations

import gc
import os
import time

from pyspark.sql import functions as F

from xrel.operators import maintain as M
from xrel.operators.edges import EDGE_COLUMNS
from xrel.session import collect_dropped, cut_lineage, dropped, in_slices, shared_dir


def steps(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("step-")}


def shuffles(spark):
    resolver = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().shuffleManager().shuffleBlockResolver()
    return set(filter(None, resolver.getStoredShuffles().mkString(" ").replace(",", " ").split()))


def test_a_written_step_leaves_no_shuffle_files_and_no_rows_of_java(spark):
    known, left = steps(spark), shuffles(spark)
    rows = cut_lineage(spark.range(20_000).select((F.col("id") % 5_000).alias("k"), F.lit(None).alias("v")).groupBy("k", "v").count())
    assert shuffles(spark) <= left
    assert rows.columns == ["k", "v", "count"] and rows.count() == 5_000 and rows.where("v is null and count = 4").count() == 5_000
    (new,) = steps(spark) - known
    files = [f for f in os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{new}") if f.startswith("part-")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_a_written_step_stays_while_a_plan_reads_it(spark):
    known = steps(spark)
    derived = cut_lineage(spark.range(10)).where("id > 3").select((F.col("id") + 1).alias("n"))
    gc.collect()
    collect_dropped(spark)
    assert len(steps(spark) - known) == 1 and derived.count() == 6
    del derived
    for _ in range(20):
        # What the JVM has done last may still hold the plan.
        spark.range(1).count()
        gc.collect()
        collect_dropped(spark)
        if not steps(spark) - known:
            break
        time.sleep(0.2)
    assert not steps(spark) - known
    dropped(cut_lineage(spark.range(3)))
    assert not steps(spark) - known


def edges(spark, ids):
    rows = [("team", f"team:{i}", f"{i} @ x" if i % 3 else None, "events", "event", f"event:{i % 4}", f"{i % 4} @ x") for i in ids]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in EDGE_COLUMNS))


def test_slices_give_what_one_step_gives(spark):
    old, new = edges(spark, [*range(40), 7]), edges(spark, [*range(20, 60), 30])
    whole, parts = (sorted(map(str, in_slices(M._edge_ops, [old, new], ["src_id", "dst_id"], least=n).collect())) for n in (1_000, 0))
    assert whole == parts and len(whole) == 40
    ops = M.edge_ops(old, new)
    applied = in_slices(M._applied, [old, ops], ["src_key", "dst_key"], least=0)
    assert sorted(map(str, applied.collect())) == sorted(map(str, M._applied(old, ops).collect()))
    assert sorted(map(str, applied.distinct().collect())) == sorted(map(str, new.distinct().collect()))
