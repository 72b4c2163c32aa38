"""Exact row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xrel.session import cut_lineage

# A group's cut points travel as one array, so their number is bounded.
MAX_CUTS = 1024
# Cut points of up to this many large groups, some tens of megabytes at most, are broadcast; those of more groups are
# repeated once per salt, so that no group's rows meet in one task.
BROADCAST_GROUPS = 1000
SALTS = 32


def distributed_rank(
    df: DataFrame, group: list[str], order: str, name: str = "rank", bucket_rows: int = 1_000_000
) -> DataFrame:
    """Number rows 1..n by `order` (unique in its group) without one task holding a whole group.

    Groups above `bucket_rows` are cut into ranges at values picked by hash, each range is
    numbered on its own, and the sizes of the ranges before it are added. Smaller groups are
    one range, and without any large group this is a plain window. `group` columns must not be
    null; `df` is read several times, so it should be a stored or written-out table.
    """
    large = cut_lineage(df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > bucket_rows))
    if large.isEmpty():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(order)).cast("bigint"))
    step = F.ceil(F.greatest(F.lit(bucket_rows), F.col("_n") / F.lit(MAX_CUTS))).cast("bigint")
    cuts = (
        df.select(*group, order)
        .join(large, group)
        .where(F.pmod(F.xxhash64(order), step) == 0)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(order)).alias("_cuts"))
    )
    below = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    if large.count() <= BROADCAST_GROUPS:
        near = df.join(F.broadcast(cuts), group, "left")
    else:
        salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int"))
        near = dealt.join(salted, [*group, "_salt"], "left").drop("_salt")
    ranged = near.withColumn(
        "_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.where(F.col("_cuts").isNotNull())
        .groupBy(*group, "_range")
        .agg(F.count("*").alias("_size"))
        .select(*group, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order))
    numbered = ranged.drop("_cuts").withColumn("_inside", inside)
    return (
        numbered.join(offsets, [*group, "_range"], "left")
        .withColumn(name, F.col("_inside").cast("bigint") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_range", "_inside", "_before")
    )
