"""Reading rows and documents by key, and checks on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the scope under which an id is the internal one.
INTERNAL_SCOPE = "internal"
PRIVATE = ("_original", "_stickies")


def lookup_by_key(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows for requests of (scope, key_id): by natural key, or by `id` under the internal scope.

    Requests without a match stay, with nulls.
    """
    internal = F.coalesce(F.lower("scope") == INTERNAL_SCOPE, F.lit(False))
    # One join per form of request, so the table behind is never doubled.
    by_id = requests.where(internal).join(rows, F.col("key_id") == rows["id"], "left")
    by_key = requests.where(~internal).join(
        rows, (F.col("scope") == rows["ext_scope"]) & (F.col("key_id") == rows["ext_id"]), "left"
    )
    return by_id.unionByName(by_key)


def strip_private(rows: DataFrame, include_original: bool = False, include_stickies: bool = False) -> DataFrame:
    """Drop `stickies` always, the private columns unless asked for."""
    keep = {"_original": include_original, "_stickies": include_stickies}
    return rows.drop("stickies", *(c for c in PRIVATE if not keep[c]))


def exists_check(requests: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Each request with status ok or not_found."""
    present = rows.select(*on).distinct().withColumn("_found", F.lit(True))
    status = F.when(F.col("_found"), F.lit("ok")).otherwise(F.lit("not_found"))
    return requests.join(present, on, "left").withColumn("status", status).drop("_found")


def unique_key_violations(docs: DataFrame, *keys: list[str]) -> DataFrame:
    """Key values that more than one row carries, per key."""
    parts = []
    for key in keys:
        value = F.concat_ws("|", *key)
        repeated = docs.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(repeated.select(F.lit(",".join(key)).alias("key"), value.alias("value"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fetch_by_ids(included: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows named by `dst_id` in `included`."""
    return included.join(rows, included["dst_id"] == rows["id"]).drop("dst_id")


def read_doc(docs: DataFrame, doc_type: str, key: str) -> DataFrame:
    """All parts of one document; with a table partitioned by type only that partition is read."""
    return docs.where((F.col("resource_type") == doc_type) & (F.col("external_key") == key))
