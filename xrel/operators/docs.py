"""Aggregation documents: one header with related ids and keys per field.

A document is keyed by (type, key, part_no) and says how many parts it has (n_parts). Of a field with n references,
ceil(n / part_rows) parts hold a share each, dealt by a fixed hash of the reference's key; most documents have one part.
The rule is the same at every size, so no task gathers a whole hub.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.functions import keys
from xrel.operators.edges import edges_from_type
from xrel.operators.relations import TYPE_GRAPH
from xrel.session import SLICE_ROWS, cut_lineage, in_slices
from xrel.sources.entities import EntitySet, meta

PART_ROWS = 10_000
# Rows of two short columns; some tens of megabytes at most.
BROADCAST_ROWS = 200_000


def part_of(key: Column, parts: Column) -> Column:
    """The part that a reference with this key belongs to. Fixed rule: other engines can work it out as well."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % parts


def with_part(edges: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Add `part_no` and `n_parts`, the largest number of parts of any field of the source.

    Fields with more than one part are counted first: mostly there are none and edges need no join, a list of known
    and modest length is broadcast, and a longer one is joined like any table.
    """
    return _with_part(edges, part_rows)[0]


def _with_part(edges: DataFrame, part_rows: int) -> tuple[DataFrame, bool]:
    """The same, and whether there are hubs."""
    hubs = cut_lineage(
        edges.groupBy("src_id", "field")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > part_rows)
        .select("src_id", "field", F.ceil(F.col("_n") / F.lit(part_rows)).cast("bigint").alias("_parts"))
    )
    n_hubs = hubs.count()
    if n_hubs == 0:
        return edges.withColumns({"part_no": F.lit(0), "n_parts": F.lit(1)}), False
    near = F.broadcast if n_hubs <= BROADCAST_ROWS else lambda df: df
    most = hubs.groupBy("src_id").agg(F.max("_parts").alias("_most"))
    # Entries with one key stay together: the key map keeps one id per key.
    part = F.when(F.col("_parts").isNotNull(), part_of(F.coalesce("dst_key", "dst_id"), F.col("_parts"))).otherwise(F.lit(0))
    joined = (
        edges.join(near(hubs), ["src_id", "field"], "left").join(near(most), "src_id", "left")
        .withColumns({"part_no": part.cast("int"), "n_parts": F.coalesce("_most", F.lit(1)).cast("int")})
        .drop("_parts", "_most")
    )
    return joined, True


def _ids(pairs: Column) -> Column:
    return F.sort_array(F.array_distinct(pairs["id"]))


def _key_map(pairs: Column) -> Column:
    """Key -> id; of several ids under one key the largest stays."""
    names = pairs["key"]
    plain = F.map_from_arrays(names, pairs["id"])
    keyed = F.sort_array(F.filter(pairs, lambda p: p["key"].isNotNull()))
    last = F.filter(keyed, lambda p, i: F.coalesce(F.get(keyed, i + 1)["key"] != p["key"], F.lit(True)))
    unique = (F.size(F.array_distinct(names)) == F.size(names)) & ~F.exists(names, lambda n: n.isNull())
    return F.when(unique, plain).otherwise(F.map_from_entries(last))


def _pairs_of(field: str) -> Column:
    entry = F.struct(F.col("dst_key").alias("key"), F.col("dst_id").alias("id"))
    return F.collect_list(F.when(F.col("field") == field, entry))


def key_map_name(dst_type: str) -> str:
    return f"{dst_type}Keys"


def collapse_edges(edges: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Ids and key map per source, field and part."""
    entry = F.struct(F.col("dst_key").alias("key"), F.col("dst_id").alias("id"))
    grouped = with_part(edges, part_rows).groupBy("src_id", "field", "part_no").agg(F.collect_list(entry).alias("_p"))
    return grouped.select("src_id", "field", "part_no", _ids(F.col("_p")).alias("ids"), _key_map(F.col("_p")).alias("keys"))


def headers(entities: EntitySet, doc_type: str) -> DataFrame:
    """Rows that get a document: keyed, and for staff bound to exactly one organisation."""
    header = meta(entities, doc_type).where(F.col("external_key").isNotNull())
    if doc_type == "staff":
        header = header.where(keys.staff_org_count() == 1)
    return header


def build_docs(
    entities: EntitySet,
    doc_type: str,
    part_rows: int = PART_ROWS,
    edges: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Documents of one type; entities without relations keep empty lists.

    `only` (column id) limits the work to those entities: the semi joins sink to the tables below.
    """
    given = edges is not None
    edges = edges if given else edges_from_type(entities, doc_type)
    header = headers(entities, doc_type)
    if only is not None:
        edges = edges.join(only.select(F.col("id").alias("src_id")), "src_id", "left_semi")
        header = header.join(only.select("id"), "id", "left_semi")
    edges = edges.select("src_id", "field", "dst_id", "dst_key")
    build = partial(_joined, doc_type=doc_type, part_rows=part_rows)
    if given and edges.count() > SLICE_ROWS:
        docs = in_slices(build, [edges, header.withColumn("src_id", F.col("id"))], ["src_id"])
    else:
        docs = build(edges, header)
    return docs.withColumn("last_updated", F.current_timestamp())


def _joined(edges: DataFrame, header: DataFrame, doc_type: str, part_rows: int) -> DataFrame:
    """Headers with the ids and key maps of their edges."""
    fields = TYPE_GRAPH[doc_type]
    parted, hubs = _with_part(edges, part_rows)
    pairs = [_pairs_of(f).alias(f"_{f}") for f in fields]
    if hubs:
        gathered = parted.groupBy("src_id", "part_no").agg(F.max("n_parts").alias("n_parts"), *pairs)
    else:
        # Grouped by the source alone, they are where the join with the headers wants them.
        gathered = parted.groupBy("src_id").agg(F.lit(0).alias("part_no"), F.lit(1).alias("n_parts"), *pairs)
    # A source without edges of a field has an empty list; one without any edges has no row at all.
    lists = []
    for f, dst_type in fields.items():
        pairs = F.col(f"_{f}")
        lists += [_ids(pairs).alias(f), _key_map(pairs).alias(key_map_name(dst_type))]
    gathered = gathered.select(F.col("src_id").alias("_src_id"), "part_no", "n_parts", *lists)
    joined = header.join(gathered, header["id"] == gathered["_src_id"], "left").drop("_src_id", "src_id")
    no_ids = F.array().cast("array<string>")
    no_keys = F.create_map().cast("map<string,string>")
    filled = {"part_no": F.coalesce("part_no", F.lit(0)), "n_parts": F.coalesce("n_parts", F.lit(1))}
    for f, dst_type in fields.items():
        name = key_map_name(dst_type)
        filled[f] = F.coalesce(f, no_ids)
        filled[name] = F.coalesce(name, no_keys)
    return joined.withColumns(filled)


def all_docs(entities: EntitySet, part_rows: int = PART_ROWS) -> DataFrame:
    """Documents of every type under one schema."""
    parts = [build_docs(entities, t, part_rows) for t in TYPE_GRAPH]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flat_docs(docs: DataFrame, doc_type: str) -> DataFrame:
    """Documents with lists as sorted text, for comparing and for flat files."""
    columns = ["external_key", "id", "name", "part_no", "n_parts"]
    for f, dst_type in TYPE_GRAPH[doc_type].items():
        entries = F.map_entries(key_map_name(dst_type))
        pairs = F.sort_array(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])))
        columns += [
            F.array_join(f, ",").alias(f),
            F.size(f).cast("bigint").alias(f"n_{f}"),
            F.array_join(pairs, ",").alias(key_map_name(dst_type)),
        ]
    return docs.select(*columns)
