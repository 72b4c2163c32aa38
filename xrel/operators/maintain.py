"""Keeping edges and documents current: diffs, inverse updates, closures and change detection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xrel.functions.version import content_version
from xrel.operators.assemble import Route, hop_parts
from xrel.operators.docs import build_docs, headers
from xrel.operators.edges import EDGE_COLUMNS, EdgeReader, edges_touching
from xrel.operators.relations import REFERENCES, TYPE_GRAPH, type_edges
from xrel.session import BROADCAST_ROWS, cut_lineage, few_rows, in_slices
from xrel.sources.entities import EntitySet

# Levels of a closure held as separate tables.
MAX_LEVELS = 16
LINK = ("src_type", "src_key", "dst_type", "dst_key")


def build_one(entities: EntitySet, doc_type: str, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents for the requested keys (column external_key), and a status for each key."""
    present = headers(entities, doc_type).select("external_key", "id")
    found = requested.join(present, "external_key", "left")
    status = found.select(
        "external_key", F.when(F.col("id").isNull(), F.lit("not_found")).otherwise(F.lit("ok")).alias("status")
    )
    return build_docs(entities, doc_type, only=found.where("id is not null").select("id")), status


def reference_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that went away or came, as rows with `op`; one shuffle for both sides."""
    columns = ("src_type", "src_id", "src_key", "field", "dst_type", "dst_id", "dst_key")
    both = old.select(*columns, F.lit(True).alias("is_old")).unionByName(new.select(*columns, F.lit(False).alias("is_old")))
    ids = [F.max_by(c, ~F.col("is_old")).alias(c) for c in ("src_id", "dst_id")]
    return (
        both.groupBy(*LINK, "field")
        .agg(F.min("is_old").alias("only_old"), F.max("is_old").alias("any_old"), *ids)
        .where("only_old or not any_old")
        .select(F.expr("if(only_old, 'remove', 'add')").alias("op"), *columns)
    )


def edge_ops(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whole edges that went away or came, as rows with `op`, written; a side may name an edge several times."""
    return in_slices(_edge_ops, [old.select(*EDGE_COLUMNS), new.select(*EDGE_COLUMNS)], ["src_id", "dst_id"])


def _edge_ops(old: DataFrame, new: DataFrame) -> DataFrame:
    """One shuffle for both sides."""
    both = old.select(*EDGE_COLUMNS, F.lit(True).alias("is_old")).unionByName(
        new.select(*EDGE_COLUMNS, F.lit(False).alias("is_old"))
    )
    return (
        both.groupBy(*EDGE_COLUMNS)
        .agg(F.min("is_old").alias("only_old"), F.max("is_old").alias("any_old"))
        .where("only_old or not any_old")
        .select(F.expr("if(only_old, 'remove', 'add')").alias("op"), *EDGE_COLUMNS)
    )


def changed_ids(before: EntitySet, after: EntitySet) -> dict[str, DataFrame]:
    """Per type the ids (column id) of rows that came, went or differ, in columns or in any reference list.

    A row and its references are known by 128 bits of a SHA-256 that do not depend on order, so no list is gathered.
    """
    arrays = sorted({(r.child, r.array) for r in REFERENCES})
    digest = lambda df: F.unhex(F.substring(content_version(df), 1, 32)).alias("print")

    def prints(entities: EntitySet, kind: str, old: bool) -> DataFrame:
        rows = entities.rows(kind)
        parts = [rows.select("id", F.lit(False).alias("is_ref"), digest(rows.drop("last_updated")))]
        for child, array in arrays:
            if child == kind:
                refs = entities.ref_rows(child, array).drop("owner_key").withColumn("_array", F.lit(array))
                parts.append(refs.select(F.col("owner_id").alias("id"), F.lit(True).alias("is_ref"), digest(refs)))
        return reduce(DataFrame.unionByName, parts).withColumn("side", F.lit(1 if old else -1))

    sides = [
        prints(entities, kind, old).withColumn("kind", F.lit(kind))
        for kind in TYPE_GRAPH
        for entities, old in ((before, True), (after, False))
    ]
    # Rows count as often as they come, a reference counts once however often its list has it.
    sums = reduce(DataFrame.unionByName, sides).where("id is not null").groupBy("kind", "id", "is_ref", "print").agg(
        F.sum("side").alias("left"), F.min("side").alias("least"), F.max("side").alias("most")
    )
    apart = sums.where("if(is_ref, least = most, left <> 0)")
    found = cut_lineage(apart.select("kind", "id").distinct())
    # Types are few by nature.
    kinds = sorted(r.kind for r in found.select("kind").distinct().collect())
    return {kind: found.where(F.col("kind") == kind).select("id") for kind in kinds}


def maintain_ops(before: EntitySet, after: EntitySet, changed: dict[str, DataFrame] | None = None) -> DataFrame:
    """What turns the edges of one state into those of the next: both directions, each by its own rule."""
    changed = changed_ids(before, after) if changed is None else changed
    return edge_ops(edges_touching(before, changed, once=False), edges_touching(after, changed, once=False))


def inverse_ops(ops: DataFrame) -> DataFrame:
    """The change each op means for the document at the other end, where both directions follow one rule.

    Relations with rules of their own per direction (participants, kinds of ranking, staff) need `maintain_ops`.
    """
    back = type_edges(ops.sparkSession).select(
        F.col("from_type").alias("dst_type"), F.col("to_type").alias("src_type"), F.col("field").alias("_back")
    )
    # The type graph has a fixed number of rows.
    return ops.join(F.broadcast(back), ["src_type", "dst_type"]).select(
        "op",
        F.col("dst_type").alias("src_type"), F.col("dst_id").alias("src_id"), F.col("dst_key").alias("src_key"),
        F.col("_back").alias("field"),
        F.col("src_type").alias("dst_type"), F.col("src_id").alias("dst_id"), F.col("src_key").alias("dst_key"),
    )


def apply_ops(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """Edges after the ops; removing what is absent or adding what is present changes nothing.

    While the ops are few only they are matched against the edge table, so it is not shuffled; beyond that both are
    written and joined slice by slice.
    """
    whole = [c for c in EDGE_COLUMNS if c in edges.columns]
    ops = ops.select("op", *whole)
    if ops.count() > BROADCAST_ROWS:
        return in_slices(_applied, [edges, ops], ["src_key", "dst_key"])
    return _applied(edges, ops, few_rows)


def _applied(edges: DataFrame, ops: DataFrame, small: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    link = [*LINK, "field"]
    whole = [c for c in ops.columns if c != "op"]
    removed, added = (small(ops.where(F.col("op") == op).drop("op").distinct()) for op in ("remove", "add"))
    same = " and ".join(f"e.{c} <=> r.{c}" for c in whole)
    kept = edges.alias("e").join(removed.alias("r"), F.expr(same), "left_anti")
    present = small(kept.select(*link).join(added.select(*link), link, "left_semi").distinct())
    return kept.unionByName(added.join(present, link, "left_anti")).select(*edges.columns)


def stub_docs(ops: DataFrame, docs: DataFrame) -> DataFrame:
    """Headers for targets of an add that have no document yet."""
    targets = ops.where("op = 'add'").groupBy(F.col("src_type").alias("resource_type"), F.col("src_key").alias("external_key")).agg(
        F.max("src_id").alias("id")
    )
    return targets.join(docs.select("resource_type", "external_key"), ["resource_type", "external_key"], "left_anti")


def apply_summary(ops: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """How many ops met a document (matched), changed something (modified) or made a stub (upserted)."""
    link = [*LINK, "field"]
    known = docs.select(F.col("resource_type").alias("src_type"), F.col("external_key").alias("src_key")).distinct()
    before = edges.select(*link).join(ops.select(*link), link, "left_semi").distinct()
    marked = (
        ops.join(known.withColumn("_doc", F.lit(True)), ["src_type", "src_key"], "left")
        .join(before.withColumn("_edge", F.lit(True)), link, "left")
        .withColumns({"_doc": F.coalesce("_doc", F.lit(False)), "_edge": F.coalesce("_edge", F.lit(False))})
    )
    changes = F.expr("_doc and (op = 'remove') = _edge")
    return marked.groupBy("op").agg(
        F.count("*").alias("ops"),
        F.count_if("_doc").alias("matched"),
        F.count_if(changes).alias("modified"),
        F.countDistinct(F.expr("if(op = 'add' and not _doc, concat(src_type, ' ', src_key), null)")).alias("upserted"),
    )


def collect_keys(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Keys listed in the chosen key maps of documents."""
    parts = [
        docs.select("external_key", F.lit(c).alias("key_type"), F.explode(F.map_keys(c)).alias("key")) for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


# What a rebuild from a competition visits after the governing bodies, in order.
REBUILD_LEVELS = {
    "stage": [("competition", "stages")],
    "event": [("stage", "events")],
    "ranking": [("stage", "rankings"), ("event", "rankings")],
    "team": [("event", "teams"), ("ranking", "teams")],
    "staff": [("team", "staff")],
    "sportsPerson": [("event", "sportsPersons"), ("ranking", "sportsPersons"), ("team", "sportsPersons"), ("staff", "sportsPersons")],
    "club": [("team", "clubs"), ("staff", "clubs")],
    "nation": [("team", "nations"), ("staff", "nations")],
    "venue": [("event", "venues"), ("team", "venues")],
}


def _step(nodes: DataFrame, read: EdgeReader, src_type: str, field: str) -> DataFrame:
    """Ends of one field's edges from nodes (request_id, id, key)."""
    edges = read(src_type, field).select("src_id", F.col("dst_id").alias("_id"), F.col("dst_key").alias("_key"))
    return nodes.join(edges, nodes["id"] == edges["src_id"]).select(
        "request_id", F.col("_id").alias("id"), F.col("_key").alias("key")
    )


def recursive_closure(roots: DataFrame, types: list[str], read: EdgeReader) -> DataFrame:
    """All (request_id, type, id, key) reached from roots (same columns) over edges into `types`, each once."""
    frontier = cut_lineage(roots.select("request_id", "type", "id", "key"))
    levels = [frontier]
    # Types are few by nature; one that is unknown is an error.
    sources = {r.type for r in roots.select("type").distinct().collect()}
    if unknown := sources - set(TYPE_GRAPH):
        raise ValueError(f"unknown types: {sorted(map(str, unknown))}")
    while True:
        steps = [
            _step(frontier.where(F.col("type") == s), read, s, f).withColumn("type", F.lit(t))
            for s in sorted(sources)
            for f, t in TYPE_GRAPH[s].items()
            if t in types
        ]
        seen = reduce(DataFrame.unionByName, levels)
        if not steps:
            return seen
        found = reduce(DataFrame.unionByName, steps).dropDuplicates(["request_id", "type", "id"])
        frontier = cut_lineage(found.join(seen, ["request_id", "type", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        # Each level is written once; long chains are put together now and then to keep the plan short.
        levels = [*levels, frontier] if len(levels) < MAX_LEVELS else [cut_lineage(seen.unionByName(frontier))]
        sources = set(types)


def rebuild_closure(competitions: DataFrame, read: EdgeReader) -> DataFrame:
    """Everything a rebuild of each competition (request_id, id, key) touches, as (request_id, type, id, key)."""
    roots = competitions.withColumn("type", F.lit("competition"))
    bodies = recursive_closure(roots, ["sgo"], read).where("type = 'sgo'")
    levels = {"competition": cut_lineage(competitions.select("request_id", "id", "key"))}
    for level, sources in REBUILD_LEVELS.items():
        found = [_step(levels[s], read, s, f) for s, f in sources]
        # Written out: several later levels start from it.
        levels[level] = cut_lineage(reduce(DataFrame.unionByName, found).dropDuplicates(["request_id", "id"]))
    parts = [df.withColumn("type", F.lit(t)) for t, df in levels.items()]
    return reduce(DataFrame.unionByName, parts).unionByName(bodies.select("request_id", "id", "key", "type"))


def rebuild_tracking(attempted: DataFrame, entities: EntitySet, unsupported: tuple[str, ...] = ("keyMoment",)) -> DataFrame:
    """Attempted nodes (type, key, error) with what became of them: skipped, failed, completed or not_found.

    Only the attempted types are read, and of them only the keys asked for.
    """
    kinds = sorted(r.type for r in attempted.select("type").distinct().collect())
    keys = attempted.select("type", "key").distinct()
    parts = []
    for t in kinds:
        header = headers(entities, t).select(F.lit(t).alias("type"), F.col("external_key").alias("key"))
        parts.append(header.join(keys.where(F.col("type") == t), ["type", "key"], "left_semi").distinct())
    known = reduce(DataFrame.unionByName, parts).withColumn("_known", F.lit(True))
    status = (
        F.when(F.col("type").isin(*unsupported), "skipped")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("_known"), "completed")
        .otherwise("not_found")
    )
    return attempted.join(known, ["type", "key"], "left").withColumn("status", status).drop("_known")


def rebuild(entities: EntitySet, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Build every document that a closure touches, as (type, id, external_key, related, status).

    `edges` is a stored edge table and `touched` has (type, id). `related` counts the ids of all lists of a document,
    over its parts; ids without a row that gets a document are not_found.
    """
    wanted = cut_lineage(touched.select("type", "id").distinct())
    parts = []
    for t in sorted(r.type for r in wanted.select("type").distinct().collect()):
        only = wanted.where(F.col("type") == t).select("id")
        docs = build_docs(entities, t, edges=edges.where(F.col("src_type") == t), only=only)
        sizes = sum((F.size(f) for f in TYPE_GRAPH[t]), F.lit(0))
        built = docs.groupBy("id", "external_key").agg(F.sum(sizes).cast("bigint").alias("related"))
        # Written type by type: the shuffle files of one are gone before the next is built.
        parts.append(cut_lineage(only.join(built, "id", "left").select(
            F.lit(t).alias("type"), "id", "external_key", F.coalesce("related", F.lit(0)).alias("related"),
            F.when(F.col("external_key").isNull(), "not_found").otherwise("ok").alias("status"),
        )))
    return reduce(DataFrame.unionByName, parts)


def rebuild_report(competitions: DataFrame, read: EdgeReader, failed: DataFrame, listed: int = 10) -> DataFrame:
    """Per competition and stage: events that were built and that failed, the first failures by key, and how many more.

    `failed` has the keys (key) of events whose build failed.
    """
    stages = _step(competitions, read, "competition", "stages").withColumnRenamed("key", "stage_key")
    edges = read("stage", "events").select(F.col("src_id").alias("id"), F.col("dst_key").alias("event_key"))
    lost = failed.select(F.col("key").alias("event_key"), F.lit(True).alias("_failed")).distinct()
    events = stages.join(edges, "id", "left").join(lost, "event_key", "left").withColumn("_failed", F.coalesce("_failed", F.lit(False)))
    group = ["request_id", "stage_key"]
    totals = events.groupBy(*group).agg(F.count_if(F.col("event_key").isNotNull() & ~F.col("_failed")).alias("ok"), F.count_if("_failed").alias("failed"))
    # The limit on the row number lets each task keep its own first failures.
    place = F.row_number().over(Window.partitionBy(*group).orderBy("event_key"))
    first = (
        events.where("_failed").withColumn("_n", place).where(F.col("_n") <= listed)
        .groupBy(*group).agg(F.array_join(F.sort_array(F.collect_list("event_key")), ",").alias("first_failed"))
    )
    return totals.join(first, group, "left").withColumn("more", F.greatest(F.col("failed") - listed, F.lit(0)))


def change_detect(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key with new, changed, unchanged or gone, by the version of its content."""
    before = old.select(key, content_version(old).alias("old_version"))
    after = new.select(key, content_version(new).alias("new_version"))
    state = (
        F.when(F.col("old_version").isNull(), "new")
        .when(F.col("new_version").isNull(), "gone")
        .when(F.col("old_version") == F.col("new_version"), "unchanged")
        .otherwise("changed")
    )
    return before.join(after, key, "full_outer").select(key, state.alias("state"), "old_version", "new_version")


def affected_roots(changed: DataFrame, changed_type: str, routes: list[Route], read: EdgeReader) -> DataFrame:
    """Roots whose routes pass over or end on a changed row: (root_id, changed_id), walked backwards."""
    prefixes = {r.via[:n] for r in routes for n in range(1, len(r.via) + 1) if hop_parts(r.via[n - 1])[2] == changed_type}
    parts = []
    for prefix in sorted(prefixes):
        ids = changed.select(F.col("id").alias("changed_id"), "id")
        for hop in reversed(prefix):
            src_type, field, _ = hop_parts(hop)
            edges = read(src_type, field).select("src_id", "dst_id")
            ids = ids.join(edges, ids["id"] == edges["dst_id"]).select("changed_id", F.col("src_id").alias("id")).distinct()
        parts.append(ids)
    return reduce(DataFrame.unionByName, parts).select(F.col("id").alias("root_id"), "changed_id").distinct()
