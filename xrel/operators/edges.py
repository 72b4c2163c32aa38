"""One-hop relations resolved for all entities at once, as rows of edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.functions import keys
from xrel.operators.relations import FOREIGN_KEYS, REFERENCES, TYPE_GRAPH, ForeignKey, Reference
from xrel.session import BROADCAST_ROWS, cut_lineage, few_rows, in_slices
from xrel.sources.entities import EntitySet

EDGE_COLUMNS = ("src_type", "src_id", "src_key", "field", "dst_type", "dst_id", "dst_key")

# (source type, field) -> rows of src_id, src_key, dst_id, dst_key.
EdgeReader = Callable[[str, str], DataFrame]


def _key_seen_from_parent(fk: ForeignKey) -> Column:
    """The child's key as its parent lists it; composite keys name that parent."""
    if fk.child == "staff":
        return keys.staff_key(None if fk.prefix == "sp" else fk.prefix)
    if fk.child == "ranking":
        return keys.ranking_key(fk.prefix)
    if fk.child == "keyMoment":
        return keys.key_moment_key(strict=False)
    return F.expr("if(ext_id != '' and ext_scope != '', external_key, null)")


def _forward_holds(fk: ForeignKey) -> Column:
    """A ranking links only to the owner and the subject of its kind."""
    if fk.child != "ranking":
        return F.lit(True)
    kinds = [k for k, (owner, subject, _) in keys.RANKING_KINDS.items() if fk.prefix in (owner, subject)]
    return F.coalesce(keys.ranking_kind().isin(kinds), F.lit(False))


def _join_parents(children: DataFrame, entities: EntitySet, parent: str, *columns: str) -> DataFrame:
    """Children with `_ref_id`, `_ref_scope` joined to the parents they name."""
    parents = entities.rows(parent).selectExpr(
        "id as parent_id", "external_key as parent_key", "ext_id as _ext_id", "ext_scope as _ext_scope"
    )
    on = F.expr("_ref_id = _ext_id and _ref_scope = _ext_scope")
    return children.join(parents, on).selectExpr(*columns, "parent_id", "parent_key")


def fk_links(entities: EntitySet, fk: ForeignKey) -> DataFrame:
    """Child and parent rows joined on the natural key pair."""
    children = entities.rows(fk.child).select(
        F.expr("id as child_id"),
        F.expr("external_key as child_key"),
        _key_seen_from_parent(fk).alias("child_key_seen"),
        _forward_holds(fk).alias("in_kind"),
        F.expr(f"{fk.prefix}_id as _ref_id"),
        F.expr(f"{fk.prefix}_scope as _ref_scope"),
    )
    return _join_parents(
        children, entities, fk.parent, "child_id", "child_key", "child_key_seen",
        "in_kind and child_key is not null as forward_holds", "child_key_seen is not null as inverse_holds",
    )


def reference_links(entities: EntitySet, ref: Reference, forward: bool = True, inverse: bool = True) -> DataFrame:
    """Distinct references of each owner joined to the rows they name."""
    named = f"{ref.prefix}_id is not null and {ref.prefix}_scope is not null"
    alone = "true"
    if ref.prefix == "sp":
        named += " and sp_id != '' and sp_scope != ''"
    elif ref.alone:
        alone = "not (sp_id is not null and sp_scope is not null)"
        if ref.inverse_alone or not inverse:
            named, alone = f"{named} and {alone}", "true"
    distinct = (
        entities.ref_rows(ref.child, ref.array)
        .where(named)
        .selectExpr(
            "owner_id", "owner_key", f"{ref.prefix}_id as _ref_id", f"{ref.prefix}_scope as _ref_scope", f"{alone} as alone"
        )
        .groupBy("owner_id", "owner_key", "_ref_id", "_ref_scope")
        .agg(F.expr("max(alone) as alone"))
    )
    return _join_parents(
        distinct, entities, ref.parent, "owner_id as child_id", "owner_key as child_key", "owner_key as child_key_seen",
        "alone and owner_key is not null as forward_holds", "owner_key is not null as inverse_holds",
    )


def _forward(links: DataFrame) -> DataFrame:
    return links.where("forward_holds").selectExpr(
        "child_id as src_id", "child_key as src_key", "parent_id as dst_id", "parent_key as dst_key"
    )


def _inverse(links: DataFrame) -> DataFrame:
    return links.where("inverse_holds").selectExpr(
        "parent_id as src_id", "parent_key as src_key", "child_id as dst_id", "child_key_seen as dst_key"
    )


def union_in_out(outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    """Set union of edges found from either side."""
    return outbound.unionByName(inbound).distinct()


def edges_of(entities: EntitySet, src_type: str, field: str) -> DataFrame:
    """Edges of one field of one type; only the relation behind it is read."""
    dst_type = TYPE_GRAPH[src_type][field]
    parts = []
    for ref in REFERENCES:
        if (ref.child, ref.forward, ref.parent) == (src_type, field, dst_type):
            parts.append(_forward(reference_links(entities, ref, inverse=False)))
        if (ref.parent, ref.inverse, ref.child) == (src_type, field, dst_type):
            parts.append(_inverse(reference_links(entities, ref, forward=False)))
    for fk in FOREIGN_KEYS:
        if (fk.child, fk.forward, fk.parent) == (src_type, field, dst_type):
            parts.append(_forward(fk_links(entities, fk)))
        if (fk.parent, fk.inverse, fk.child) == (src_type, field, dst_type):
            parts.append(_inverse(fk_links(entities, fk)))
    return parts[0] if len(parts) == 1 else reduce(union_in_out, parts)


def written_once(entities: EntitySet, types: set[str]) -> EntitySet:
    """The same set with the rows of these types written out, where several relations would derive them again."""
    new = types - entities.written
    once = entities.replaced({t: cut_lineage(entities.tables[t]) for t in sorted(new)})
    once.written |= new
    return once


def derived_often(least: int = 3) -> set[str]:
    """Types with that many foreign keys: their rows would be worked out once for each."""
    children = [fk.child for fk in FOREIGN_KEYS]
    return {c for c in children if children.count(c) >= least}


def edges_from_type(entities: EntitySet, src_type: str) -> DataFrame:
    """All edges leaving one type, in long form."""
    if src_type in derived_often():
        entities = written_once(entities, {src_type})
    parts = [labelled(edges_of(entities, src_type, f), src_type, f) for f in TYPE_GRAPH[src_type]]
    return reduce(DataFrame.unionByName, parts)


def labelled(edges: DataFrame, src_type: str, field: str) -> DataFrame:
    return edges.selectExpr(
        f"'{src_type}' as src_type", "src_id", "src_key", f"'{field}' as field",
        f"'{TYPE_GRAPH[src_type][field]}' as dst_type", "dst_id", "dst_key",
    )


# Fields fed by two relations: an edge may come from either.
TWO_SIDED = (("sgo", "sgos"), ("venue", "sgos"))


# Every relation by its number, which references carry instead of names.
RELATIONS: tuple[ForeignKey | Reference, ...] = (*FOREIGN_KEYS, *REFERENCES)


def _reference(relation: ForeignKey | Reference, seen: Column, forward: Column, inverse: Column) -> dict[str, Column]:
    never = F.lit(False)
    return {
        "relation": F.lit(RELATIONS.index(relation)),
        "ref_id": F.col(f"{relation.prefix}_id"),
        "ref_scope": F.col(f"{relation.prefix}_scope"),
        "seen_key": seen,
        "forward": forward if relation.forward else never,
        "inverse": inverse if relation.inverse else never,
    }


def _chosen(number: str, choices: list[Column]) -> Column:
    """The choice of that number; the others are not worked out."""
    return reduce(lambda whens, i: whens.when(F.col(number) == i, choices[i]), range(1, len(choices)), F.when(F.col(number) == 0, choices[0]))


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("_number", F.explode(F.array(*map(F.lit, range(n)))))


def _listed(rows: DataFrame, own: list[str], references: list[dict[str, Column]]) -> DataFrame:
    """Rows (child_id, child_key) with each of their complete references in a row of its own."""
    if len(references) == 1:
        # Plain columns: a semi join on them can move below whatever derives the rows.
        columns = references[0]
    else:
        rows = _numbered(rows, len(references))
        columns = {name: _chosen("_number", [r[name] for r in references]) for name in references[0]}
    listed = rows.select(F.col(own[0]).alias("child_id"), F.col(own[1]).alias("child_key"), *(c.alias(n) for n, c in columns.items()))
    return listed.where("ref_id is not null and ref_scope is not null and (forward or inverse)")


def _own_references(entities: EntitySet, children: set[str], parents: set[str]) -> list[DataFrame]:
    """References in the columns of a row, all of one row at once."""
    parts = []
    for child in sorted(children):
        refs = []
        for fk in FOREIGN_KEYS:
            if fk.child == child and fk.parent in parents:
                seen = _key_seen_from_parent(fk)
                forward = _forward_holds(fk) & F.col("external_key").isNotNull()
                refs.append(_reference(fk, seen, forward, seen.isNotNull()))
        if refs:
            parts.append(_listed(entities.rows(child), ["id", "external_key"], refs))
    return parts


def _list_references(entities: EntitySet, children: set[str], parents: set[str]) -> list[DataFrame]:
    """References in the lists of a row, which may name the same row several times."""
    parts = []
    for child, array in sorted({(r.child, r.array) for r in REFERENCES if r.child in children}):
        refs = []
        for ref in REFERENCES:
            if (ref.child, ref.array) != (child, array) or ref.parent not in parents:
                continue
            named, alone = F.col("owner_key").isNotNull(), F.lit(True)
            if ref.prefix == "sp":
                named &= F.coalesce((F.col("sp_id") != "") & (F.col("sp_scope") != ""), F.lit(False))
            elif ref.alone:
                alone = ~keys.has_pair("sp")
            refs.append(_reference(ref, F.col("owner_key"), named & alone, named & alone if ref.inverse_alone else named))
        if refs:
            parts.append(_listed(entities.ref_rows(child, array), ["owner_id", "owner_key"], refs))
    return parts


def _parents(entities: EntitySet, types: set[str]) -> DataFrame:
    """Rows that references may name, with the pair that names them."""
    columns = "ext_id as ref_id", "ext_scope as ref_scope", "id as parent_id", "external_key as parent_key"
    parts = [
        entities.rows(t).where("ext_id is not null and ext_scope is not null").selectExpr(f"{sorted(TYPE_GRAPH).index(t)} as kind", *columns)
        for t in sorted(types)
    ]
    return reduce(DataFrame.unionByName, parts)


NAMED_BY = ["kind", "ref_id", "ref_scope"]


def _once(references: DataFrame) -> DataFrame:
    """Each child's reference once; it holds in a direction if any of its repeats does."""
    own = [c for c in references.columns if c not in ("forward", "inverse")]
    return references.groupBy(*own).agg(F.max("forward").alias("forward"), F.max("inverse").alias("inverse"))


def _by_relation(value: Callable[[ForeignKey | Reference], object]) -> Column:
    """A fixed value of each row's relation."""
    return F.element_at(F.array(*(F.lit(value(r)) for r in RELATIONS)), F.col("relation") + 1)


def _with_kind(references: DataFrame) -> DataFrame:
    return references.withColumn("kind", _by_relation(lambda r: sorted(TYPE_GRAPH).index(r.parent)))


def _both_ways(links: DataFrame) -> DataFrame:
    """Each joined row gives its edge in both directions, so it is joined once."""
    child, parent, forward, inverse = (_by_relation(lambda r, e=e: getattr(r, e)) for e in ("child", "parent", "forward", "inverse"))
    out = [child, "child_id", "child_key", forward, parent, "parent_id", "parent_key"]
    back = [parent, "parent_id", "parent_key", inverse, child, "child_id", "seen_key"]
    column = lambda c: F.col(c) if isinstance(c, str) else c
    both = _numbered(links, 2).where("if(_number = 0, forward, inverse)")
    return both.select(
        *(F.when(F.col("_number") == 0, column(a)).otherwise(column(b)).alias(n) for a, b, n in zip(out, back, EDGE_COLUMNS, strict=True))
    )


def _links(named: DataFrame, rows: DataFrame) -> DataFrame:
    """References joined to the rows they name; those from lists, which may repeat, count once."""
    own, lists = (named.where(F.col("listed") == listed).drop("listed") for listed in (False, True))
    return own.unionByName(_once(lists)).join(rows, NAMED_BY).drop(*NAMED_BY)


def _sizes(entities: EntitySet, types: set[str]) -> dict[str, int]:
    counted = _parents(entities, types).groupBy("kind").count().collect()
    return {sorted(TYPE_GRAPH)[r.kind]: r["count"] for r in counted}


def all_edges(entities: EntitySet) -> DataFrame:
    """Every edge of every type: all references of a row are listed at once and meet the rows they name together.

    Types of few rows, as counted, are handed to every task together; what names larger types meets them in one shuffled
    join, in which a hub is one skewed key that adaptive execution splits. Many references are joined slice by slice.
    Only fields fed from two sides need a distinct.
    """
    types = set(TYPE_GRAPH)
    sizes = _sizes(entities, {r.parent for r in RELATIONS})
    few, total = set(), 0
    for t, n in sorted(sizes.items(), key=lambda x: x[1]):
        total += n
        if total <= BROADCAST_ROWS:
            few.add(t)
    classes = [c for c in (few, set(sizes) - few) if c]
    # Rows that are derived, and read for both classes, are worked out once.
    both = {t for t in derived_often() if all(any(fk.child == t and fk.parent in c for fk in FOREIGN_KEYS) for c in classes)}
    entities = written_once(entities, both) if len(classes) > 1 else entities
    parts = []
    for parents in classes:
        named = [r.withColumn("listed", F.lit(False)) for r in _own_references(entities, types, parents)]
        named += [r.withColumn("listed", F.lit(True)) for r in _list_references(entities, types, parents)]
        named = _with_kind(reduce(DataFrame.unionByName, named))
        rows = _parents(entities, parents)
        # Links are written, not edges: each gives two of them.
        if parents == few:
            links = in_slices(partial(_links, rows=few_rows(rows)), [named], ["child_id"])
        else:
            links = in_slices(_links, [named, rows], ["ref_id", "ref_scope"])
        parts.append(_both_ways(links))
    edges = reduce(DataFrame.unionByName, parts)
    two_sided = reduce(lambda a, b: a | b, ((F.col("src_type") == t) & (F.col("field") == f) for t, f in TWO_SIDED))
    return reduce(DataFrame.unionByName, [edges.where(~two_sided), *(labelled(edges_of(entities, t, f), t, f) for t, f in TWO_SIDED)])


def edges_touching(entities: EntitySet, changed: dict[str, DataFrame], once: bool = True) -> DataFrame:
    """Edges with a changed row at either end, each from the rule of its own direction.

    `changed` holds ids (column id) per type. Whether an edge exists depends on the rows at its two ends alone, so
    between two states only these edges can differ. Two joins give them: what changed rows name, against all rows, and
    all rows against the changed ones they name. Changed rows are found before anything is joined, and relations
    without a changed type are not read. Without `once` an edge may come several times.
    """
    ids = {t: few_rows(rows.select("id").distinct()) for t, rows in changed.items()}
    types = set(TYPE_GRAPH)
    rows = {t: entities.tables[t].join(known, "id", "left_semi") for t, known in ids.items()}
    lists = {
        (r.child, r.array): entities.ref_rows(r.child, r.array).join(
            ids[r.child].withColumnRenamed("id", "owner_id"), "owner_id", "left_semi"
        )
        for r in REFERENCES
        if r.child in ids
    }
    near = entities.replaced(rows, lists)
    links = []
    own = _own_references(near, set(ids), types) + _list_references(near, set(ids), types)
    if own:
        named = few_rows(_with_kind(_once(reduce(DataFrame.unionByName, own))))
        # Types are few by nature; only tables that are named are read.
        parents = {sorted(TYPE_GRAPH)[r.kind] for r in named.select("kind").distinct().collect()}
        if parents:
            links.append(_parents(entities, parents).join(named, NAMED_BY))
    parents = {r.parent for r in RELATIONS} & set(ids)
    if parents:
        known = few_rows(_parents(near, parents))
        naming = _own_references(entities, types, parents) + _list_references(entities, types, parents)
        # The semi join moves below what derives the rows; repeats are put together among what is left.
        pairs = known.select("ref_id", "ref_scope")
        left = [part.join(pairs, ["ref_id", "ref_scope"], "left_semi") for part in naming]
        links.append(_with_kind(_once(reduce(DataFrame.unionByName, left))).join(known, NAMED_BY))
    if not links:
        return labelled(edges_of(entities, "sgo", "sgos").limit(0), "sgo", "sgos")
    # An edge with both ends changed comes twice, and so may one of a field fed by two relations.
    edges = _both_ways(reduce(DataFrame.unionByName, links))
    return edges.distinct() if once else edges


def write_edges(edges: DataFrame, path: str) -> None:
    """Store edges for `stored_reader`: one folder per type and field, rows in order of their source.

    Edges of one field are brought together in partitions of even size, so a task opens few folders and hubs are split.
    """
    ordered = edges.hint("rebalance", "src_type", "field").sortWithinPartitions("src_type", "field", "src_id")
    ordered.write.mode("errorifexists").partitionBy("src_type", "field").parquet(path)


def reader(entities: EntitySet) -> EdgeReader:
    """Edges worked out from the entity tables when asked for."""
    return lambda src_type, field: edges_of(entities, src_type, field)


def stored_reader(edges: DataFrame) -> EdgeReader:
    """Edges read from a table partitioned by src_type and field, so a hop reads one partition."""
    return lambda src_type, field: edges.where(f"src_type = '{src_type}' and field = '{field}'").select(
        "src_id", "src_key", "dst_id", "dst_key"
    )
