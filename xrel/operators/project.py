"""Field projections on fetched rows: which fields, tags and participants a result shows.

Keys follow one small syntax. A plain name is a field (`a.b` a nested one). `tags`,
`participants.team`, `participants.sp`, `participants.tags`, `participants.team.tags` and
`participants.sp.tags` address the nested lists; tag keys may go on with `>name` or `>prefix*`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIVATE = ("_original", "_stickies")
KINDS = ("team", "sp")


def name_matches(name: Column, names: list[str]) -> Column:
    """Equal to one of `names`, or starting with one that ends in `*`."""
    exact = [n for n in names if not n.endswith("*")]
    tests = [name.isin(*exact)] if exact else []
    tests += [name.startswith(n[:-1]) for n in names if n.endswith("*")]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


@dataclass
class TagRule:
    """Keep all tags (no names), only or all but the named ones, or none."""

    names: list[str] = field(default_factory=list)
    exclude: bool = False

    def apply(self, tags: Column) -> Column:
        if not self.names:
            return F.lit(None).cast("array<struct<name:string,value:string>>") if self.exclude else tags
        # A missing list counts as an empty one once names are asked for.
        present = F.coalesce(tags, F.array().cast("array<struct<name:string,value:string>>"))
        if self.exclude:
            return F.filter(present, lambda t: ~F.coalesce(name_matches(t["name"], self.names), F.lit(False)))
        return F.filter(present, lambda t: name_matches(t["name"], self.names))


@dataclass
class Rules:
    """One list of keys, read as inclusions or exclusions."""

    exclude: bool
    fields: list[str] = field(default_factory=list)
    tags: TagRule | None = None
    kinds: list[str] = field(default_factory=list)
    kind_tags: dict[str, TagRule] = field(default_factory=dict)
    named_participants: bool = False


def parse_keys(keys: list[str], exclude: bool) -> Rules:
    rules = Rules(exclude)
    for key in keys:
        base, *names = [p.strip() for p in key.split(">") if p.strip()]
        if base == "tags":
            rules.tags = TagRule(names, exclude)
        elif base in ("participants.team", "participants.sp"):
            rules.kinds.append(base.split(".")[1])
            rules.named_participants = True
        elif base in ("participants.tags", "participants.team.tags", "participants.sp.tags"):
            for kind in KINDS if base == "participants.tags" else (base.split(".")[1],):
                rules.kind_tags[kind] = TagRule(names, exclude)
            rules.named_participants = True
        else:
            rules.fields.append(key.strip())
    return rules


def is_kind(participant: Column, kind: str) -> Column:
    return participant[f"{kind}_id"].isNotNull() & participant[f"{kind}_scope"].isNotNull()


def filter_participants(participants: Column, rules: Rules) -> Column:
    """Included kinds are joined by or; each excluded kind is taken away."""
    if not rules.kinds:
        return participants

    def keep(p: Column) -> Column:
        tests = [is_kind(p, k) for k in rules.kinds]
        any_kind = tests[0]
        for t in tests[1:]:
            any_kind = any_kind | t
        return ~any_kind if rules.exclude else any_kind

    return F.filter(participants, keep)


def filter_participant_tags(participants: Column, rules: Rules) -> Column:
    """Tag rules per kind; a participant with both a team and a person follows the team rule."""
    if not rules.kind_tags:
        return participants

    def tags_of(p: Column, kind: str) -> Column:
        rule = rules.kind_tags.get(kind)
        return rule.apply(p["tags"]) if rule else p["tags"]

    def reshape(p: Column) -> Column:
        ids = [p[c].alias(c) for c in ("team_id", "team_scope", "sp_id", "sp_scope")]
        tags = F.when(is_kind(p, "team"), tags_of(p, "team")).otherwise(tags_of(p, "sp"))
        return F.struct(*ids, tags.alias("tags"))

    return F.transform(participants, reshape)


def set_lists(rows: DataFrame, rules: Rules) -> DataFrame:
    """Filter the nested lists; no row gains or loses a column."""
    if rules.tags and "tags" in rows.columns:
        rows = rows.withColumn("tags", rules.tags.apply(F.col("tags")))
    if rules.named_participants and "participants" in rows.columns:
        none = F.array().cast(rows.schema["participants"].dataType)
        kept = filter_participants(F.coalesce("participants", none), rules)
        rows = rows.withColumn("participants", filter_participant_tags(kept, rules))
    return rows


def _without(rows: DataFrame, path: str) -> DataFrame:
    if path in rows.columns:
        return rows.drop(path)
    top, _, rest = path.partition(".")
    if not rest or top not in rows.columns:
        return rows
    if isinstance(rows.schema[top].dataType, T.MapType):
        return rows.withColumn(top, F.map_filter(top, lambda k, _: k != rest))
    return rows.withColumn(top, F.col(top).dropFields(rest))


def _only_keys(column: str, names: list[str]) -> Column:
    return F.map_filter(column, lambda k, _: k.isin(*names))


def include_fields(rows: DataFrame, rules: Rules) -> DataFrame:
    """Keep `id` and the named fields; nothing named keeps all."""
    wanted = list(rules.fields)
    if rules.tags:
        wanted.append("tags")
    if rules.named_participants:
        wanted.append("participants")
    if not wanted:
        return rows
    nested: dict[str, list[str] | None] = {"id": None}
    for path in wanted:
        top, _, rest = path.partition(".")
        if not rest:
            nested[top] = None
        elif nested.get(top, []) is not None:
            nested.setdefault(top, []).append(rest)
    columns = []
    for c in rows.columns:
        if c not in nested:
            continue
        parts = nested[c]
        if parts is None:
            columns.append(F.col(c))
        elif isinstance(rows.schema[c].dataType, T.MapType):
            columns.append(_only_keys(c, parts).alias(c))
        else:
            columns.append(F.struct(*(F.col(f"{c}.{p}").alias(p) for p in parts)).alias(c))
    return rows.select(*columns)


def exclude_fields(rows: DataFrame, rules: Rules) -> DataFrame:
    for path in rules.fields:
        rows = _without(rows, path)
    if rules.tags and not rules.tags.names:
        rows = rows.drop("tags")
    return rows


def project(rows: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Exclusions on lists, inclusions on lists, included fields, then excluded fields: an exclusion always wins."""
    out, into = parse_keys(list(exclude), True), parse_keys(list(include), False)
    return exclude_fields(include_fields(set_lists(set_lists(rows, out), into), into), out)


def parse_request(params: DataFrame) -> DataFrame:
    """Request parameters (request_id, name, value) as rows of (request_id, type, mode, key).

    `projection.<type>` lists inclusions, `projection~<type>` exclusions.
    """
    pattern = r"^projection([.~])(.+)$"
    mode = F.when(F.regexp_extract("name", pattern, 1) == ".", "include").otherwise("exclude")
    keys = F.filter(F.transform(F.split("value", ","), lambda k: F.trim(k)), lambda k: k != "")
    return params.where(F.col("name").rlike(pattern)).select(
        "request_id", F.regexp_extract("name", pattern, 2).alias("type"), mode.alias("mode"),
        F.explode(F.array_distinct(keys)).alias("key"),
    )


def with_private_defaults(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """Add the exclusion of private fields for all types, unless a request turned it off.

    `requests`: (request_id, include_original, include_stickies).
    """
    hidden = F.filter(
        F.array(
            F.when(~F.col("include_original"), F.lit(PRIVATE[0])), F.when(~F.col("include_stickies"), F.lit(PRIVATE[1]))
        ),
        lambda c: c.isNotNull(),
    )
    defaults = requests.select(
        "request_id", F.lit("all").alias("type"), F.lit("exclude").alias("mode"), F.explode(hidden).alias("key")
    )
    return parsed.unionByName(defaults).distinct()
