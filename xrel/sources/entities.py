"""The entity tables a job works on, whether references arrive nested or as rows of their own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xrel.functions import keys
from xrel.functions.text import localised
from xrel.sources import schemas

# Columns a reference array contributes, besides those of its owner.
REF_COLUMNS = {
    "participants": ("team_id", "team_scope", "sp_id", "sp_scope"),
    "members": ("sp_id", "sp_scope"),
    "memberships": ("sgo_id", "sgo_scope"),
}


def external_key(entity_type: str) -> Column:
    if entity_type == "staff":
        return keys.staff_key()
    if entity_type == "ranking":
        return keys.ranking_key()
    if entity_type == "keyMoment":
        return keys.key_moment_key()
    return keys.pair_key(F.col("ext_id"), F.col("ext_scope"))


def display_name(entity_type: str) -> Column:
    """Name in the row's own language; persons and staff show the last name, key moments fall back to subtype."""
    source = "last_name" if entity_type in ("sportsPerson", "staff") else "name"
    name = localised(F.col(source), F.col("default_language"))
    return F.coalesce(name, F.col("sub_type")) if entity_type == "keyMoment" else name


class OnDemand(dict):
    """Name -> DataFrame, or a function giving one that runs when the name is first asked for."""

    def __getitem__(self, name):
        value = super().__getitem__(name)
        if callable(value) and not isinstance(value, DataFrame):
            value = value()
            self[name] = value
        return value

    def get(self, name, default=None):
        return self[name] if name in self else default


@dataclass
class EntitySet:
    """`tables`: one row per entity. `refs`: (type, array) -> rows of owner_id, owner_key and the reference.

    A reference array that is not listed in `refs` is exploded from its table. Rows given in `refs`
    keep hub owners out of single giant rows; they must name existing owners, as nested arrays do.
    `written`: types whose rows are stored as they are, so reading them again works nothing out.
    """

    tables: dict[str, DataFrame]
    refs: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    written: frozenset[str] = frozenset()

    def __post_init__(self):
        self.tables, self.refs = OnDemand(self.tables), OnDemand(self.refs)
        self._keyed: dict[str, DataFrame] = {}

    def rows(self, entity_type: str) -> DataFrame:
        """Entity rows with their external key."""
        if entity_type not in self._keyed:
            self._keyed[entity_type] = self.tables[entity_type].withColumn("external_key", external_key(entity_type))
        return self._keyed[entity_type]

    def ref_rows(self, entity_type: str, array: str) -> DataFrame:
        given = self.refs.get((entity_type, array))
        if given is not None:
            return given
        return (
            self.rows(entity_type)
            .select(F.col("id").alias("owner_id"), F.col("external_key").alias("owner_key"), F.explode(array).alias("r"))
            .select("owner_id", "owner_key", *(F.col(f"r.{c}").alias(c) for c in REF_COLUMNS[array]))
        )

    def replaced(self, tables: dict[str, DataFrame], refs: dict[tuple[str, str], DataFrame] | None = None) -> "EntitySet":
        """The same set with some tables and reference rows exchanged."""
        written = self.written - set(tables)
        return EntitySet({**dict(self.tables.items()), **tables}, {**dict(self.refs.items()), **(refs or {})}, written)


def load_entities(spark: SparkSession, root: str, fmt: str = "parquet") -> EntitySet:
    """Read `root/<type>` for every type with the declared schemas."""
    return EntitySet(
        {t: spark.read.schema(schemas.ddl(t)).format(fmt).load(f"{root}/{t}") for t in schemas.TYPES}
    )


def load_lookup_only(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A raw table that is read by key but never related to others."""
    if name not in schemas.LOOKUP_ONLY:
        raise ValueError(f"{name} is not one of {', '.join(schemas.LOOKUP_ONLY)}")
    return spark.read.format(fmt).load(f"{root}/{name}")


# Header columns besides the common ones, per type.
META_EXTRA = {
    "staff": [f"{p}_{c}" for p in ("sp", "team", "club", "nation") for c in ("id", "scope")],
    "ranking": [
        *(f"{p}_{c}" for p in ("sp", "team", "stage", "event") for c in ("id", "scope")),
        "date_time_label",
        "ranking",
    ],
    "keyMoment": ["event_id", "event_scope", "type", "sub_type", "date_time"],
}


def meta(entities: EntitySet, entity_type: str) -> DataFrame:
    """Header columns of a type's documents."""
    return entities.rows(entity_type).select(
        F.lit(entity_type).alias("resource_type"),
        "external_key",
        "id",
        "ext_id",
        "ext_scope",
        display_name(entity_type).alias("name"),
        *META_EXTRA.get(entity_type, []),
    )
