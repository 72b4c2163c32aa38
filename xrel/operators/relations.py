"""What links the entity types: the type graph and the rule behind each of its edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Field -> target type, per source type.
TYPE_GRAPH = {
    "competition": {"stages": "stage", "sgos": "sgo"},
    "stage": {"events": "event", "competitions": "competition", "rankings": "ranking"},
    "event": {
        "teams": "team", "venues": "venue", "sportsPersons": "sportsPerson", "stages": "stage",
        "rankings": "ranking", "keyMoments": "keyMoment",
    },
    "team": {
        "clubs": "club", "events": "event", "nations": "nation", "sportsPersons": "sportsPerson", "staff": "staff",
        "rankings": "ranking", "sgos": "sgo", "keyMoments": "keyMoment", "venues": "venue",
    },
    "venue": {"events": "event", "teams": "team", "sgos": "sgo", "clubs": "club", "nations": "nation"},
    "club": {"teams": "team", "sgos": "sgo", "venues": "venue", "sportsPersons": "sportsPerson", "staff": "staff"},
    "sgo": {
        "competitions": "competition", "sgos": "sgo", "venues": "venue", "clubs": "club", "nations": "nation",
        "teams": "team",
    },
    "nation": {"teams": "team", "sgos": "sgo", "venues": "venue", "staff": "staff"},
    "staff": {"sportsPersons": "sportsPerson", "teams": "team", "clubs": "club", "nations": "nation"},
    "sportsPerson": {
        "teams": "team", "clubs": "club", "events": "event", "staff": "staff", "rankings": "ranking",
        "keyMoments": "keyMoment",
    },
    "ranking": {"events": "event", "stages": "stage", "teams": "team", "sportsPersons": "sportsPerson"},
    "keyMoment": {"events": "event", "sportsPersons": "sportsPerson", "teams": "team"},
}

# One-letter names of the types.
TYPE_ALIAS = {
    "competition": "c", "stage": "s", "event": "e", "team": "t", "venue": "v", "club": "b", "sgo": "o",
    "nation": "n", "sportsPerson": "p", "staff": "f", "ranking": "r", "keyMoment": "k",
}

# The types bound to one competition.
SCOPED_TYPES = ("competition", "stage", "event", "team", "staff", "ranking", "keyMoment")


def inverse_field(src_type: str, dst_type: str) -> str | None:
    """The field of `dst_type` that leads back to `src_type`."""
    return next((f for f, to in TYPE_GRAPH[dst_type].items() if to == src_type), None)


def _values(spark: SparkSession, rows: list[tuple[str, ...]], columns: str) -> DataFrame:
    listed = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {listed} as t({columns})")


def type_edges(spark: SparkSession) -> DataFrame:
    """The type graph as rows of (from_type, field, to_type); its size is fixed."""
    rows = [(s, f, t) for s, fields in TYPE_GRAPH.items() for f, t in fields.items()]
    return _values(spark, rows, "from_type, field, to_type")


def type_aliases(spark: SparkSession) -> DataFrame:
    """Every accepted spelling of a type, in lower case."""
    rows = [(n.lower(), t) for t, a in TYPE_ALIAS.items() for n in (t, a)]
    return _values(spark, rows, "alias, type")


@dataclass(frozen=True)
class ForeignKey:
    """Columns `<prefix>_id`, `<prefix>_scope` of a child name a parent's natural key."""

    child: str
    prefix: str
    parent: str
    forward: str | None
    inverse: str | None


@dataclass(frozen=True)
class Reference:
    """Elements of a child's array name a parent's natural key.

    `alone`: forward edges take only elements without a complete person pair.
    `inverse_alone`: the same for inverse edges.
    """

    child: str
    array: str
    prefix: str
    parent: str
    forward: str
    inverse: str
    alone: bool = False
    inverse_alone: bool = False


FOREIGN_KEYS = (
    ForeignKey("stage", "competition", "competition", "competitions", "stages"),
    ForeignKey("event", "stage", "stage", "stages", "events"),
    ForeignKey("event", "venue", "venue", "venues", "events"),
    ForeignKey("team", "club", "club", "clubs", "teams"),
    ForeignKey("team", "nation", "nation", "nations", "teams"),
    ForeignKey("team", "venue", "venue", "venues", "teams"),
    ForeignKey("club", "venue", "venue", "venues", "clubs"),
    ForeignKey("nation", "venue", "venue", "venues", "nations"),
    ForeignKey("sgo", "venue", "venue", None, "sgos"),
    ForeignKey("staff", "team", "team", "teams", "staff"),
    ForeignKey("staff", "club", "club", "clubs", "staff"),
    ForeignKey("staff", "nation", "nation", "nations", "staff"),
    ForeignKey("staff", "sp", "sportsPerson", "sportsPersons", "staff"),
    ForeignKey("ranking", "stage", "stage", "stages", "rankings"),
    ForeignKey("ranking", "event", "event", "events", "rankings"),
    ForeignKey("ranking", "team", "team", "teams", "rankings"),
    ForeignKey("ranking", "sp", "sportsPerson", "sportsPersons", "rankings"),
    ForeignKey("keyMoment", "event", "event", "events", "keyMoments"),
)

REFERENCES = (
    Reference("event", "participants", "sp", "sportsPerson", "sportsPersons", "events"),
    Reference("event", "participants", "team", "team", "teams", "events", alone=True),
    Reference("keyMoment", "participants", "sp", "sportsPerson", "sportsPersons", "keyMoments"),
    Reference("keyMoment", "participants", "team", "team", "teams", "keyMoments", alone=True, inverse_alone=True),
    Reference("team", "members", "sp", "sportsPerson", "sportsPersons", "teams"),
    Reference("club", "members", "sp", "sportsPerson", "sportsPersons", "clubs"),
    Reference("competition", "memberships", "sgo", "sgo", "sgos", "competitions"),
    Reference("team", "memberships", "sgo", "sgo", "sgos", "teams"),
    Reference("venue", "memberships", "sgo", "sgo", "sgos", "venues"),
    Reference("club", "memberships", "sgo", "sgo", "sgos", "clubs"),
    Reference("nation", "memberships", "sgo", "sgo", "sgos", "nations"),
    Reference("sgo", "memberships", "sgo", "sgo", "sgos", "sgos"),
)
