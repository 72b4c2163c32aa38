"""Natural keys of the twelve entity types: building, parsing and checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xrel.functions.dates import iso_millis

# Separators inside external keys.
PAIR = " @ "
STAFF_TEAM = " /team/ "
STAFF_CLUB = " /club/ "
STAFF_NATION = " /nation/ "
RANK_STAGE_TEAM = " /st/ "
RANK_EVENT_TEAM = " /et/ "
RANK_STAGE_PERSON = " /ssp/ "
RANK_EVENT_PERSON = " /esp/ "
RANK_LABEL = " /label/ "
RANK_POSITION = " /rank/ "

STAFF_SEPARATORS = {"team": STAFF_TEAM, "club": STAFF_CLUB, "nation": STAFF_NATION}
# Kind -> (owner columns, subject columns, separator), in order of precedence.
RANKING_KINDS = {
    "stage_team": ("stage", "team", RANK_STAGE_TEAM),
    "stage_person": ("stage", "sp", RANK_STAGE_PERSON),
    "event_team": ("event", "team", RANK_EVENT_TEAM),
    "event_person": ("event", "sp", RANK_EVENT_PERSON),
}


def pair_key(id_: Column, scope: Column) -> Column:
    """`id @ scope`; null when either part is null."""
    return F.concat(id_, F.lit(PAIR), scope)


def fk_key_sql(prefix: str) -> str:
    return f"concat({prefix}_id, '{PAIR}', {prefix}_scope)"


def has_pair_sql(prefix: str) -> str:
    return f"({prefix}_id is not null and {prefix}_scope is not null)"


def has_pair(prefix: str) -> Column:
    return F.expr(has_pair_sql(prefix))


def number_text_sql(value: str) -> str:
    """A double as a key shows it: no fraction for whole numbers."""
    whole = f"{value} = floor({value}) and abs({value}) < 1e18"
    return f"if({whole}, string(bigint({value})), string({value}))"


def staff_key(org: str | None = None) -> Column:
    """Person key joined to one organisation key; team comes before club before nation.

    With `org` only that organisation counts, as seen from its own side.
    """
    variants = [
        f"concat({fk_key_sql('sp')}, '{sep}', {fk_key_sql(kind)})"
        for kind, sep in STAFF_SEPARATORS.items()
        if org in (None, kind)
    ]
    return F.expr(f"coalesce({', '.join(variants)})")


def staff_org_count() -> Column:
    """How many organisation pairs a staff row names; a staff document needs exactly one."""
    return F.expr(" + ".join(f"int{has_pair_sql(kind)}" for kind in STAFF_SEPARATORS))


def ranking_kind() -> Column:
    """First kind whose owner and subject pairs are both complete, else null."""
    cases = [
        f"when {has_pair_sql(owner)} and {has_pair_sql(subject)} then '{kind}'"
        for kind, (owner, subject, _) in RANKING_KINDS.items()
    ]
    return F.expr(f"case {' '.join(cases)} end")


def ranking_key(side: str | None = None) -> Column:
    """Composite ranking key; `side` keeps the kinds that name that side."""
    tail = f"concat('{RANK_LABEL}', date_time_label, '{RANK_POSITION}', {number_text_sql('ranking')})"
    variants = [
        f"concat({fk_key_sql(owner)}, '{sep}', {fk_key_sql(subject)}, {tail})"
        for owner, subject, sep in RANKING_KINDS.values()
        if side in (None, owner, subject)
    ]
    return F.expr(f"coalesce({', '.join(variants)})")


def ranking_is_valid() -> Column:
    subject = has_pair("team") | has_pair("sp")
    owner = has_pair("stage") | has_pair("event")
    return subject & owner & F.col("date_time_label").isNotNull() & F.col("ranking").isNotNull()


def key_moment_key(strict: bool = True) -> Column:
    """Time, event id, event scope, type and subtype. The loose form shows nulls as empty text."""
    parts = [iso_millis(F.col("date_time")), *(F.col(c) for c in ("event_id", "event_scope", "type", "sub_type"))]
    if not strict:
        parts = [F.coalesce(p, F.lit("")) for p in parts]
    spaced: list[Column] = []
    for p in parts:
        spaced += [F.lit(PAIR), p] if spaced else [p]
    return F.concat(*spaced)


def parse_simple_key(key: Column) -> Column:
    """Struct (id, scope); an absent or empty part is null."""
    parts = F.split(key, PAIR)
    return F.struct(
        F.nullif(F.get(parts, 0), F.lit("")).alias("id"), F.nullif(F.get(parts, 1), F.lit("")).alias("scope")
    )


def _one_of(separators) -> str:
    return "|".join(separators)


def parse_staff_key(key: Column) -> Column:
    """Struct of person and organisation parts plus `valid`; all parts are null for a bad key."""
    pattern = f"^(.*){PAIR}(.*)({_one_of(STAFF_SEPARATORS.values())})(.*){PAIR}(.*)$"
    valid = F.coalesce(key.rlike(pattern), F.lit(False))

    def part(n: int) -> Column:
        return F.regexp_extract(key, pattern, n)

    fields = [F.when(valid, part(1)).alias("sp_id"), F.when(valid, part(2)).alias("sp_scope")]
    for kind, sep in STAFF_SEPARATORS.items():
        here = valid & (part(3) == sep)
        fields += [F.when(here, part(4)).alias(f"{kind}_id"), F.when(here, part(5)).alias(f"{kind}_scope")]
    return F.struct(*fields, valid.alias("valid"))


def parse_ranking_key(key: Column) -> Column:
    """Struct of owner, subject, label and position plus `valid`; a position that is no number is null."""
    separators = [sep for _, _, sep in RANKING_KINDS.values()]
    pattern = f"^(.*){PAIR}(.*)({_one_of(separators)})(.*){PAIR}(.*){RANK_LABEL}(.*){RANK_POSITION}(.*)$"
    valid = F.coalesce(key.rlike(pattern), F.lit(False))

    def part(n: int) -> Column:
        return F.regexp_extract(key, pattern, n)

    fields = []
    for prefix, group in (("stage", 1), ("event", 1), ("team", 4), ("sp", 4)):
        seps = [sep for owner, subject, sep in RANKING_KINDS.values() if prefix in (owner, subject)]
        here = valid & part(3).isin(seps)
        fields += [
            F.when(here, part(group)).alias(f"{prefix}_id"),
            F.when(here, part(group + 1)).alias(f"{prefix}_scope"),
        ]
    fields += [
        F.when(valid, part(6)).alias("date_time_label"),
        F.when(valid, part(7).try_cast("double")).alias("ranking"),
    ]
    return F.struct(*fields, valid.alias("valid"))
