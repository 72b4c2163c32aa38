"""TPC-H-like tables seen as the twelve entity types.

Reference lists come as rows, never gathered into arrays, so an owner may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from xrel.sources.entities import EntitySet, OnDemand, external_key

SCOPE = "tpch"

# Kind of an event's line: odd line numbers name a team, even ones a person and a team.
IS_PERSON_LINE = "l_linenumber % 2 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _fk(prefix: str, value: Column) -> list[Column]:
    value = _text(value)
    scope = F.when(value.isNotNull(), F.lit(SCOPE))
    return [value.alias(f"{prefix}_id"), scope.alias(f"{prefix}_scope")]


def _no_fk(*prefixes: str) -> list[Column]:
    null = F.lit(None).cast("string")
    return [null.alias(f"{p}_{c}") for p in prefixes for c in ("id", "scope")]


def _entity(df: DataFrame, kind: str, ext_id: Column, name: Column, *extra: Column, language: Column | None = None) -> DataFrame:
    names = F.create_map(F.lit("en"), name, F.lit("fr"), F.upper(name))
    return df.select(
        F.concat(F.lit(f"{kind}:"), _text(ext_id)).alias("id"),
        _text(ext_id).alias("ext_id"),
        F.lit(SCOPE).alias("ext_scope"),
        F.lit(kind).alias("resource_type"),
        names.alias("name"),
        (F.lit("en") if language is None else language).alias("default_language"),
        *extra,
    )


def month_of(ts: str) -> Column:
    return F.substring(F.col(ts).cast("string"), 1, 7)


def year_of(ts: str) -> Column:
    return F.substring(F.col(ts).cast("string"), 1, 4)


def brand_number(brand: str = "p_brand") -> Column:
    return F.regexp_extract(brand, r"(\d+)$", 1).cast("int")


def _owned(df: DataFrame, kind: str, ext_id: Column, *refs: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{kind}:"), _text(ext_id)).alias("owner_id"),
        F.concat(_text(ext_id), F.lit(f" @ {SCOPE}")).alias("owner_key"),
        *refs,
    )


def participants(lines: DataFrame) -> DataFrame:
    """Event participants from order lines."""
    return _owned(
        lines,
        "event",
        F.col("l_orderkey"),
        *_fk("team", F.col("l_suppkey")),
        *_fk("sp", F.when(F.expr(IS_PERSON_LINE), F.col("l_partkey"))),
    )


def key_moments(events: DataFrame, *keep: str) -> DataFrame:
    """Key moments from event records, with their key, the person each names and the columns to keep."""
    rows = _entity(
        events, "keyMoment", F.col("event_id"), F.lit(None).cast("string"),
        *_fk("event", F.col("event_id")),
        F.col("event_type").alias("type"),
        F.get_json_object("props", "$.k").alias("sub_type"),
        F.col("ts").cast("timestamp_ntz").alias("date_time"),
        *_fk("sp", F.col("user_id")),
        *keep,
    )
    return rows.withColumn("external_key", external_key("keyMoment"))


def _rankings(orders: DataFrame, lines: DataFrame) -> DataFrame:
    months = orders.select("o_orderkey", month_of("o_orderdate").alias("month"))
    sales = (
        lines.join(months, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("month", "l_suppkey")
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    )
    by_amount = Window.partitionBy("month").orderBy(F.desc("amount"), "l_suppkey")
    of_stage = sales.withColumn("place", F.row_number().over(by_amount)).where("place <= 10")
    prices = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"))
    by_price = Window.partitionBy("l_orderkey").orderBy(F.desc("price"), "l_partkey")
    of_event = prices.withColumn("place", F.row_number().over(by_price)).where("place <= 3")
    label = F.lit("latest").alias("date_time_label")
    place = F.col("place").cast("double").alias("ranking")
    teams = _entity(
        of_stage,
        "ranking",
        F.concat(F.lit("s:"), F.col("month"), F.lit(":"), _text("l_suppkey")),
        F.concat(F.lit("Place "), _text("place")),
        *_fk("stage", F.col("month")),
        *_no_fk("event"),
        *_fk("team", F.col("l_suppkey")),
        *_no_fk("sp"),
        label,
        place,
    )
    persons = _entity(
        of_event,
        "ranking",
        F.concat(F.lit("e:"), _text("l_orderkey"), F.lit(":"), _text("l_partkey")),
        F.concat(F.lit("Place "), _text("place")),
        *_no_fk("stage"),
        *_fk("event", F.col("l_orderkey")),
        *_no_fk("team"),
        *_fk("sp", F.col("l_partkey")),
        label,
        place,
    )
    return teams.unionByName(persons)


def _staff(part: DataFrame, lines: DataFrame) -> DataFrame:
    named = part.select("p_partkey", "p_name")
    of_team = (
        lines.where("l_linenumber = 7")
        .select("l_partkey", "l_suppkey")
        .distinct()
        .join(named, F.col("l_partkey") == F.col("p_partkey"))
    )

    def staff(df: DataFrame, tag: str, person: str, org: str, org_id: Column) -> DataFrame:
        others = [o for o in ("team", "club", "nation") if o != org]
        return _entity(
            df,
            "staff",
            F.concat(F.lit(f"{tag}:"), _text(person), F.lit(":"), _text(org_id)),
            F.col("p_name"),
            *_fk("sp", F.col(person)),
            *_fk(org, org_id),
            *_no_fk(*others),
            F.create_map(F.lit("en"), F.col("p_name")).alias("last_name"),
        )

    rows = staff(of_team, "t", "l_partkey", "team", F.col("l_suppkey"))
    of_club = part.where("p_type = 'ECONOMY'")
    of_nation = part.where("p_type = 'SMALL'")
    return rows.unionByName(staff(of_club, "c", "p_partkey", "club", F.col("p_brand"))).unionByName(
        staff(of_nation, "n", "p_partkey", "nation", F.col("p_size") % 25)
    )


def entities(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, orders: DataFrame | None = None) -> EntitySet:
    """The twelve entity types over the tables in `sf_dir`; `lines` and `orders` may stand in for an older state."""
    read = OnDemand({n: (lambda n=n: table(spark, sf_dir, n)) for n in ("region", "nation", "customer", "supplier", "part", "events")})
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines

    def years():
        return orders.select(year_of("o_orderdate").alias("y")).distinct()

    def brands():
        return read["part"].select("p_brand").distinct().withColumn("b", brand_number())

    def in_region(df: DataFrame, nation_key: str) -> DataFrame:
        regions = read["nation"].select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"))
        return df.join(regions, F.col(nation_key) == F.col("nk"))

    def even(c: str) -> Column:
        return F.col(c) % 2 == 0

    def sgo(value: Column) -> list[Column]:
        return _fk("sgo", value)

    def competition():
        start = F.concat(F.col("y"), F.lit("-01-01 00:00:00")).cast("timestamp_ntz")
        return _entity(years(), "competition", F.col("y"), F.concat(F.lit("Season "), F.col("y")), start.alias("start"))

    def stage():
        months = orders.select(month_of("o_orderdate").alias("m")).distinct()
        return _entity(
            months, "stage", F.col("m"), F.concat(F.lit("Round "), F.col("m")),
            *_fk("competition", F.substring("m", 1, 4)),
        )

    def event():
        return _entity(
            orders, "event", F.col("o_orderkey"), F.concat(F.lit("Order "), _text("o_orderkey")),
            *_fk("stage", month_of("o_orderdate")),
            *_fk("venue", F.col("o_custkey")),
            F.col("o_orderdate").cast("timestamp_ntz").alias("date_time"),
        )

    def team():
        return _entity(
            read["supplier"], "team", F.col("s_suppkey"), F.col("s_name"),
            *_fk("club", F.concat(F.lit("Brand#"), _text(F.col("s_suppkey") % 25 + 1))),
            *_fk("nation", F.col("s_nationkey")),
            *_fk("venue", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey"))),
        )

    def venue():
        # Households name a language the row has no text for.
        language = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("de")).otherwise(F.lit("en"))
        return _entity(read["customer"], "venue", F.col("c_custkey"), F.col("c_name"), language=language)

    def club():
        return _entity(
            brands(), "club", F.col("p_brand"), F.col("p_brand"), *_fk("venue", F.when(even("b"), F.col("b") * 3))
        )

    def nation():
        return _entity(
            read["nation"], "nation", F.col("n_nationkey"), F.col("n_name"),
            *_fk("venue", F.when(even("n_nationkey"), F.col("n_nationkey") * 2)),
        )

    def sports_person():
        return _entity(
            read["part"], "sportsPerson", F.col("p_partkey"), F.col("p_name"),
            F.create_map(F.lit("en"), F.col("p_name")).alias("last_name"),
        )

    def key_moment_participants():
        return key_moments(read["events"]).select(
            F.col("id").alias("owner_id"), F.col("external_key").alias("owner_key"),
            *_no_fk("team"), "sp_id", "sp_scope",
        )

    def competition_memberships():
        regions = read["region"].select("r_regionkey", (F.col("r_regionkey") % 2).alias("odd"))
        pairs = years().join(regions, F.col("y").cast("int") % 2 == F.col("odd"))
        return _owned(pairs, "competition", F.col("y"), *sgo(F.col("r_regionkey")))

    region_key = F.col("r_regionkey")
    tables = {
        "competition": competition,
        "stage": stage,
        "event": event,
        "team": team,
        "venue": venue,
        "club": club,
        "sgo": lambda: _entity(read["region"], "sgo", region_key, F.col("r_name"), *_fk("venue", region_key)),
        "nation": nation,
        "sportsPerson": sports_person,
        "staff": lambda: _staff(read["part"], lines),
        "ranking": lambda: _rankings(orders, lines),
        "keyMoment": lambda: key_moments(read["events"]).drop("external_key", "sp_id", "sp_scope"),
    }
    refs = {
        ("event", "participants"): lambda: participants(lines),
        ("keyMoment", "participants"): key_moment_participants,
        ("team", "members"): lambda: _owned(
            lines.where("l_linenumber = 1"), "team", F.col("l_suppkey"), *_fk("sp", F.col("l_partkey"))
        ),
        ("club", "members"): lambda: _owned(read["part"], "club", F.col("p_brand"), *_fk("sp", F.col("p_partkey"))),
        ("competition", "memberships"): competition_memberships,
        ("team", "memberships"): lambda: _owned(
            in_region(read["supplier"], "s_nationkey"), "team", F.col("s_suppkey"), *sgo(F.col("rk"))
        ),
        ("venue", "memberships"): lambda: _owned(
            in_region(read["customer"], "c_nationkey"), "venue", F.col("c_custkey"), *sgo(F.col("rk"))
        ),
        ("club", "memberships"): lambda: _owned(brands(), "club", F.col("p_brand"), *sgo(F.col("b") % 5)),
        ("nation", "memberships"): lambda: _owned(read["nation"], "nation", F.col("n_nationkey"), *sgo(F.col("n_regionkey"))),
        ("sgo", "memberships"): lambda: _owned(read["region"].where("r_regionkey > 0"), "sgo", region_key, *sgo(region_key - 1)),
    }
    return EntitySet(tables, refs)
