from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from xrel.functions import keys
from xrel.functions.dates import normalise_date
from xrel.functions.ranks import distributed_rank
from xrel.functions.text import camel_to_snake, nbsp_to_space, non_empty, split_camel
from xrel.functions.version import content_version


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, ["a", " ", "  \n", "", None, " x"], non_empty) == [True, False, False, False, False, True]
    assert values(spark, ["a b"], nbsp_to_space) == ["a b"]
    assert values(spark, ["fooBarBaz", "HTTPServer", "a1B"], camel_to_snake) == ["foo_bar_baz", "http_server", "a1_b"]
    got = values(spark, ["fooBarBaz", "lower", "", None, "OneTwoThree"], split_camel)
    assert tuple(got[0]) == ("Bar Baz", "Bar baz", "foo_bar_baz")
    assert tuple(got[1]) == ("lower", "lower", "lower")
    assert tuple(got[2]) == tuple(got[3]) == (None, None, None)
    assert tuple(got[4]) == ("One Two Three", "One two three", "one_two_three")


def test_dates(spark):
    given = ["2024-02-03", "2024-02-03T04:05:06", "2024-02-03T04:05:06.789Z", "2024-02-03T04:05:06+02:00", "soon", "", None, "2024-13-01"]
    assert values(spark, given, lambda c: normalise_date(c, 1, 2, 3)) == [
        "2024-02-03T01:02:03.000Z", "2024-02-03T04:05:06.000Z", "2024-02-03T04:05:06.789Z", "2024-02-03T02:05:06.000Z", None, None, None, None,
    ]
    assert values(spark, given[:1], lambda c: normalise_date(c, 25)) == ["2024-02-03T00:00:00.000Z"]
    assert values(spark, ["1969-12-31T23:59:59.5Z"], lambda c: normalise_date(c, date_only=True)) == ["1969-12-31"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, ["2024-03-10T02:30:00", "2024-07-01"], normalise_date) == ["2024-03-10T02:30:00.000Z", "2024-07-01T00:00:00.000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_key_parsing(spark):
    simple = values(spark, ["a @ b", "a", " @ b", None], keys.parse_simple_key)
    assert [tuple(s) for s in simple] == [("a", "b"), ("a", None), (None, "b"), (None, None)]
    staff = values(spark, ["p @ x /club/ c @ y", "p @ x", "p @ x /team/ t", None], keys.parse_staff_key)
    assert staff[0].club_id == "c" and staff[0].club_scope == "y" and staff[0].team_id is None and staff[0].valid
    assert [s.valid for s in staff] == [True, False, False, False]
    ranks = values(
        spark, ["s @ x /st/ t @ y /label/ latest /rank/ 2", "e @ x /esp/ p @ y /label/ l /rank/ first", "nothing"], keys.parse_ranking_key
    )
    assert (ranks[0].stage_id, ranks[0].team_scope, ranks[0].ranking, ranks[0].event_id) == ("s", "y", 2.0, None)
    assert (ranks[1].event_id, ranks[1].sp_id, ranks[1].ranking, ranks[1].valid) == ("e", "p", None, True)
    assert not ranks[2].valid


def test_content_version_matches_sorted_json(spark):
    rows = [
        {"b": "x\"y\n", "a": 1, "m": {"z": "1", "k": None}, "l": [3, 1, 2], "s": {"q": True, "c": "é"}, "d": 1.5, "n": None},
        {"b": "", "a": -7, "m": {}, "l": [], "s": {"q": False, "c": None}, "d": 12345678.25, "n": "t"},
    ]
    schema = "b string, a int, m map<string,string>, l array<int>, s struct<q:boolean,c:string>, d double, n string"
    df = spark.createDataFrame([tuple(r[c] if c != "s" else tuple(r["s"].values()) for c in ("b", "a", "m", "l", "s", "d", "n")) for r in rows], schema)
    got = [r.v for r in df.select(content_version(df).alias("v")).collect()]

    def version(value):
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()

    assert got == [version(r) for r in rows]


@pytest.mark.parametrize("value,text", [(2.0, "2"), (0.1, "0.1"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.00001, "0.00001"), (-3.25, "-3.25")])
def test_numbers_as_json(spark, value, text):
    df = spark.createDataFrame([(value,)], "d double")
    want = hashlib.sha256(f'{{"d":{text}}}'.encode()).hexdigest()
    assert df.select(content_version(df).alias("v")).first().v == want


def test_distributed_rank_equals_row_number(spark):
    rng = random.Random(7)
    rows = [("hot", f"{n:06d}") for n in rng.sample(range(100_000), 6000)] + [(f"g{i % 50}", f"{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v string").repartition(5)
    got = {(r.g, r.v): r["rank"] for r in distributed_rank(df, ["g"], "v", bucket_rows=100).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        for n, v in enumerate(sorted(v for h, v in rows if h == g), start=1):
            want[(g, v)] = n
    assert got == want
