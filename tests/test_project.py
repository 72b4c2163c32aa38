from __future__ import annotations

import pytest

from tests import small
from xrel.operators.project import project

TAGS = [("role", "a"), ("shirt", "b"), ("shirtNo", "c")]


@pytest.fixture(scope="module")
def row(spark):
    schema = (
        "id string, name map<string,string>, place struct<city:string,zip:string>, tags array<struct<name:string,value:string>>, "
        + small.schemas.PARTICIPANTS
    )
    people = [("t", "x", None, None, TAGS), (None, None, "p", "x", TAGS), ("t", "x", "p", "x", None)]
    return spark.createDataFrame([("1", {"en": "A", "fr": "B"}, ("c", "z"), TAGS, people)], schema)


def one(row, include=(), exclude=()):
    return project(row, list(include), list(exclude)).first()


def names(tags):
    return None if tags is None else [t.name for t in tags]


def test_fields(row):
    assert project(row, ["name.en", "place.city"]).columns == ["id", "name", "place"]
    got = one(row, ["name.en", "place.city"])
    assert got.name == {"en": "A"} and got.place.asDict() == {"city": "c"}
    got = one(row, [], ["name.en", "place.zip", "tags", "participants", "unknown"])
    assert got.asDict(True) == {"id": "1", "name": {"fr": "B"}, "place": {"city": "c"}}
    assert project(row).columns == row.columns


def test_tags(row):
    assert names(one(row, ["tags>shirt*"]).tags) == ["shirt", "shirtNo"]
    assert names(one(row, ["tags > role > shirt"]).tags) == ["role", "shirt"]
    assert names(one(row, [], ["tags>shirt*"]).tags) == ["role"]
    assert names(one(row, ["tags>shirt*"], ["tags>shirt"]).tags) == ["shirtNo"]
    assert project(row, ["tags"], ["tags"]).columns == ["id"]


def test_participants(row):
    def shown(include=(), exclude=()):
        return [(p.team_id, p.sp_id, names(p.tags)) for p in one(row, include, exclude).participants]

    full = names(one(row).tags)
    assert shown(["participants.team"]) == [("t", None, full), ("t", "p", None)]
    assert len(shown(["participants.team", "participants.sp"])) == 3
    assert shown([], ["participants.team"]) == [(None, "p", full)]
    assert shown([], ["participants.team", "participants.sp"]) == []
    assert shown(["participants.tags>role"]) == [("t", None, ["role"]), (None, "p", ["role"]), ("t", "p", [])]
    assert shown([], ["participants.sp.tags"]) == [("t", None, full), (None, "p", None), ("t", "p", None)]
    assert shown([], ["participants.team.tags>role"]) == [("t", None, ["shirt", "shirtNo"]), (None, "p", full), ("t", "p", [])]
