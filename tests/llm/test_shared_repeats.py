from __future__ import annotations

import random

from tests.llm import brute
from tests.llm.test_paragraphs import cases as line_cases
from tests.llm.test_paragraphs import got as lines_got
from tests.llm.test_passages import cases, expected, got
from xrel.llm import paragraphs, passages
from xrel.llm.key_tables import among
from xrel.llm.passages import without_repeated_passages
from xrel.llm.queries import op5_repeated_paragraphs


def test_rows_among_a_table(spark):
    rows = spark.range(40_000).selectExpr("id", "cast(id % 3 as int) n", "'x' text")
    table = rows.where("id % 40 = 7").selectExpr("id", "cast(n as bigint) n")
    found = {r.id for r in among(rows, table, "id", "n").where("_among").collect()}
    wanted = set(range(7, 40_000, 40))
    assert wanted <= found and len(found - wanted) < 0.1 * 40_000
    assert among(rows, table.limit(0), "id", "n").where("_among").count() == 0
    assert among(rows, table, "id", "n").columns == ["id", "n", "text", "_among"]


def test_more_than_may_be_broadcast(spark, table, monkeypatch):
    """Only texts that may be asked for are joined, with the same results."""
    monkeypatch.setattr(paragraphs, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 0)
    asked = []
    for module in (paragraphs, passages):
        monkeypatch.setattr(module, "among", lambda rows, other, *keys: asked.append(keys) or among(rows, other, *keys))
    key = lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())
    rows = sorted(line_cases(8), key=key)
    assert lines_got(paragraphs.without_repeated_paragraphs(table(rows))) == sorted(brute.repeated_paragraphs(rows), key=repr)
    rows = sorted(cases(4), key=key)
    assert got(without_repeated_passages(table(rows))) == sorted(expected(rows), key=repr)
    assert asked.count(("id", "n")) >= 4


def test_what_other_documents_have_first(spark, table, tmp_path):
    """n_shared tells lines and passages that stand in an earlier document from repeats within one."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, passage, own = words(60), words(70), words(65)
    rows = [
        (1, f"{line}\n{words(40)} {passage} {words(9)}"),
        (2, f"{words(30)}\n{line}"),  # a whole line
        (3, f"{words(8)} {passage} {words(90)}"),  # within a longer line
        (4, f"{own}\n{own}\n{words(5)}"),  # a line repeated within one document
        (5, f"{(own2 := words(66))} {own2} end"),  # a passage repeated within one line
        (6, words(120)),
        (7, f"{line}\n{words(3)} {passage} {words(80)}"),
        (8, f"{passage} x {own2} {words(70)}"),
    ]
    table(rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in op5_repeated_paragraphs(spark, str(tmp_path)).collect()}
    assert {d: r.n_shared for d, r in found.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 2, 8: 2}
    assert [d for d, r in sorted(found.items()) if r.n_paragraphs + r.n_passages] == [2, 3, 4, 5, 7, 8]
