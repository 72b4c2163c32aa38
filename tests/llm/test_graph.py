from __future__ import annotations

import random

from tests.llm import brute
from xrel.llm.graph import components


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = brute.groups(400, links)
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert {n: want[n] for n in nodes} == {n: got[n] for n in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
