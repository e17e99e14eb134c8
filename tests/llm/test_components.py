"""Connected components against a plain version."""

import random

import brute
import pytest

from weir.llm.components import components


@pytest.mark.parametrize("links", [[], [(3, 3)], [(1, 2), (2, 1), (1, 2)], [(n, n + 1) for n in range(40)], [(100, n) for n in range(30)] + [(200, 100)], [(50 - n, 51 - n) for n in range(50)] + [(77, 99)]])
def test_shapes(spark, links):
    check(spark, links)


def test_random(spark):
    rng = random.Random(5)
    check(spark, [(rng.randrange(400), rng.randrange(400)) for _ in range(260)])


def check(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.least_reachable({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
