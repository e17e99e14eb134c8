"""Connected components by contraction: nodes join their least neighbours, links are carried over to what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import stash


def _between(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links between different nodes, the smaller one first, each once."""
    return links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is linked with another; component is the least node reachable. Self-links
    and repeated or reversed links change nothing; no links, no rows.

    In a round every node is given the least of itself and its neighbours, and that one's in turn; the links between
    what remains go on to the next round, so that a link is read a few times only, however long the rounds go on. Each
    round's table is written. The least node of a component is given itself in all rounds, so it is what remains.
    """
    left, given = stash(_between(links, a, b), "links"), []
    while not given or left.limit(1).count():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("to"))
        near = stash(near, "near")
        further = near.select(F.col("node").alias("to"), F.col("to").alias("goal"))
        given.append(stash(near.join(further, "to").select("node", "goal"), "given"))
        for end in ("u", "v"):
            goals = given[-1].select(F.col("node").alias(end), F.col("goal").alias(f"{end}_goal"))
            left = left.join(goals, end)
        left = stash(_between(left, "u_goal", "v_goal"), "links")
    labels = given[0].select("node", F.col("goal").alias("component"))
    for more in given[1:]:
        more = more.select(F.col("node").alias("component"), "goal")
        labels = labels.join(more, "component", "left").select("node", F.coalesce("goal", "component").alias("component"))
    return stash(labels, "labels")
