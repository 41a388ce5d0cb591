"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, component): nodes of a component have one value, that of one of its nodes.

    Rounds of contraction: each node points to the neighbour (or itself) whose hash, new in each round, is least, and the
    links between the nodes pointed to are the next round's. About half of the nodes go in a round, whatever the
    graph's diameter; a hub's links meet in partial aggregates only. Then the pointers are followed back.
    """
    # null or equal ends link nothing
    links = stash(links.where("a <> b").select("a", "b").distinct(), "links")
    pointers: list[DataFrame] = []
    while links.limit(1).count():
        n = len(pointers)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("r"), F.col(c).alias("v"))  # noqa: B023, E731
        to = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("m")).select("node", F.least("m", ranked("node"))["v"].alias("to"))
        to = stash(to, "pointers")
        pointers.append(to)
        x, y = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        next_ = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        links = stash(next_, "links")
    if not pointers:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = pointers[-1].select("node", F.col("to").alias("component"))
    for to in reversed(pointers[:-1]):
        over = found.select(F.col("node").alias("to"), F.col("component").alias("c"))
        found = stash(to.join(over, "to", "left").select("node", F.coalesce("c", "to").alias("component")), "components")
    return found
