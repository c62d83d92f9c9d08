"""Connected components that survive hubs and long chains: alternating stars.

A large star hangs the larger neighbours of every node on the smallest one among them and itself, a small
star does so with the smaller neighbours. Both keep components as they are, and after a few rounds (their
number grows with the square of the logarithm of the longest chain) each component is one star around its smallest id.
There is no bound on rounds: they end when nothing changes.

A node's minimum is aggregated before it is joined to its links, and links of a hub are joined in place, so a
star with any number of leaves is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.operators.joins import join_counted
from galena.sources.tables import discard, materialize


def _hung(links: DataFrame, low: Column) -> DataFrame:
    """(a, b, low) of links (a, b), low: smallest of a and its b."""
    least = links.groupBy("a").agg(low.alias("low"), F.count("*").alias("__n"))
    return join_counted(links, least, "a", "__n").drop("__n")


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = _hung(both, F.least(F.min("b"), F.first("a"))).where("b > a")
    return rows.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """``links`` are those of a large star, so b is the smaller end."""
    rows = _hung(links, F.min("b"))
    hung = rows.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(rows.select("a", F.col("low").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id of the component of each node of ``edges`` (a, b; null and equal ends link nothing).

    Ids of any one type that can be ordered; repeated links count once; no links give no rows.
    """
    given = materialize(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    nodes = given.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links, state = given.where("a <> b"), None
    if links.isEmpty():
        return nodes.select("id", F.col("id").alias("cluster"))
    while True:
        large = materialize(large_star(links))
        step = materialize(small_star(large))
        discard(large)
        if state is not None:
            discard(links)
        links = step
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    return nodes.join(links, nodes["id"] == links["a"], "left").select("id", F.coalesce("b", "id").alias("cluster"))
