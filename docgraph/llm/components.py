"""Connected components of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the least node that links reach.

    Links may point either way, repeat, or join a node to itself; none may be null.  No links give no rows.  Each round
    is two aggregations and joins over the links that are left, written to the shared folder; nothing is collected.
    Rounds grow as the logarithm of the longest chain; after ``rounds`` of them, beyond any chain there can be, it raises.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    for _ in range(rounds):
        heads = edges.select(F.col("u").alias("head")).distinct()
        crossed = edges.groupBy("v").agg(F.count("*").alias("n")).join(heads, F.col("v") == F.col("head"), "left").filter("n > 1 or head is not null")
        if crossed.isEmpty():  # every node hangs on one that hangs on none
            break
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))  # larger neighbours to the least
        large = large.filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        edges = materialize(small, "links")
    else:
        raise RuntimeError("components have not settled")
    heads = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return edges.groupBy("v").agg(F.min("u").alias("u")).select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(heads)


def roots(parents: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a parent in the forest ``parents`` (a, b), where b < a; a node's parents beyond the least are left out.

    Each round halves every way to a root by one join; rounds grow as the logarithm of the longest way.
    """
    at = materialize(parents.filter("b < a").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "roots")
    for _ in range(rounds):
        up = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = at.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = materialize(new, "roots")
        at = new.select("node", "root")
        if new.filter("moved").isEmpty():
            return at
    raise RuntimeError("roots have not settled")
