"""Graph and tree operators on edges (src, dst); every loop keeps a frontier and what was visited apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, segment_prefixes
from .relations import numbered
from .tables import written


def reach(edges: DataFrame, start: DataFrame, depth: int = -1, undirected: bool = False) -> DataFrame:
    """(origin, node, hops) of what each start row (origin, node) reaches; depth below 0 has no limit.  Cycles end."""
    steps = edges.select("src", "dst")
    if undirected:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    steps = steps.distinct()
    frontier = start.select("origin", "node", F.lit(0).cast("long").alias("hops")).distinct()
    seen = written(frontier)
    frontier = seen
    k = 0
    while depth < 0 or k < depth:
        k += 1
        new = frontier.join(steps, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        frontier = written(new.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("hops", F.lit(k).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def leaves(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(origin, node): nodes without outgoing edges that each start reaches."""
    found = reach(edges, start)
    return found.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("origin", "node")


def leaf_ancestors(edges: DataFrame, start: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(origin, node): all that lead to the leaves that each start reaches, without the leaves; ``ends`` are those leaves where they are known."""
    ends = leaves(edges, start) if ends is None else ends
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, ends).filter("hops > 0").select("origin", "node").distinct().join(ends, ["origin", "node"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(nodes_of(edges), "node", "left_anti")


def remove_node(edges: DataFrame, node) -> DataFrame:
    return edges.filter((F.col("src") != node) & (F.col("dst") != node))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst").unionByName(b.select("src", "dst")).distinct()


def replace_incoming(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """The old edges, but those into ``nodes`` (node) as in ``new``; new edges from them are added."""
    into = nodes.select(F.col("node").alias("dst")).distinct()
    kept = old.join(into, "dst", "left_anti").select("src", "dst")
    ours = new.join(into, "dst", "left_semi").select("src", "dst")
    out = new.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    return kept.unionByName(ours).unionByName(out).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n (a loop counts once) and radius 2 + sqrt(n) of an undirected graph."""
    n = edges.distinct().select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    return n.withColumn("radius", F.lit(2.0) + F.sqrt(F.col("n").cast("double")))


def in_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n_in and n_out; -1 for a node that the graph lacks."""
    n_in = edges.distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    n_out = edges.distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    known = F.col("i").isNotNull() | F.col("o").isNotNull()
    joined = nodes.select("node").distinct().join(n_in, "node", "left").join(n_out, "node", "left")
    return joined.select("node", *[F.when(known, F.coalesce(c, F.lit(0))).otherwise(-1).cast("long").alias(n) for c, n in (("i", "n_in"), ("o", "n_out"))])


def tree(pages: DataFrame) -> DataFrame:
    """path, parent, depth and is_file of every folder and page (slug); the root has depth 0."""
    rows = pages.select("slug", F.posexplode(segment_prefixes(F.col("slug"))).alias("pos", "path"))
    leaf = F.col("path") == F.col("slug")
    out = rows.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"), (F.col("pos") + 1).cast("long").alias("depth"), leaf.alias("is_file"))
    return out.groupBy("path", "parent", "depth").agg(F.max("is_file").alias("is_file"))


def without_subtrees(nodes: DataFrame, dropped) -> DataFrame:
    """Tree rows but those at or below a path whose last segment meets ``dropped`` (a function of a column)."""
    return nodes.filter(~F.exists(F.split("path", "/"), dropped)).withColumn("name", basename(F.col("path")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, way) of every edge from either end; way is ``in`` or ``out``."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("way"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("way"))).distinct()


def folder_paths(pages: DataFrame) -> DataFrame:
    """path, place: folders of pages (slug) in pre-order, each before what it holds: the order of the arrays of their segments."""
    rows = pages.select(F.explode(ancestors(F.col("slug"))).alias("path")).distinct().withColumn("_all", F.lit(1))
    return numbered(rows, "_all", [F.split("path", "/")]).select("path", "place")


def link_graph(links: DataFrame, tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind): valid links, and a page's tags as edges to ``tags/...``."""
    ours = links.join(nodes.select(F.col("slug").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.lit("link").alias("kind"))
    theirs = tags.select(F.col("slug").alias("src"), F.concat(F.lit("tags/"), "tag").alias("dst"), F.lit("tag").alias("kind"))
    return ours.unionByName(theirs).distinct()


def start_rows(spark: SparkSession, names: list) -> DataFrame:
    return spark.createDataFrame([(n, n) for n in names], "origin string, node string")
