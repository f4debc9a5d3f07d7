"""Queries on graphs: foreign keys as edges, and the pages' links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..streaming import incremental
from .tables import LINKS, NODES, links, nodes, query, read

#: Customers, nations and regions as one graph.
_FK = "e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r1', 'n3')"


def _edges(spark, sf):
    c = read(spark, sf, "customer")
    n = read(spark, sf, "nation")
    text = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    loop = spark.createDataFrame([("r1", "n3")], "src string, dst string")  # a cycle where nation 3 lies in region 1
    return c.select(text("c", "c_custkey").alias("src"), text("n", "c_nationkey").alias("dst")).unionByName(n.select(text("n", "n_nationkey").alias("src"), text("r", "n_regionkey").alias("dst"))).unionByName(loop).distinct()


@query(f"WITH RECURSIVE {_FK}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT 'n3' AS node, 0 AS h UNION SELECT b.dst, h + 1 FROM k JOIN b ON b.src = node WHERE h < 3) SELECT node, min(h)::BIGINT AS hops FROM k GROUP BY node")
def graph_khop(spark, sf):
    """All within three hops of a nation, either way."""
    return graph.reach(_edges(spark, sf), graph.start_rows(spark, ["n3"]), 3, undirected=True).select("node", "hops")


@query(f"WITH RECURSIVE {_FK}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT 'n3' AS node, 0 AS h UNION SELECT b.dst, h + 1 FROM k JOIN b ON b.src = node WHERE h < 1) SELECT DISTINCT e.src, e.dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def graph_neighbourhood_links(spark, sf):
    from ..operators.relations import neighbourhood_links

    e = _edges(spark, sf)
    return neighbourhood_links(e, graph.reach(e, graph.start_rows(spark, ["n3"]), 1, undirected=True))


@query(f"WITH {LINKS} SELECT node, count(*)::BIGINT AS n, 2 + sqrt(count(*)) AS radius FROM (SELECT src, dst, unnest(list_distinct([src, dst])) AS node FROM lk) GROUP BY node")
def graph_degree(spark, sf):
    return graph.degrees(links(spark, sf))


@query(f"WITH {LINKS}, n AS (SELECT src AS node FROM lk UNION SELECT dst FROM lk UNION SELECT 'nowhere') SELECT node, CASE WHEN i IS NULL AND o IS NULL THEN -1 ELSE coalesce(i, 0) END AS n_in, CASE WHEN i IS NULL AND o IS NULL THEN -1 ELSE coalesce(o, 0) END AS n_out FROM n LEFT JOIN (SELECT dst, count(*) AS i FROM lk GROUP BY dst) a ON a.dst = node LEFT JOIN (SELECT src, count(*) AS o FROM lk GROUP BY src) b ON b.src = node")
def graph_in_out(spark, sf):
    e = links(spark, sf)
    return graph.in_out(graph.nodes_of(e).unionByName(spark.createDataFrame([("nowhere",)], "node string")), e)


_UP = f"WITH RECURSIVE {_FK}, r AS (SELECT o AS origin, o AS node FROM (VALUES ('n3'), ('n7'), ('c0')) t(o) UNION SELECT origin, e.dst FROM r JOIN e ON e.src = node)"
_LEAF = "lf AS (SELECT origin, node FROM r WHERE node NOT IN (SELECT src FROM e))"


@query(f"{_UP}, {_LEAF} SELECT origin, node FROM lf")
def graph_leaves(spark, sf):
    return graph.leaves(_edges(spark, sf), graph.start_rows(spark, ["n3", "n7", "c0"]))


@query(f"{_UP}, {_LEAF}, a AS (SELECT origin, node FROM lf UNION SELECT origin, e.src FROM a JOIN e ON e.dst = node) SELECT DISTINCT origin, node FROM a WHERE (origin, node) NOT IN (SELECT origin, node FROM lf)")
def graph_ancestors(spark, sf):
    return graph.leaf_ancestors(_edges(spark, sf), graph.start_rows(spark, ["n3", "n7", "c0"]))


@query(f"{_UP}, {_LEAF}, a AS (SELECT origin, node FROM lf UNION SELECT origin, e.src FROM a JOIN e ON e.dst = node) SELECT DISTINCT origin, node FROM a")
def incremental_affected(spark, sf):
    """What to build again when three sources change."""
    return incremental.affected(_edges(spark, sf), graph.start_rows(spark, ["n3", "n7", "c0"]))


@query(f"WITH {NODES} SELECT slug AS node FROM nd WHERE slug NOT IN (SELECT src FROM lk UNION SELECT dst FROM lk WHERE length(dst) > 2) AND slug NOT IN (SELECT dst FROM lk WHERE length(dst) > 2)")
def graph_orphans(spark, sf):
    """Nodes without edges, once edges to names of one or two letters are gone."""
    e = links(spark, sf)
    kept = e.filter("length(dst) > 2").unionByName(e.select("src", F.col("src").alias("dst")))
    return graph.orphans(nodes(spark, sf).select(F.col("slug").alias("node")), kept)


@query(f"WITH {_FK} SELECT src, dst FROM e UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier")
def graph_merge(spark, sf):
    s = read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return graph.merge(_edges(spark, sf), s)


@query(f"WITH {_FK} SELECT src, dst FROM e WHERE dst <> 'n3' UNION SELECT * FROM (VALUES ('x', 'n3'), ('n3', 'y')) t(src, dst)")
def graph_replace_incoming(spark, sf):
    new = spark.createDataFrame([("x", "n3"), ("n3", "y"), ("x", "n4")], "src string, dst string")
    return graph.replace_incoming(_edges(spark, sf), new, spark.createDataFrame([("n3",)], "node string"))


@query(f"WITH {_FK} SELECT src, dst FROM e WHERE src <> 'n3' AND dst <> 'n3'")
def graph_remove_node(spark, sf):
    return graph.remove_node(_edges(spark, sf), "n3")


@query(f"WITH {NODES}, tg AS (SELECT slug, split_part(slug, '/', 1) AS tag FROM pg WHERE contains(slug, '/')) SELECT src, dst, 'link' AS kind FROM lk WHERE dst IN (SELECT slug FROM nd) UNION SELECT slug, 'tags/' || tag, 'tag' FROM tg")
def link_tag_graph(spark, sf):
    from .tables import pages

    tags = pages(spark, sf).filter(F.contains("slug", F.lit("/"))).select("slug", F.split_part("slug", F.lit("/"), F.lit(1)).alias("tag"))
    return graph.link_graph(links(spark, sf), tags, nodes(spark, sf))


@query(f"WITH {LINKS}, n AS (SELECT src AS node FROM lk UNION SELECT 'tags/' || src FROM lk) SELECT node, CASE WHEN starts_with(node, 'tags/') THEN '#' || node[6:] ELSE coalesce(nullif(t, ''), node) END AS label FROM n LEFT JOIN (SELECT slug, min(title) AS t FROM pg GROUP BY slug) ON slug = node")
def graph_labels(spark, sf):
    from .tables import pages

    e = links(spark, sf)
    n = e.select(F.col("src").alias("node")).unionByName(e.select(F.concat(F.lit("tags/"), "src").alias("node"))).distinct()
    t = pages(spark, sf).groupBy("slug").agg(F.min("title").alias("t"))
    label = F.when(F.col("node").startswith("tags/"), F.concat(F.lit("#"), F.substr("node", F.lit(6)))).otherwise(F.coalesce(F.nullif("t", F.lit("")), "node"))
    return n.join(t, F.col("slug") == F.col("node"), "left").select("node", label.alias("label"))
