"""Graphs, search windows and streams."""

import pytest
from pyspark.sql import functions as F

from docgraph.operators import graph, relations, search
from docgraph.streaming import incremental


def edges(spark, *pairs):
    return spark.createDataFrame([(p[0], p[1]) for p in pairs], "src string, dst string")


def by_origin(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.origin, set()).add(r.node)
    return out


def test_leaves(spark):
    e = edges(spark, "AB", "BC", "DC")
    assert by_origin(graph.leaves(e, graph.start_rows(spark, list("ABCD")))) == {k: {"C"} for k in "ABCD"}


@pytest.mark.parametrize(("pairs", "want"), [(("AB", "BC", "DB"), set("ABD")), (("AB", "BC", "CA", "CD"), set("ABC"))])
def test_ancestors(spark, pairs, want):
    e = edges(spark, *pairs)
    assert by_origin(graph.leaf_ancestors(e, graph.start_rows(spark, list("ABCD")))) == {k: want for k in "ABCD"}


def pairs_of(df):
    return {(r.src, r.dst) for r in df.collect()}


def test_merge_and_replace(spark):
    a, b = [("A.md", "A.html")], [("B.md", "B.html")]
    make = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    assert pairs_of(graph.merge(make(a), make(b))) == {*a, *b}
    old, new = make([("A.md", "B.md"), ("B.md", "B.html")]), make([("C.md", "B.md"), ("B.md", "B.html")])
    assert pairs_of(graph.replace_incoming(old, new, spark.createDataFrame([("B.md",)], "node string"))) == {("B.md", "B.html"), ("C.md", "B.md")}
    added = graph.replace_incoming(make([("A.md", "B.md")]), make([("B.md", "C.md")]), spark.createDataFrame([("C.md",)], "node string"))
    assert pairs_of(added) == {("A.md", "B.md"), ("B.md", "C.md")}
    assert pairs_of(graph.remove_node(old, "A.md")) == {("B.md", "B.html")}


def test_reach_by_depth(spark):
    e = edges(spark, "AB", "BC", "CA", "CD", "XY")
    hops = lambda d: {r.node: r.hops for r in graph.reach(e, graph.start_rows(spark, ["A"]), d, undirected=True).collect()}
    assert hops(0) == {"A": 0} and hops(1) == {"A": 0, "B": 1, "C": 1} and hops(-1) == {"A": 0, "B": 1, "C": 1, "D": 2}


def test_orphans_and_degrees(spark):
    e = edges(spark, "AB", "BB")
    nodes = spark.createDataFrame([("A",), ("Z",)], "node string")
    assert [r.node for r in graph.orphans(nodes, e).collect()] == ["Z"]
    assert {r.node: (r.n_in, r.n_out) for r in graph.in_out(nodes, e).collect()} == {"A": (0, 1), "Z": (-1, -1)}
    assert {r.node: r.n for r in graph.degrees(e).collect()} == {"A": 1, "B": 2}


def test_folders_by_whole_segments(spark):
    p = spark.createDataFrame([("a/x",), ("ab/c",), ("a/index",), ("tags/t",)], "slug string")
    assert {(r.folder, r.slug) for r in relations.folder_children(p).collect()} == {("a", "a/x"), ("ab", "ab/c"), ("tags", "tags/t")}
    assert {r.folder for r in relations.folders(p).collect()} == {"a", "ab"}
    assert [r.folder for r in relations.missing_indexes(p).collect()] == ["ab"]


@pytest.mark.parametrize("n", [0, 1, 29, 30, 31, 61])
def test_best_window(spark, n):
    tokens = ["hit" if k % 7 == 3 else "x" for k in range(n)]
    df = spark.createDataFrame([(1, tokens)], "id int, tokens array<string>")
    got = search.best_window(df, "tokens", lambda t: t == "hit").collect()
    best, most = 0, 0
    for i in range(max(0, n - 30)):
        s = tokens[i : i + 30].count("hit")
        if s >= most:
            best, most = i, s
    assert [(r.n, r.best) for r in got] == [(n, best)]


def test_ordered_union(spark):
    lists = [spark.createDataFrame(rows, "id int, rank int") for rows in ([(1, 1)], [(2, 1), (1, 2)], [(3, 1), (2, 2)])]
    assert {(r.id, r.prio, r["rank"]) for r in relations.ordered_union(*lists).collect()} == {(1, 0, 1), (2, 1, 1), (3, 2, 1)}


EVENTS = [("a", "add", 1, 1, "v1"), ("b", "add", 1, 2, "w"), ("a", "change", 2, 3, "v2"), ("b", "delete", 2, 4, None), ("a", "delete", 3, 5, None), ("a", "add", 3, 6, "v3")]


def test_snapshot(spark):
    e = spark.createDataFrame(EVENTS, "path string, change string, ts int, seq int, value string")
    before = spark.createDataFrame([("b", "old"), ("c", "kept")], "path string, value string")
    assert {(r.path, r.value) for r in incremental.merge_snapshot(before, e, "path", "ts", "seq").collect()} == {("a", "v3"), ("c", "kept")}
    build, remove = incremental.pending(e, "path", "ts", "seq")
    assert [r.path for r in build.collect()] == ["a"] and [r.path for r in remove.collect()] == ["b"]


@pytest.mark.parametrize("order", ["in order", "backwards", "mixed"])
def test_stream(spark, tmp_path, order):
    """Each event is a micro-batch of its own, whenever it happened; a second start goes on where the first ended."""
    schema = "path string, change string, ts int, seq int, value string"
    events = {"in order": EVENTS, "backwards": EVENTS[::-1], "mixed": [EVENTS[k] for k in (5, 1, 3, 0, 4, 2)]}[order]
    columns, at = ["path", "value"], {name: str(tmp_path / name) for name in ("in", "state", "cp")}
    for rows in (events[:3], events[3:]):
        for e in rows:
            spark.createDataFrame([e], schema).coalesce(1).write.mode("append").parquet(at["in"])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at["in"])
        seen = []
        q = incremental.run_incremental(stream, at["state"], at["cp"], "path", columns, ("ts", "seq"), lambda df, n, seen=seen: seen.append((n, df.count())), buckets=4)
        q.awaitTermination()
    assert [n for n, _ in seen] == [3, 4, 5]
    shape = spark.createDataFrame([], schema).select("path", "value", "ts", "seq").schema
    assert [(r.path, r.value) for r in incremental.live(spark, at["state"], shape, columns).collect()] == [("a", "v3")]


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    import os

    schema = "path string, change string, ts int, seq int, value string"
    for k in range(3):
        spark.createDataFrame([(f"p{k}", "add", 1, k, "x")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run_incremental(stream, str(tmp_path / "state"), str(tmp_path / "cp"), "path", ["path"], ("ts", "seq"), buckets=64).awaitTermination()
    assert all(len([d for d in os.listdir(tmp_path / "state/data" / v) if d.startswith("bucket")]) == 1 for v in os.listdir(tmp_path / "state/data"))


def test_listing(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, modified int")
    found = incremental.listing_events(rows(("a", 1), ("b", 1), ("c", 1)), rows(("b", 2), ("c", 1), ("d", 1)), 9).collect()
    assert {(r.path, r.ts, r.change) for r in found} == {("a", 9, "delete"), ("b", 2, "change"), ("d", 1, "add")}


def test_numbered(spark):
    """Numbers within groups, though groups lie in several ranges."""
    import random

    r = random.Random(1)
    table = [(r.choice(["x", "y", None]), r.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(table, "g string, v int, id int").repartition(7)
    out = relations.numbered(df, "g", [F.desc("v"), F.col("id")]).collect()
    want = {}
    for g, _, k in sorted(table, key=lambda t: (-t[1], t[2])):
        want.setdefault(g, []).append(k)
    got = {}
    for row in sorted(out, key=lambda row: row.place):
        got.setdefault(row.g, []).append(row.id)
    assert got == want and {row.place for row in out if row.g == "x"} == set(range(1, len(want["x"]) + 1))


def test_stored_index(spark, tmp_path):
    """A stored index answers as one that is made for the query, letters of any kind included."""
    docs = spark.createDataFrame([(1, "The three thieves"), (2, "there é été"), (3, "t é"), (4, "")], "id long, text string")
    from docgraph.functions.text import search_tokens

    postings = search.index(docs, "id", {"text": search_tokens(F.col("text"))})
    stored = search.store(postings, str(tmp_path / "index"), 2)
    for terms in (["th"], ["the", "thr"], ["é"], ["t"], ["ét", "t"], ["zz"]):
        answers = [{tuple(r) for r in search.query(p, terms).collect()} for p in (postings, stored)]
        assert answers[0] == answers[1], terms
    import re

    assert re.search(r"PartitionFilters: \[[^\]]*head", search.query(stored, ["th"])._jdf.queryExecution().toString())


def test_watch(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    q = incremental.watch_folder(spark, str(tmp_path)).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.table("watched").collect()] == ["x"]
