"""Path functions by literal vectors and by properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgraph.functions import paths


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


#: What the described system does with these paths.
VECTORS = {
    "simplify_slug": {"index": "/", "abc": "abc", "abc/index": "abc/", "abc/def": "abc/def"},
    "slugify_file_path": {
        "content/index.md": "content/index", "content/index.html": "content/index", "content/_index.md": "content/index", "/content/index.md": "content/index", "content/cool.png": "content/cool.png",
        "index.md": "index", "test.mp4": "test.mp4", "note with spaces.md": "note-with-spaces", "notes.with.dots.md": "notes.with.dots", "test/special chars?.md": "test/special-chars",
        "test/special chars #3.md": "test/special-chars-3", "cool/what about r&d?.md": "cool/what-about-r-and-d",
    },
    "transform_internal_link": {
        "": ".", ".": ".", "./": "./", "./index": "./", "./index#abc": "./#abc", "./index.html": "./", "./index.md": "./", "./index.css": "./index.css", "content": "./content", "content/test.md": "./content/test",
        "content/test.pdf": "./content/test.pdf", "./content/test.md": "./content/test", "../content/test.md": "../content/test", "tags/": "./tags/", "/tags/": "./tags/", "content/with spaces": "./content/with-spaces",
        "content/with spaces/index": "./content/with-spaces/", "content/with spaces#and Anchor!": "./content/with-spaces#and-anchor",
    },
    "path_to_root": {"index": ".", "abc": ".", "abc/def": "..", "abc/def/ghi": "../..", "abc/def/index": "../.."},
}

#: Paths that each guard of the described system lets pass, and those that it stops.
GUARDS = {
    "is_simple_slug": (["", "abc", "abc/", "notindex", "notindex/def"], ["//", "index", "https://example.com", "/abc", "abc/index", "abc#anchor", "abc?query=1", "index.md", "index.html"]),
    "is_relative_url": ([".", "..", "./abc/def", "./abc/def#an-anchor", "./abc/def?query=1#an-anchor", "../abc/def", "./abc/def.pdf"], ["abc", "/abc/def", "", "./abc/def.html", "./abc/def.md"]),
    "is_full_slug": (["index", "abc/def", "html.energy", "test.pdf"], [".", "./abc/def", "../abc/def", "abc/def#anchor", "abc/def?query=1", "note with spaces"]),
    "is_file_path": (["content/index.md", "content/test.png"], ["../test.pdf", "content/test", "./content/test"]),
}


@pytest.mark.parametrize("name", VECTORS)
def test_vectors(spark, name):
    cases = VECTORS[name]
    assert dict(zip(cases, each(spark, getattr(paths, name), list(cases)), strict=True)) == cases


@pytest.mark.parametrize("name", GUARDS)
def test_guards(spark, name):
    yes, no = GUARDS[name]
    assert each(spark, getattr(paths, name), yes + no) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    ("parts", "joined"),
    [(("a", "b"), "a/b"), (("a/", "b"), "a/b"), (("a", "b/"), "a/b/"), (("/a", "b"), "/a/b"), (("/a/", "b/"), "/a/b/"), (("/a/", "b", "/"), "/a/b/"), (("a/", "b/"), "a/b/"), (("https://example.com/", "a"), "https://example.com/a")],
)
def test_join_segments(spark, parts, joined):
    assert spark.range(1).select(paths.join_segments(*map(F.lit, parts))).first()[0] == joined


#: A site of the described system and where its three strategies lead.
SLUGS = ["a/b/c", "a/b/d", "a/b/index", "e/f", "e/g/h", "index", "a/test.png"]
RESOLVED = {
    ("absolute", "a/b/c"): {"a/b/d": "../../a/b/d", "a/b/index": "../../a/b/", "e/f": "../../e/f", "index": "../../", "index.png": "../../index.png", "index#abc": "../../#abc", "tag/test": "../../tag/test", "a/b/c#test": "../../a/b/c#test", "a/test.png": "../../a/test.png"},
    ("absolute", "index"): {"index": "./", "a/b/c": "./a/b/c", "a/b/index": "./a/b/"},
    ("shortest", "a/b/c"): {"d": "../../a/b/d", "h": "../../e/g/h", "a/b/index": "../../a/b/", "a/b/index.png": "../../a/b/index.png", "a/b/index#abc": "../../a/b/#abc", "index": "../../", "test.png": "../../a/test.png", "index#abc": "../../#abc"},
    ("shortest", "index"): {"d": "./a/b/d", "h": "./e/g/h", "a/b/index": "./a/b/", "index": "./"},
    ("relative", "a/b/c"): {"d": "./d", "index": "./", "../../../index": "../../../", "../../../index.png": "../../../index.png", "../../../e/g/h#abc": "../../../e/g/h#abc"},
    ("relative", "a/b/index"): {"../../index": "../../", "../../e/g/h": "../../e/g/h", "c": "./c"},
}


@pytest.mark.parametrize(("strategy", "source"), RESOLVED)
def test_link_strategies(spark, strategy, source):
    cases = RESOLVED[strategy, source]
    links = spark.createDataFrame([(source, t) for t in cases], "src string, target string")
    slugs = spark.createDataFrame([(s,) for s in SLUGS], "slug string")
    assert {r.target: r.url for r in paths.resolve_links(links, slugs, strategy).collect()} == cases


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab /&?#%.", max_size=12), min_size=1, max_size=20))
def test_slugs_hold_nothing_forbidden(spark, names):
    for slug in each(spark, paths.sluggify, names):
        assert not set(slug) & set(" ?#&%") and not slug.endswith("//")


def test_prefixes(spark):
    assert each(spark, paths.segment_prefixes, ["a/b/c", "a"]) == [["a", "a/b", "a/b/c"], ["a"]]
    assert each(spark, paths.ancestors, ["a/b/c", "a"]) == [["a", "a/b"], []]


TREE = ["cases/C-1-22", "cases/C-2-22", "cases/index", "topics/consent", "topics/old/consent", "index", "about"]


@pytest.mark.parametrize("source", ["about", "topics/consent", "cases/index", "topics/old/consent"])
def test_links_lead_back(spark, source):
    """From any page, a name that is unique leads to its page: root and resolved address together give the slug."""
    names = {"C-1-22": "cases/C-1-22", "C-2-22": "cases/C-2-22", "about": "about"}
    links = spark.createDataFrame([(source, n) for n in [*names, "consent"]], "src string, target string")
    slugs = spark.createDataFrame([(s,) for s in TREE], "slug string")
    found = {r.target: r.url for r in paths.resolve_links(links, slugs, "shortest").collect()}
    up = source.count("/")
    for name, slug in names.items():
        assert found[name] == ("/".join([".."] * up) if up else ".") + "/" + slug
    assert found["consent"].endswith("/consent") and "topics" not in found["consent"]  # two pages have this name
