"""Files, front matter, markup and sinks."""

import pytest
from pyspark.sql import functions as F

from docgraph.functions import markup, refs, text
from docgraph.operators import relations
from docgraph.plans.pipeline import Pipeline, explicit_publish, remove_drafts
from docgraph.sources import sinks, vault
from docgraph.sources.front import parse_front

FILES = {
    "index.md": "---\ntitle: Home\ntags: [a/b, c]\n---\nSee [[Note One|first]] and ![[pic.png|100x50]].",
    "notes/Note One.md": "---\ntitle: 'One --- more'\ndate: 2022-10-27\naliases:\n  - Uno\n  - other/\ndraft: true\n---\nText ^b1\n\n^b2",
    "notes/crlf.md": "---\r\ntitle: Windows\r\ncreated: 2022-10-27T00:00:00.000Z\r\npublish: true\r\n---\r\nBody",
    "notes/plain.md": "no front matter",
    "notes/bad.md": "---\ntitle: [open\nnothing here\n---\nBody",
    "cases/C-1-22.md": "---\ntitle: [[C-1/22]]\ncase-number: [[C-1/23]]\ndate: 2022-01-02\ntopics:\nruling-articles:\n  - [[Article 15]]\n  - Article 6\nper-article:\n  - Article 6 | lawful\n---\nBody",
    "cases/C-2-22.md": "---\ntitle: C-2/22\ncase-number: C-2/22\nparties: A v B\ndate: never\n---\nBody",
    "private/x.md": "secret",
    "asset with space.png": "x",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, value in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(value.encode())
    return str(root)


@pytest.fixture(scope="module")
def pages(spark, folder):
    return {r.slug: r for r in vault.pages(vault.read_files(spark, folder, ignore=("^private/",))).collect()}


def test_pages(pages):
    assert set(pages) == {"index", "notes/Note-One", "notes/crlf", "notes/plain", "notes/bad", "cases/C-1-22", "cases/C-2-22"}
    assert pages["index"].tags == ["a/b", "c"] and pages["index"].title == "Home"
    one = pages["notes/Note-One"]
    assert one.title == "One --- more" and one.draft == "true" and str(one.dates.created)[:10] == "2022-10-27" and one.aliases == ["notes/Uno", "notes/other/index"]
    assert pages["notes/crlf"].title == "Windows" and pages["notes/crlf"].body == "Body" and str(pages["notes/crlf"].dates.created)[:10] == "2022-10-27"
    assert pages["notes/plain"].title == "plain" and pages["notes/plain"].error is None
    assert pages["notes/bad"].error and pages["cases/C-2-22"].date_invalid and not one.date_invalid


def test_cases(spark, folder):
    found = {r.file_name: r for r in vault.cases(vault.read_files(spark, folder)).collect()}
    assert set(found) == {"C-1-22", "C-2-22"}
    one, two = found["C-1-22"], found["C-2-22"]
    assert one.case_number == "C-1/23" and one.number_differs and not two.number_differs and one.parties is None and two.parties == "A v B" and one.topics is None and two.date is None
    assert one.ruling_articles == ["Article 15", "Article 6"] and [(p.article, p.text) for p in one.per_article] == [(6, "lawful")]


def test_invalid_front(spark, folder):
    assert [r.path for r in vault.front_is_valid(vault.read_files(spark, folder)).collect()] == ["notes/bad.md"]
    assert {r.destination for r in sinks.asset_manifest(vault.read_assets(spark, folder).select(F.lit("asset with space.png").alias("path"))).collect()} == {"asset-with-space.png"}


@pytest.mark.parametrize(
    ("front", "want"),
    [
        ("a: 1\nb: [x, 'y, z']", {"a": "1", "b": ["x", "y, z"]}), ("a:\n- p\n- q", {"a": ["p", "q"]}), ("a: |\n  one\n  two\nb: ~", {"a": "one\ntwo", "b": None}), ("# c\n", {}), ("a: [[X]]", {"a": [["X"]]}),
        ("a:\n  b: 1 # x\n  c:\n    - d: 2\n      e: 3\n    - f", {"a": {"b": "1", "c": [{"d": "2", "e": "3"}, "f"]}}),
        ("a: &x [1, 2]\nb: *x\nc: {k: v, 'q r': [1], z: }", {"a": ["1", "2"], "b": ["1", "2"], "c": {"k": "v", "q r": ["1"], "z": None}}),
        ("t: \"a \\\"q\\\" # not\"\nu: 'it''s'\nv: plain # yes\nw: http://x.y/z#a", {"t": 'a "q" # not', "u": "it's", "v": "plain", "w": "http://x.y/z#a"}),
        ("a: one\n  two\nb: >\n  x\n  y\n\n  z\nc: [1,\n  2]", {"a": "one two", "b": "x y\nz", "c": ["1", "2"]}),
        ("date: 2022-10-27T00:00:00.000Z\nk: a:b", {"date": "2022-10-27T00:00:00.000Z", "k": "a:b"}),
    ],
)
def test_front(front, want):
    assert parse_front(front) == want


@pytest.mark.parametrize("front", ["title: [open\nnothing here", "a: b: c", "a: 1\na: 2", "just text", "a: *x", "a: 'open", "a: !tag x", "\ta: 1", "a:\n - b\n   c: d: e"])
def test_broken_front(front):
    with pytest.raises((ValueError, IndexError)):
        parse_front(front)


def test_toml():
    assert parse_front('title = "x"\n[a]\nb = [1, true]\nd = 2020-01-02', "toml") == {"title": "x", "a": {"b": ["1", "true"], "d": "2020-01-02"}}


def test_ignored(spark):
    rules = ["build/", "a/private/*", "!keep.md", "*.t[a-m]p", "/root.md", "docs/**/draft.md", "", "# no"]
    paths = {"a/b.md": False, "build/x.md": True, "a/build/x.md": True, "a/private/k.md": True, "a/private/keep.md": False, "n/d.tmp": True, "n/d.tzp": False, "root.md": True, "a/root.md": False, "docs/x/y/draft.md": True, "docs/draft.md": True}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.gone for r in rows.select("path", vault.ignored(F.col("path"), rules).alias("gone")).collect()} == paths


def test_pipeline(spark):
    p = spark.createDataFrame([("a", None, "true"), ("b", "true", "true"), ("c", "false", "True"), ("d", "True", None)], "slug string, draft string, publish string")
    site = Pipeline([lambda d: d.withColumn("x", F.upper("slug"))], [remove_drafts, explicit_publish], {"all": lambda d: d.select("x")})
    assert [r.x for r in site.run(p)["all"].collect()] == ["A"] and site.dropped(p).count() == 3


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_markup(spark):
    v = F.lit(FILES["index.md"])
    assert [(w.embed, w.name, w.heading, w.alias) for w in one(spark, markup.wikilinks(v))] == [(False, "Note One", "", "first"), (True, "pic.png", "", "100x50")]
    assert one(spark, markup.inline_tags(F.lit("x #a/b #12 and #日本 no#tag #😀x"))) == ["a/b", "日本", "😀x"]
    assert [(h.depth, h.text) for h in one(spark, markup.markdown_headings(F.lit("# A\ntext\n## B b\n#no")))] == [(1, "A"), (2, "B b")]
    assert one(spark, markup.callout(F.lit("> [!FAQ|x]+ Title here"))).asDict() == {"kind": "question", "metadata": "x", "fold": "+", "title": "Title here"}
    assert one(spark, markup.callout(F.lit("> [!my-kind] T"))).kind == "my-kind"
    assert one(spark, markup.embed_size(F.lit("logo|100x50"))).asDict() == {"alt": "logo", "width": "100", "height": "50"}
    assert one(spark, markup.oxhugo(F.lit("$a\\_b$ c\\_d `$x\\_y$`"))) == "$a_b$ c\\_d `$x\\_y$`"
    assert one(spark, markup.roam(F.lit("^^x^^\n```\n^^y^^\n```"))) == "<mark>x</mark>\n```\n^^y^^\n```"
    assert one(spark, text.strip_comments(F.lit("a %%b\nc%% d"))) == "a  d"
    assert one(spark, markup.youtube_id(F.lit("https://youtu.be/abcdefghijk"))) == "abcdefghijk"


def test_sections(spark):
    lines = [(0, 1, "a"), (1, None, None), (2, 2, "b"), (3, None, None), (4, 2, "c"), (5, 1, "d")]
    df = spark.createDataFrame([("p", *x) for x in lines], "page string, pos int, depth int, slug string")
    assert {(r.slug, r.start, r.end) for r in markup.section(df, "page", df).collect()} == {("a", 0, 5), ("b", 2, 4), ("c", 4, 5), ("d", 5, 6)}


def test_refs(spark):
    t = F.lit("Article 6(1) and [[Article 15]] of Article 120")
    assert one(spark, refs.numbers(t)) == [6, 15, 120]
    assert one(spark, refs.split_compound(F.lit("6 and 7"))) == [6, 7]
    assert one(spark, refs.points(F.lit("**1.** One Article 6. Next\n\n2. Two"))) == ["One Article 6. Next", "Two"]
    assert one(spark, refs.points(F.lit("1. One Article 6. Next"), literal=True)) == ["One Article", "Next"]
    assert one(spark, refs.unlink_beyond(F.lit("[[Article 120]] [[Article 12]]"))) == "Article 120 [[Article 12]]"
    assert one(spark, refs.to_wikilinks(F.lit("Article 6(1)(f) holds"))) == "[[Article 6|Article 6(1)(f)]] holds"
    assert one(spark, refs.mentions(F.lit("see article  6."), F.lit(6))) and not one(spark, refs.mentions(F.lit("Article 61"), F.lit(6)))
    assert one(spark, refs.interpretation(F.lit("1. x\n2. On Article 9 here\n"), F.lit(9))) == "2. On Article 9 here"
    assert "Article 6" in one(spark, refs.context(F.lit("word " * 60 + "Article 6 " + "more " * 60), "Article 6"))
    assert one(spark, text.celex_ids(F.lit("CELEX:62019CJ0311 x CELEX:62020CJ0175"))) == ["62019CJ0311", "62020CJ0175"]
    assert one(spark, text.case_from_text(F.lit("In Case C‑311/18, x"))) == "C-311/18"


def test_text(spark):
    assert one(spark, text.excerpt(F.lit("a b c"), 150)) == "a b c"
    assert one(spark, text.excerpt(F.lit("x " * 100), 150)).endswith("...")
    assert one(spark, text.search_terms(F.lit("ab c def"))) == ["ab c def", "ab c", "def", "ab", "c"]
    names = [f"Article {k}" for k in (1, 2, 10, 20231231235959001, 20231231235959999, 10**40, 10**40 + 1)] + ["Article 0007x", "Article"]
    rows = spark.createDataFrame([(n,) for n in names[::-1]], "n string").orderBy(text.natural_key(F.col("n")), "n")
    assert [r.n for r in rows.collect()] == ["Article", "Article 1", "Article 2", "Article 0007x", *names[2:7]]
    assert one(spark, text.case_of_slug(F.lit("case-law/C-311-18"))) == "C-311/18" and one(spark, text.case_of_slug(F.lit("a/page"))) == "page"
    assert one(spark, text.title_from_file(F.lit("C-311-18.md"))) == "C-311/18"
    assert one(spark, text.highlighted(F.lit("Bother"), F.array(F.lit("the"), F.lit("bo")))) == 'Bo<span class="highlight">the</span>r'
    assert one(spark, text.unescape_html(text.escape_html(F.lit("<a & 'b'>")))) == "<a & 'b'>"
    assert one(spark, sinks.splice(F.lit("# T\n## Old\nx\n## Next\ny"), "## Old", F.lit("new"))) == "# T\n## Old\nnew\n## Next\ny"


def test_transclusion(spark):
    pages = spark.createDataFrame([("a", "whole", {"b": "block"}, {"part": "section"})], "slug string, text string, blocks map<string,string>, sections map<string,string>")
    embeds = spark.createDataFrame([("x", 0, "a", "b"), ("x", 1, "a", ""), ("x", 2, "gone", ""), ("x", 3, "a", "#part"), ("x", 4, "a", "#lost"), ("x", 5, "a", "^b")], "src string, pos int, target string, block string")
    assert {r.pos: r.content for r in relations.transclude(embeds, pages).collect()} == {0: "block", 1: "whole", 2: None, 3: "section", 4: None, 5: "block"}


def test_rules_or_first(spark):
    r = spark.createDataFrame([(1, "1. Article 6(1) holds.\n2. No more."), (2, "1. First.\n2. See Article 6."), (3, "1. Nothing.")], "id int, ruling string")
    wanted = spark.createDataFrame([(1, 6), (2, 6), (3, 6), (2, 7)], "id int, article int")
    found = relations.rules_or_first(r, "id", refs.points(F.col("ruling")), refs.numbers(F.col("rule"), r"Article (\d+)\("), wanted, refs.numbers(F.col("ruling"))).collect()
    assert {(x.id, x.article, x.rule) for x in found} == {(1, 6, "Article 6(1) holds."), (2, 6, "First.")}


def test_index_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("a", "A", ["b"], ["t"], "text"), ("b", "B", [], [], "")], "slug string, title string, links array<string>, tags array<string>, content string")
    index = sinks.content_index(p)
    sinks.index_lines(index).coalesce(1).write.text(str(tmp_path / "i"))
    assert [(r.slug, r.title, r.links) for r in vault.read_index(spark, str(tmp_path / "i")).collect()] == [("a", "A", ["b"])]
