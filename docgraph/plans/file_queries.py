"""Queries on files: the tables' rows are written as a vault to the shared folder first, then read as any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs, text
from ..operators.tables import shared_folder
from ..sources import sinks, vault
from ..streaming import incremental
from . import pipeline
from .tables import query, read

_S = lambda c: c.cast("string")


def _front(nation):
    """A note for each nation, with front matter."""
    k = F.col("n_nationkey")
    return nation.select(
        F.concat_ws("/", F.concat(F.lit("region"), _S(F.col("n_regionkey"))), F.concat(F.lit("nation"), _S(k))).alias("slug"),
        F.concat(F.lit("---\ntitle: "), "n_name", F.lit("\nkey: "), _S(k), F.lit("\n---\nAbout "), "n_name", F.lit(".")).alias("value"),
    )


def _vault(spark, sf) -> str:
    """A folder of notes: one folder a region and nation."""
    folder = f"{shared_folder(spark)}/vault"
    sinks.write_pages(_front(read(spark, sf, "nation")), folder)
    return folder


def _slug(path, uri: bool = False):
    """The slug that a written file's path, or its URI, holds."""
    found = F.url_decode(F.regexp_extract(path, "slug=([^/]*)/[^/]*$", 1))
    return F.url_decode(found) if uri else found


_NOTE = "'---' || chr(10) || 'title: ' || n_name || chr(10) || 'key: ' || n_nationkey || chr(10) || '---' || chr(10) || 'About ' || n_name || '.'"
_NAME = "'region' || n_regionkey || '/nation' || n_nationkey"


@query(f"SELECT {_NAME} AS slug, {_NOTE} AS value, true AS dated FROM nation WHERE n_regionkey <> 2 AND (n_nationkey NOT IN (1, 11) OR n_nationkey = 11 AND n_regionkey = 1)")
def file_glob(spark, sf):
    """Notes by pattern, without those that the rules of a .gitignore leave out, trimmed, with their times."""
    files = vault.read_files(spark, _vault(spark, sf), "*.txt").withColumn("slug", _slug(F.col("path")))
    rules = ["# left out", "region2/", "nation1", "nation?1", "!nation21", "!region1/nation11"]
    kept = files.filter(~vault.ignored(F.col("slug"), rules))
    return kept.select("slug", "value", F.col("modified").isNotNull().alias("dated"))


@query("SELECT 'a/b.md' AS path, false AS gone UNION ALL SELECT 'build/x.md', true UNION ALL SELECT 'a/build/x.md', true UNION ALL SELECT 'a/private/k.md', true UNION ALL SELECT 'a/private/keep.md', false UNION ALL SELECT 'notes/d1.tmp', true UNION ALL SELECT 'root.md', true UNION ALL SELECT 'a/root.md', false UNION ALL SELECT 'docs/x/y/draft.md', true")
def ignored_paths(spark, sf):
    """The rules of a .gitignore on paths of events."""
    paths = ["a/b.md", "build/x.md", "a/build/x.md", "a/private/k.md", "a/private/keep.md", "notes/d1.tmp", "root.md", "a/root.md", "docs/x/y/draft.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.select("path", vault.ignored(F.col("path"), ["build/", "a/private/*", "!keep.md", "*.t[a-m]p", "/root.md", "docs/**/draft.md"]).alias("gone"))


@query(f"SELECT {_NAME} AS slug, length({_NOTE})::BIGINT + 1 AS length FROM nation")
def asset_scan(spark, sf):
    """Files that are no pages, by name and length."""
    found = vault.read_assets(spark, _vault(spark, sf))
    return found.filter(F.contains("path", F.lit("slug="))).select(_slug(F.col("path")).alias("slug"), F.col("length").cast("long").alias("length"))


@query(f"SELECT {_NAME} AS slug, {_NOTE} || chr(10) AS value FROM nation")
def written_pages(spark, sf):
    """Pages written below their slugs, as they are read again."""
    folder = _vault(spark, sf)
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return files.select(_slug(F.col("_metadata.file_path"), True).alias("slug"), "value")


@query(f"SELECT {_NAME} AS path, '## ' || {_NAME} || chr(10) || 'title: ' || n_name || chr(10) || 'key: ' || n_nationkey AS entry FROM nation")
def front_dump(spark, sf):
    """The front matter of all files under their paths."""
    return sinks.front_dump(_front(read(spark, sf, "nation")).withColumnRenamed("slug", "path"))


@query(f"SELECT {_NAME} AS path, row_number() OVER (ORDER BY {_NAME}) AS place FROM nation")
def file_order(spark, sf):
    """Paths in the order of their code units."""
    from ..operators.relations import numbered

    rows = _front(read(spark, sf, "nation")).select(F.col("slug").alias("path"), F.lit(1).alias("all"))
    return numbered(rows, "all", [F.col("path")]).select("path", "place")


@query("SELECT doc_id, 'a: ' || lang || ' ' AS naive, 'a: ' || lang || ' --- b' || chr(10) || 'c: 1' AS whole, coalesce(text, '') AS body FROM documents")
def front_split(spark, sf):
    """Front matter that holds three hyphens: cut there, or at the fence that stands on a line of its own, with line ends of either kind."""
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\n")
    d = read(spark, sf, "documents")
    value = F.concat(F.lit("---"), end, F.lit("a: "), "lang", F.lit(" --- b\nc: 1"), end, F.lit("---"), end, F.coalesce("text", F.lit("")))
    rows = d.select("doc_id", value.alias("value"))
    front, body = vault.split_front(F.col("value"))
    naive = F.regexp_replace(vault.split_front_naive(F.col("value")), r"^\r?\n", "")
    return rows.select("doc_id", naive.alias("naive"), front.alias("whole"), body.alias("body"))


@query("SELECT page_id, len(string_split(html, chr(10)))::BIGINT AS lines, array_to_string(string_split(html, chr(10))[1:3], '|') AS head FROM pages")
def first_lines(spark, sf):
    """The first lines of each page, and how many there are within a hundred."""
    rows = read(spark, sf, "pages")
    return rows.select("page_id", F.size(vault.first_lines(F.col("html"))).cast("long").alias("lines"), F.array_join(vault.first_lines(F.col("html"), 3), "|").alias("head"))


@query("SELECT DISTINCT '6' || lpad((c_custkey % 100)::VARCHAR, 4, '0') || 'CJ0' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS celex FROM customer")
def link_list(spark, sf):
    """Identifiers of a text of links, line by line."""
    k = F.col("c_custkey")
    line = F.concat(F.lit("* https://x.example/?uri=CELEX:6"), F.lpad(_S(k % 100), 4, "0"), F.lit("CJ0"), F.lpad(_S(k % 1000), 3, "0"), F.lit("&from=en"))
    return read(spark, sf, "customer").select(F.explode(text.celex_ids(line)).alias("celex")).distinct()


@query("SELECT slug, title, array_to_string(links, '|') AS links, content FROM (SELECT 'p' || p_partkey AS slug, p_name AS title, [p_brand, p_type] AS links, p_name || chr(10) || '\"' || p_type AS content FROM part)")
def index_round_trip(spark, sf):
    """A content index as JSON lines, written and read again as pages."""
    k = _S(F.col("p_partkey"))
    pages = read(spark, sf, "part").select(F.concat(F.lit("p"), k).alias("slug"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("links"), F.array().cast("array<string>").alias("tags"), F.concat("p_name", F.lit('\n"'), "p_type").alias("content"))
    path = f"{shared_folder(spark)}/index"
    sinks.index_lines(sinks.content_index(pages)).write.text(path)
    return vault.read_index_lines(spark, path).select("slug", "title", F.array_join("links", "|").alias("links"), "content")


@query("SELECT o_custkey::BIGINT AS doc, (o_orderkey % 7)::INTEGER AS article, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def report_table(spark, sf):
    """A report of sections by article, read back as a table."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("doc"), (F.col("o_orderkey") % 7).alias("article"), "o_orderkey")
    sections = o.groupBy("doc", "article").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("- [[C-"), _S(F.col("o_orderkey")), F.lit("|case]]")))).alias("lines"))
    report = sections.groupBy("doc").agg(F.concat_ws("\n\n", F.collect_list(F.concat(F.lit("#### [[Article "), _S(F.col("article")), F.lit("]]\n"), "lines"))).alias("report"))
    rows = report.select("doc", F.explode(vault.report_sections(F.col("report"))).alias("s"))
    return rows.select("doc", "s.article", F.size("s.cases").cast("long").alias("n"))


@query("SELECT 'c' || c_custkey || CASE kind WHEN 1 THEN '.backup' ELSE '' END AS path, CASE kind WHEN 1 THEN c_mktsegment ELSE lower(c_mktsegment) END AS value FROM customer, (VALUES (0), (1)) t(kind) WHERE c_custkey % 7 = 0")
def rewrite_backup(spark, sf):
    """What a rewrite writes: changed files, and copies of what they were."""
    old = read(spark, sf, "customer").select(F.concat(F.lit("c"), _S(F.col("c_custkey"))).alias("path"), F.col("c_mktsegment").alias("value"), "c_custkey")
    new = old.withColumn("value", F.when(F.col("c_custkey") % 7 == 0, F.lower("value")).otherwise(F.col("value")))
    return sinks.rewrites(old, new, "path", "value")


@query("SELECT doc_id, '# T' || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## Cases' || chr(10) || 'list ' || doc_id || chr(10) || '## Next' || chr(10) || 'end' ELSE chr(10) || '## Cases' || chr(10) || 'list ' || doc_id END AS body FROM documents")
def spliced_section(spark, sf):
    """A made section in place of the old one, or at the end where there was none."""
    k = F.col("doc_id")
    body = F.concat(F.lit("# T\n"), F.coalesce("text", F.lit("")), F.when(k % 2 == 0, "\n## Cases\nold\nlines\n## Next\nend").otherwise(""))
    return read(spark, sf, "documents").select("doc_id", sinks.splice(body, "## Cases", F.concat(F.lit("list "), _S(k))).alias("body"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphaned_outputs(spark, sf):
    """Outputs of customers that no order asks for any more."""
    out = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return sinks.orphaned(out, read(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT 'C-' || c_custkey || '-22' AS file_name, CASE WHEN c_custkey % 4 = 0 THEN 'C-' || c_custkey || '-22' ELSE c_name END AS title, 'C-' || c_custkey || '/2' || CASE WHEN c_custkey % 3 = 0 THEN '3' ELSE '2' END AS case_number, CASE WHEN c_custkey % 2 = 0 THEN 'A: ' || c_custkey END AS parties, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'rights|' || lower(c_mktsegment) END, '') AS topics, c_custkey % 3 = 0 AS number_differs, (c_custkey % 99 + 1)::INTEGER AS article, 'lawful # ' || c_custkey AS interpretation, c_custkey % 2 = 0 AS complete FROM customer WHERE c_custkey % 5 <> 0")
def case_records(spark, sf):
    """Records of cases, by their front matter: nested maps, flow lists, comments; those without a number are left out; complete are those with title and parties."""
    k = F.col("c_custkey")
    front = F.concat(
        F.when(k % 4 != 0, F.concat(F.lit("title: "), "c_name", F.lit(" # named\n"))).otherwise(""), F.when(k % 5 != 0, F.concat(F.lit("case-number: [[C-"), _S(k), F.lit("/2"), F.when(k % 3 == 0, "3").otherwise("2"), F.lit("]]\n"))).otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit("parties: \"A: "), _S(k), F.lit("\"\ntopics: [rights, '"), F.lower("c_mktsegment"), F.lit("']\n"))).otherwise(""), F.lit("court:\n  name: CJ\n  rooms: [1, 2]\nper-article:\n  - \"Article "), _S(k % 99 + 1), F.lit(" | lawful # "), _S(k), F.lit('"\n'),
    )
    files = read(spark, sf, "customer").select(F.concat(F.lit("cases/C-"), _S(k), F.lit("-22.md")).alias("path"), F.concat(F.lit("---\n"), front, F.lit("---\nBody")).alias("value"), F.lit(None).cast("timestamp").alias("modified"))
    c = vault.cases(files)
    complete = text.truthy(F.col("title")).isNotNull() & F.col("parties").isNotNull()
    entry = F.element_at("per_article", 1)
    return c.select("file_name", "title", "case_number", "parties", F.array_join(F.coalesce("topics", F.array().cast("array<string>")), "|").alias("topics"), "number_differs", entry["article"].alias("article"), entry["text"].alias("interpretation"), complete.alias("complete"))


@query("SELECT c_custkey AS id, c_name AS title, 'tag' || c_custkey % 3 AS tags, CASE WHEN c_custkey % 2 = 0 THEN '{\"a\": [\"1\", \"x\"]}' ELSE '{\"k\": \"' || c_custkey || '\"}' END AS extra, c_custkey % 7 = 0 AS bad FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'c' || c_custkey, '', NULL, true FROM customer WHERE c_custkey % 7 = 0")
def front_formats(spark, sf):
    """Front matter in YAML with flow maps, anchors and comments, in TOML, and broken."""
    k = F.col("c_custkey")
    yaml = F.concat(F.lit("---\ntitle: &t "), "c_name", F.lit("\ntags: [tag"), _S(k % 3), F.lit("] # one\nagain: *t\nextra: {k: '"), _S(k), F.lit("'}\n---\n"))
    toml = F.concat(F.lit('+++\ntitle = "'), "c_name", F.lit('"\ntags = ["tag'), _S(k % 3), F.lit('"]\n[extra]\na = [1, "x"]\n+++\n'))
    value = F.when(k % 7 == 0, "---\ntitle: [open\n---\n").when(k % 2 == 0, toml).otherwise(yaml)
    p = vault.pages(read(spark, sf, "customer").select(F.concat(F.lit("c"), _S(k), F.lit(".md")).alias("path"), value.alias("value"), F.lit(None).cast("timestamp").alias("modified")))
    return p.select(F.substr("slug", F.lit(2)).cast("long").alias("id"), "title", F.array_join("tags", ",").alias("tags"), F.try_element_at("extra", F.lit("extra")).alias("extra"), F.col("error").isNotNull().alias("bad"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'n/own-name' ELSE 'n/sub/index' END AS first, 'rooted' AS second, 'x,y' AS classes FROM customer")
def alias_slugs(spark, sf):
    """Aliases as slugs: the first of the keys that may name them, lists or text with commas, a link of its own, folders."""
    k = F.col("c_custkey")
    front = F.concat(F.when(k % 2 == 0, "aliases:\n  - own name\n").otherwise("alias: sub/\n"), F.lit("permalink: /rooted\ncssclass: x, y\n"))
    files = read(spark, sf, "customer").select(F.concat(F.lit("n/c"), _S(k), F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), front, F.lit("---\n")).alias("value"), F.lit(None).cast("timestamp").alias("modified"))
    p = vault.pages(files)
    return p.select(F.regexp_extract("slug", r"(\d+)$", 1).cast("long").alias("id"), F.element_at("aliases", 1).alias("first"), F.element_at("aliases", 2).alias("second"), F.array_join("cssclasses", ",").alias("classes"))


@query("SELECT 'all' AS emitter, doc_id, upper(lang) AS title FROM documents WHERE NOT contains(coalesce(source, ''), '1') AND n_chars > 100 UNION ALL SELECT 'long', doc_id, upper(lang) FROM documents WHERE NOT contains(coalesce(source, ''), '1') AND n_chars > 2000")
def site_pipeline(spark, sf):
    """Transformers, filters of a user and emitters, put together by configuration."""
    site = pipeline.Pipeline(
        transformers=[lambda d: d.withColumn("title", F.upper("lang"))],
        filters=[lambda d: ~F.contains(F.coalesce("source", F.lit("")), F.lit("1")), lambda d: F.col("n_chars") > 100],
        emitters={"all": lambda d: d, "long": lambda d: d.filter("n_chars > 2000")},
    )
    out = [rows.select(F.lit(name).alias("emitter"), "doc_id", "title") for name, rows in site.run(read(spark, sf, "documents")).items()]
    return out[0].unionByName(out[1])


@query("SELECT l.doc_id, n.n AS of_lang FROM documents l JOIN (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang) n ON n.lang = l.lang")
def page_component(spark, sf):
    """A component sees its page and all pages: each document with how many share its language."""
    all_files = read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("of_lang"))
    return pipeline.rendered(read(spark, sf, "documents"), all_files, "lang", ["doc_id", "of_lang"])


@query(f"SELECT {_NAME} AS slug, n_name AS title FROM nation")
def watched_files(spark, sf):
    """A stream of whole files as a folder gets them, parsed."""
    root = shared_folder(spark)
    files = incremental.watch_folder(spark, _vault(spark, sf), "*.txt")
    q = files.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(_slug(F.col("path"), True).alias("slug"), F.regexp_extract("value", r"title: (.*)", 1).alias("title"))


_CHANGES = "x AS (SELECT 'c' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '.png' ELSE '.md' END AS path, c_custkey AS k FROM customer)"


def _listings(spark, sf):
    """A folder before and after: some files are new, some are newer, some are gone."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("c"), _S(k), F.when(k % 4 == 0, ".png").otherwise(".md"))
    rows = read(spark, sf, "customer").select(path.alias("path"), k.alias("k"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified"))
    now = rows.filter("k % 5 <> 1").withColumn("modified", F.when(F.col("k") % 3 == 0, F.lit("2024-01-02 00:00:00").cast("timestamp")).otherwise(F.col("modified")))
    return rows.filter("k % 5 <> 0"), now


@query(f"WITH {_CHANGES} SELECT path, CASE WHEN k % 5 = 0 THEN 'add' WHEN k % 5 = 1 THEN 'delete' ELSE 'change' END AS change, k % 4 <> 0 AS page FROM x WHERE k % 5 IN (0, 1) OR k % 3 = 0")
def folder_changes(spark, sf):
    """Additions, changes and deletions between two listings; files that are no pages are only kept track of."""
    before, now = _listings(spark, sf)
    events = incremental.listing_events(before, now, "2024-01-03 00:00:00")
    mine, others = incremental.tracked(events)
    return mine.select("path", "change", F.lit(True).alias("page")).unionByName(others.select("path", "change", F.lit(False).alias("page")))


@query(f"WITH {_CHANGES} SELECT path, CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 'new ' ELSE 'old ' END || k AS content FROM x WHERE k % 5 <> 1")
def full_rebuild(spark, sf):
    """The pages after a rebuild: only what changed is parsed again, the rest stays, what is gone goes."""
    before, now = _listings(spark, sf)
    events = incremental.listing_events(before.select("path", "modified"), now.select("path", "modified"), "2024-01-03 00:00:00")
    old = before.select("path", F.concat(F.lit("old "), _S(F.col("k"))).alias("content"))
    return incremental.rebuilt(old, events, now.select("path", F.concat(F.lit("new "), _S(F.col("k"))).alias("content")))


@query("SELECT doc_id, contains(b, 'GDPR') AS relevant, CASE WHEN doc_id % 2 = 0 THEN 'Article 5' END AS context, CASE WHEN doc_id % 2 = 0 THEN '2. On Article 5 of GDPR here' ELSE 'No specific interpretation found' END AS interpretation FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN 'GDPR' ELSE '' END AS b FROM documents)")
def relevant_interpretations(spark, sf):
    """Texts that speak of the regulation, the words around an article's name, and the numbered paragraph that names it."""
    k = F.col("doc_id")
    body = F.concat(F.coalesce("text", F.lit("")), F.when(k % 2 == 0, "\n1. x\n2. On Article 5 of GDPR here\n").otherwise("\n1. x"))
    rows = read(spark, sf, "documents").select("doc_id", body.alias("body"))
    body = F.col("body")
    context = refs.context(body, "Article 5")
    return rows.select("doc_id", refs.is_relevant(body).alias("relevant"), F.when(F.contains(context, F.lit("Article 5")) & context.startswith("...") & (F.length(context) <= 220), "Article 5").alias("context"), refs.interpretation(body, F.lit(5)).alias("interpretation"))


@query("SELECT 'p' || o_custkey AS path, max(o_orderdate)::DATE AS day FROM orders GROUP BY o_custkey")
def git_dates(spark, sf):
    """The last commit of each file, from a log; a commit for each order, in files of many."""
    o = read(spark, sf, "orders")
    entry = F.concat(F.lit("commit "), _S(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))), F.lit("\n\np"), _S(F.col("o_custkey")), F.lit("\n"))
    logs = o.groupBy(F.pmod("o_orderkey", F.lit(50))).agg(F.concat_ws("", F.collect_list(entry)).alias("value"))
    return vault.git_dates(logs).select("path", F.to_date("at").alias("day"))


@query("SELECT 'read' AS step, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'filter 0', count(*) FROM documents WHERE n_chars > 100 UNION ALL SELECT 'filter 1', count(*) FROM documents WHERE n_chars > 100 AND lang = 'en'")
def step_counts(spark, sf):
    """How many rows pass each step of a pipeline, observed while its result is written."""
    site = pipeline.Pipeline(filters=[lambda d: F.col("n_chars") > 100, lambda d: F.col("lang") == "en"])
    out, seen = site.counted(read(spark, sf, "documents"))
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(step, o.get["n"]) for step, o in seen.items()], "step string, n long")  # a row a step


@query("WITH e AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 86400 THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM e) SELECT user_id, count(*)::BIGINT AS asked, arg_max(event_id, (ts, event_id)) AS event_id FROM g GROUP BY user_id, turn")
def debounced_builds(spark, sf):
    """Requests that follow one another within a day ask for one build."""
    return incremental.debounced(read(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "1 day", "ts", "event_id").select("user_id", "asked", "event_id")
