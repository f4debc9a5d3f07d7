"""Queries on filters, lists, feeds, dates, text and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relations
from ..operators.tables import shared_folder
from ..sources import sinks
from ..streaming import incremental
from . import pipeline
from .tables import LINKS, PAGES, links, pages, query, read

#: Flags that documents lack come from their labels: toxic ones are drafts, good ones are published.
_FLAGS = "fl AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'true' WHEN toxic = 0 THEN 'false' END AS draft, CASE WHEN quality = 1 THEN 'true' WHEN quality = 0 THEN 'True' END AS publish FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _flags(spark, sf):
    toxic, good = F.col("toxic"), F.col("quality")
    rows = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(toxic == 1, "true").when(toxic == 0, "false").alias("draft"), F.when(good == 1, "true").when(good == 0, "True").alias("publish"))


@query(f"WITH {_FLAGS} SELECT doc_id FROM fl WHERE draft IS DISTINCT FROM 'true'")
def draft_filter(spark, sf):
    return pipeline.Pipeline(filters=[pipeline.remove_drafts]).kept(_flags(spark, sf)).select("doc_id")


@query(f"WITH {_FLAGS} SELECT doc_id FROM fl WHERE publish = 'true'")
def explicit_publish(spark, sf):
    return pipeline.Pipeline(filters=[pipeline.explicit_publish]).kept(_flags(spark, sf)).select("doc_id")


@query(f"WITH {_FLAGS} SELECT doc_id FROM fl WHERE NOT (draft IS DISTINCT FROM 'true' AND coalesce(publish = 'true', false))")
def dropped_rows(spark, sf):
    return pipeline.Pipeline(filters=[pipeline.remove_drafts, pipeline.explicit_publish]).dropped(_flags(spark, sf)).select("doc_id")


@query(f"WITH {_FLAGS} SELECT count(*)::BIGINT AS n_in, count(*) FILTER (draft IS DISTINCT FROM 'true')::BIGINT AS n_out FROM fl")
def filter_counts(spark, sf):
    kept = ~text.is_true(F.col("draft"))
    return _flags(spark, sf).agg(F.count("*").alias("n_in"), F.count_if(kept).alias("n_out"))


_PLAIN = r"trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH {PAGES} SELECT page_id, slug, title, (SELECT array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), '|')) AS links, {_PLAIN} AS content FROM pg WHERE {_PLAIN} <> ''""")
def content_index(spark, sf):
    from ..functions.markup import hrefs

    rows = pages(spark, sf, "page_id", "html").withColumns({"links": F.array_sort(F.array_distinct(hrefs(F.col("html")))), "tags": F.array().cast("array<string>"), "content": text.strip_tags(F.col("html"))})
    return rows.filter("content <> ''").select("page_id", "slug", "title", F.array_join("links", "|").alias("links"), "content")


_ORDERS = "op AS (SELECT o_orderkey AS id, 'order-' || o_orderkey AS slug, o_orderpriority AS title, o_orderdate AS date FROM orders)"


def _dated(spark, sf):
    """Orders as dated pages: the pages themselves have no dates."""
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("slug"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("date"))


@query(f"WITH {_ORDERS} SELECT slug, '<url><loc>https://example.com/' || slug || '</loc><lastmod>' || strftime(date, '%Y-%m-%d') || '</lastmod></url>' AS entry FROM op")
def sitemap_rows(spark, sf):
    return sinks.sitemap_rows(_dated(spark, sf), "example.com")


@query(f"WITH {_ORDERS} SELECT row_number() OVER (ORDER BY date DESC, lower(title), slug) AS place, slug, '<item><title>' || title || '</title><link>https://example.com/' || slug || '</link><pubDate>' || strftime(date, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate></item>' AS item FROM (SELECT * FROM op ORDER BY date DESC, lower(title), slug LIMIT 10)")
def rss_topk(spark, sf):
    return sinks.rss_items(_dated(spark, sf), "example.com", 10)


@query(f"WITH {_ORDERS} SELECT id, slug, title FROM op ORDER BY date DESC, lower(title), slug LIMIT 3")
def recent_notes(spark, sf):
    return _dated(spark, sf).orderBy(*relations.by_date_and_title()).limit(3).select("id", "slug", "title")


@query(f"WITH {_ORDERS} SELECT greatest(0, count(*) - 3)::BIGINT AS remaining FROM op")
def recent_remaining(spark, sf):
    return _dated(spark, sf).agg(F.greatest(F.lit(0).cast("long"), F.count("*") - 3).alias("remaining"))


@query(f"WITH {_ORDERS} SELECT title, id, place FROM (SELECT title, id, row_number() OVER (PARTITION BY title ORDER BY CASE WHEN id % 10 = 0 THEN NULL ELSE date END DESC NULLS LAST, lower(title), slug) AS place FROM op) WHERE place <= 20")
def list_sort(spark, sf):
    """The list order within each title; every tenth row has no date and goes last."""
    rows = _dated(spark, sf).withColumn("date", F.when(F.col("id") % 10 != 0, F.col("date")))
    return relations.first_in_group(rows, "title", relations.by_date_and_title(), 20).select("title", "id", "place")


_SENT = r"list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s))"


@query(rf"""WITH s AS (SELECT doc_id, {_SENT} AS ss FROM documents), f AS (SELECT doc_id, CASE WHEN length(ss[1]) >= 150 THEN string_split(ss[1], ' ') ELSE ss END AS parts, length(ss[1]) >= 150 AS long FROM s),
u AS (SELECT doc_id, long, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM f), w AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(CASE WHEN part = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM u)
SELECT doc_id, coalesce(string_agg(part, ' ' ORDER BY i) FILTER (before < 150 AND ended = 0), '') || CASE WHEN long THEN '...' ELSE '' END AS excerpt FROM w GROUP BY doc_id, long""")
def description_excerpt(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), 150).alias("excerpt"))


@query(r"SELECT doc_id, n AS words, ceil(n / 200.0)::BIGINT AS minutes FROM (SELECT doc_id, (CASE WHEN regexp_matches(text, '\S') THEN len(string_split_regex(trim(text, chr(32)), '\s+')) ELSE 0 END)::BIGINT AS n FROM documents)")
def reading_time(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.reading_minutes(F.col("text")).alias("minutes"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM pages")
def escape_html(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', '''') AS plain FROM pages")
def unescape_html(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.unescape_html(F.col("html")).alias("plain"))


@query(r"SELECT page_id, regexp_replace('see ' || url || ' now', 'https?://(?:www\.)?([\w.\-]+)(/[^\s]*)?', '\1\2', 'g') AS short FROM pages")
def url_shorten(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.shorten_urls(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("short"))


@query("SELECT doc_id, upper(text[1]) || text[2:] AS capital FROM documents")
def capitalize(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.capitalize(F.col("text")).alias("capital"))


@query("SELECT strftime(o_orderdate, '%B %Y') AS label, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, count(*)::BIGINT AS n, min(strftime(o_orderdate, '%B %-d, %Y')) AS first_day FROM orders GROUP BY ALL")
def timeline_by_month(spark, sf):
    """Groups by month."""
    day = F.col("o_orderdate")
    rows = read(spark, sf, "orders").groupBy(text.month_label(day).alias("label"), F.year(day).cast("long").alias("y"), F.month(day).cast("long").alias("m"))
    return rows.agg(F.count("*").alias("n"), F.min(text.long_date(day)).alias("first_day"))


@query("SELECT label, place, o_orderkey, day FROM (SELECT strftime(o_orderdate, '%B %Y') AS label, o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS day, row_number() OVER (PARTITION BY strftime(o_orderdate, '%B %Y') ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 10")
def timeline_cases(spark, sf):
    """Each month's ten newest cases."""
    day = F.col("o_orderdate")
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", text.month_label(day).alias("label"), text.long_date(day).alias("day"))
    return relations.first_in_group(rows, "label", [day.desc(), F.col("o_orderkey")], 10).select("label", "place", "o_orderkey", "day")


@query("SELECT y, m, n, row_number() OVER (ORDER BY y DESC, m DESC) AS place FROM (SELECT year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, count(*)::BIGINT AS n FROM orders GROUP BY ALL)")
def month_groups_desc(spark, sf):
    from pyspark.sql import Window

    day = F.col("o_orderdate")
    rows = read(spark, sf, "orders").groupBy(F.year(day).cast("long").alias("y"), F.month(day).cast("long").alias("m")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("y"), F.desc("m"))).cast("long"))  # of months


@query("SELECT event_id, strftime(ts, '%b %d, %Y') AS short, strftime(ts, '%B %-d, %Y') AS long, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS rss FROM events")
def date_formats(spark, sf):
    ts = F.col("ts")
    return read(spark, sf, "events").select("event_id", text.short_date(ts).alias("short"), text.long_date(ts).alias("long"), text.rss_date(ts).alias("rss"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z' WHEN 2 THEN 'soon' ELSE NULL END AS written, CASE WHEN event_id % 4 < 2 THEN strftime(ts, '%Y-%m-%d') END AS day, event_id % 4 = 2 AS date_invalid FROM events")
def date_parse(spark, sf):
    day, n = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id") % 4
    written = F.when(n == 0, day).when(n == 1, F.concat(day, F.lit("T00:00:00.000Z"))).when(n == 2, "soon")
    rows = read(spark, sf, "events").select("event_id", written.alias("written"))
    parsed = text.parse_date(F.col("written"))
    return rows.select("event_id", "written", F.date_format(parsed, "yyyy-MM-dd").alias("day"), (F.col("written").isNotNull() & parsed.isNull()).alias("date_invalid"))


@query("SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY ROLLUP (lang, source)")
def topic_rollup(spark, sf):
    return relations.rollup_counts(read(spark, sf, "documents"), "lang", "source")


@query("SELECT 'Languages' AS category, t.topic, d.doc_id FROM documents d JOIN (VALUES ('en', 'English'), ('de', 'German')) t(lang, topic) ON t.lang = d.lang")
def topic_members(spark, sf):
    dim = spark.createDataFrame([("Languages", "en", "English"), ("Languages", "de", "German")], "category string, lang string, topic string")
    return read(spark, sf, "documents").join(F.broadcast(dim), "lang").select("category", "topic", "doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_skip_existing(spark, sf):
    return read(spark, sf, "customer").select("c_custkey").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_paired(spark, sf):
    return read(spark, sf, "customer").select("c_custkey").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c.c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END, true) AS collapsed FROM customer c")
def saved_state(spark, sf):
    """Every third row has a saved state; others keep the default."""
    from ..sources.vault import state_or_default

    rows = read(spark, sf, "customer").select("c_custkey", F.lit(True).alias("collapsed"))
    saved = rows.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("collapsed"))
    return state_or_default(rows, saved, "c_custkey", "collapsed").select("c_custkey", "collapsed")


_EV = "ev AS (SELECT event_id, user_id, ts, value, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' ELSE 'change' END AS change FROM events)"
_LAST = f"{_EV}, la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ev) WHERE r = 1)"


def _events(spark, sf):
    """Events as file events: users are files, errors delete them."""
    change = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add").otherwise("change")
    return read(spark, sf, "events").select("event_id", "user_id", "ts", "value", change.alias("change"))


@query(f"WITH {_LAST} SELECT user_id, event_id, change FROM la")
def latest_event_per_key(spark, sf):
    return incremental.latest(_events(spark, sf), "user_id", "ts", "event_id").select("user_id", "event_id", "change")


@query(f"WITH {_LAST} SELECT user_id, value FROM la WHERE change <> 'delete' UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM la)")
def snapshot_merge(spark, sf):
    before = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return incremental.merge_snapshot(before, _events(spark, sf), "user_id", "ts", "event_id")


@query(f"WITH {_LAST} SELECT user_id, change <> 'delete' AS build FROM la")
def rebuild_set(spark, sf):
    build, remove = incremental.pending(_events(spark, sf), "user_id", "ts", "event_id")
    return build.withColumn("build", F.lit(True)).unionByName(remove.withColumn("build", F.lit(False)))


def _streamed(spark, sf, rows, emit=None):
    """What a stream over ``rows``, in four files that hold events of all times, leaves: each file is a micro-batch."""
    root = shared_folder(spark)
    rows.repartition(4, "event_id").write.parquet(f"{root}/events")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    q = incremental.run_incremental(stream, f"{root}/state", f"{root}/checkpoint", "user_id", ["user_id", "value"], ("ts", "event_id"), emit)
    q.awaitTermination()
    return incremental.live(spark, f"{root}/state", rows.select("user_id", "value", "ts", "event_id").schema, ["user_id", "value"])


@query(f"WITH {_LAST} SELECT user_id, value FROM la WHERE change <> 'delete'")
def stream_incremental(spark, sf):
    """The same snapshot, kept by a stream over the events in micro-batches that come in no order."""
    return _streamed(spark, sf, _events(spark, sf))


@query("SELECT user_id, value FROM events WHERE false")
def stream_without_events(spark, sf):
    """A stream that never has a batch leaves an empty state."""
    return _streamed(spark, sf, _events(spark, sf).filter(F.lit(False)))


@query(f"WITH {LINKS} SELECT src, dst FROM lk WHERE src <> dst AND length(dst) > 6 UNION SELECT dst, src FROM lk WHERE length(dst) = 3")
def edge_union(spark, sf):
    """Union of two edge sets without repeats."""
    from ..operators.graph import merge

    e = links(spark, sf)
    return merge(e.filter("src <> dst and length(dst) > 6"), e.filter("length(dst) = 3").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("SELECT p_brand, part, string_agg(p_type, ', ' ORDER BY p_type) AS items, count(*)::BIGINT AS n FROM (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1) // 5 AS part FROM (SELECT DISTINCT p_brand, p_type FROM part)) GROUP BY ALL")
def grouped_report(spark, sf):
    """Lines of five items at most."""
    return sinks.grouped_lines(read(spark, sf, "part"), "p_brand", "p_type", 5)


@query("SELECT c_custkey AS id, c_mktsegment AS before, lower(c_mktsegment) AS after FROM customer WHERE c_custkey % 7 = 0")
def rewrite_log(spark, sf):
    """A copy-on-write rewrite of every seventh row, and its change log."""
    old = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    new = old.withColumn("v", F.when(F.col("id") % 7 == 0, F.lower("v")).otherwise(F.col("v")))
    return sinks.changed_rows(old, new, "id", "v")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'folder' WHEN s_suppkey % 2 = 0 THEN 'page' ELSE 'index' END AS writer FROM supplier")
def sink_collisions(spark, sf):
    """Three emitters write to overlapping places; the last one wins."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    out = s.withColumns({"writer": F.lit("index"), "prio": F.lit(0)}).unionByName(s.filter("id % 2 = 0").withColumns({"writer": F.lit("page"), "prio": F.lit(1)})).unionByName(s.filter("id % 3 = 0").withColumns({"writer": F.lit("folder"), "prio": F.lit(2)}))
    return sinks.last_writer_wins(out, "id", "prio").select("id", "writer")


@query("SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'processed' WHEN o_orderstatus = 'O' THEN 'skipped' ELSE 'failed' END AS status FROM orders) GROUP BY status")
def status_summary(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return read(spark, sf, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS total, count(DISTINCT o_custkey)::BIGINT AS different FROM orders")
def total_and_distinct(spark, sf):
    return read(spark, sf, "orders").agg(F.count("*").alias("total"), F.countDistinct("o_custkey").alias("different"))


@query("SELECT DISTINCT p_name AS line FROM part WHERE NOT contains(p_name, 'bolt')")
def distinct_lines(spark, sf):
    return read(spark, sf, "part").select(F.col("p_name").alias("line")).filter(~F.contains("line", F.lit("bolt"))).distinct()


@query(f"WITH {PAGES} SELECT page_id, CASE WHEN title = '' THEN 'A page' ELSE title END AS description FROM pg")
def head_metadata(spark, sf):
    return pages(spark, sf, "page_id").select("page_id", F.coalesce(text.truthy(F.col("title")), F.lit("A page")).alias("description"))


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages")
def cname_host(spark, sf):
    """Hosts of base addresses, which are written without a scheme."""
    base = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, sf, "pages").select(sinks.host(base).alias("host")).distinct()


@query("SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY o_orderkey)[1:3], '|') AS topics FROM orders GROUP BY o_custkey")
def first_topics(spark, sf):
    """The first three topics of each record."""
    first = relations.first_in_group(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", [F.col("o_orderkey")], 3)
    rows = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("t"))
    return rows.select("o_custkey", F.array_join(F.transform("t", lambda x: x["o_orderpriority"]), "|").alias("topics"))


@query("SELECT c_custkey, c_name, p AS priority FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def case_info_join(spark, sf):
    """Records with their info, of which the last of a key wins."""
    info = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    return read(spark, sf, "customer").join(info, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "priority")


@query(f"WITH {PAGES} SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'target/' || page_id // 3 END, slug) AS final FROM pg")
def canonical_redirect(spark, sf):
    """Redirecting pages (every third is made one) lead one hop on, others to themselves."""
    from ..functions.paths import canonical

    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<link rel="canonical" href="target/'), (F.col("page_id") / 3).cast("long").cast("string"), F.lit('">'))).otherwise(F.col("html"))
    return pages(spark, sf, "page_id", "html").select("page_id", F.coalesce(canonical(html), "slug").alias("final"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS place, o_orderpriority FROM orders")
def explorer_by_date(spark, sf):
    """Folders of cases list by date, newest first; other folders by natural order of names."""
    name = F.col("o_orderkey").cast("string")
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", text.natural_key(name).alias("key"))
    order = [F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")).desc_nulls_last(), F.col("key")]
    return relations.numbered(rows, "o_orderpriority", order).select("o_orderkey", "place", "o_orderpriority")


_DEPTH = "len(list_filter(string_split(src, '/'), lambda s: s <> '')) - 1"
_ROOTED = f"CASE WHEN {_DEPTH} <= 0 THEN '.' ELSE array_to_string(list_transform(range({_DEPTH}), lambda i: '..'), '/') END"


@query(f"WITH {LINKS} SELECT src, dst, CASE WHEN length(dst) % 2 = 0 THEN {_ROOTED} || '/x/../img/' || dst WHEN starts_with(dst, './') OR starts_with(dst, '../') THEN {_ROOTED} || '/x/../' || dst ELSE dst END AS url FROM lk")
def rebased_urls(spark, sf):
    """URLs relative to a page at the root, rewritten for the pages that quote it."""
    from ..functions.paths import rebase

    url = F.when(F.length("dst") % 2 == 0, F.concat(F.lit("./img/"), "dst")).otherwise(F.col("dst"))
    made = rebase(url, F.col("src"), F.lit("x"))
    return links(spark, sf).select("src", "dst", F.regexp_replace(made, r"/\./", "/").alias("url"))


@query("SELECT c_custkey AS id, 'C-' || c_custkey || '.html' AS destination FROM customer WHERE c_custkey % 2 = 0")
def rename_manifest(spark, sf):
    """Files to copy under the case number that their text names; those that name none are left out."""
    k = F.col("c_custkey").cast("string")
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x In Case C‑"), k, F.lit("/22, y"))).otherwise("nothing")
    number = F.regexp_replace(text.case_from_text(body), "/22$", "")
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), number.alias("n")).filter("n <> ''").select("id", F.concat("n", F.lit(".html")).alias("destination"))


@query("SELECT doc_id, slug, 'src1' AS topic FROM (SELECT doc_id, source || '-' || doc_id AS slug FROM documents) WHERE contains(slug, 'src1')")
def topic_by_slug(spark, sf):
    """Pages whose slug holds a topic's word: a short literal list, so a test each instead of a join."""
    slug = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return read(spark, sf, "documents").select("doc_id", slug.alias("slug"), F.lit("src1").alias("topic")).filter(F.contains("slug", F.col("topic")))
