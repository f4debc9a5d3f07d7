"""Queries on full-text search and on references in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs, text
from ..operators import relations, search
from ..operators.tables import shared_folder
from .tables import query, read

_TERMS = ["th", "re"]
_TOK = r"tk AS (SELECT id, field, t AS token, pos FROM (SELECT id, field, unnest(list_filter(string_split_regex(lower(body), '[^\p{L}]+'), lambda x: x <> '')) AS t, unnest(range(len(list_filter(string_split_regex(lower(body), '[^\p{L}]+'), lambda x: x <> '')))) AS pos FROM (SELECT conv_id * 100 + turn AS id, 'content' AS field, text AS body FROM conversations UNION ALL SELECT conv_id * 100 + turn, 'title', role || ' ' || split_part(text, ' ', 1) FROM conversations)))"
_HITS = f"{_TOK}, ht AS (SELECT field, id, count(*) FILTER (starts_with(token, 'th') OR starts_with(token, 're'))::BIGINT AS hits, min(pos) FILTER (starts_with(token, 'th') OR starts_with(token, 're'))::BIGINT AS first FROM tk GROUP BY field, id HAVING bool_or(starts_with(token, 'th')) AND bool_or(starts_with(token, 're')))"
_RANK = f"{_HITS}, rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY hits DESC, first, id) AS rank FROM ht) WHERE rank <= 8)"


def _postings(spark, sf):
    """Turns as documents: role and first word as title, text as content."""
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text")
    title = F.concat_ws(" ", "role", F.split_part("text", F.lit(" "), F.lit(1)))
    return search.index(c, "id", {"title": text.search_tokens(title), "content": text.search_tokens(F.col("text"))})


def _stored(spark, sf, table: str = "conversations"):
    """The stored index of a session's table: written at its first use."""
    sc = spark.sparkContext
    known = sc._docgraph_indexes = getattr(sc, "_docgraph_indexes", {})
    if (sf, table) not in known:
        known[sf, table] = f"{shared_folder(spark)}/index"
        own = _postings(spark, sf) if table == "conversations" else search.index(read(spark, sf, table), "doc_id", {"content": text.search_tokens(F.col("text"))})
        search.store(own, known[sf, table])
    return search.read_index(spark, known[sf, table])


@query(f"WITH {_TOK} SELECT field, count(DISTINCT token)::BIGINT AS tokens, count(*)::BIGINT AS n FROM tk GROUP BY field")
def search_index(spark, sf):
    """What the stored index holds."""
    return _stored(spark, sf).groupBy("field").agg(F.countDistinct("token").alias("tokens"), F.sum("hits").alias("n"))


@query(f"WITH {_RANK} SELECT field, id, hits, first, rank FROM rk")
def search_basic(spark, sf):
    """Documents in whose fields every term begins a word, the best eight of each field, from the stored index."""
    return search.ranked(search.query(_stored(spark, sf), _TERMS)).select("field", "id", "hits", "first", "rank")


@query(f"WITH {_RANK} SELECT rk.field, rk.rank, c.conv_id, c.turn, c.role, c.text FROM rk JOIN conversations c ON c.conv_id * 100 + c.turn = rk.id")
def search_records(spark, sf):
    """Results with their records."""
    found = search.ranked(search.query(_stored(spark, sf), _TERMS)).select("field", "rank", "id")
    docs = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), "conv_id", "turn", "role", "text")
    return search.records(found, docs, "key").select("field", "rank", "conv_id", "turn", "role", "text")


@query(f"WITH {_RANK}, x AS (SELECT id, CASE field WHEN 'title' THEN 1 ELSE 2 END::BIGINT AS prio, rank FROM rk) SELECT id, prio, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, rank) AS r FROM x) WHERE r = 1")
def search_merge(spark, sf):
    return search.merged(search.ranked(search.query(_stored(spark, sf), _TERMS)))


@query(rf"WITH tk AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '')) AS token, unnest(range(len(list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '')))) AS pos FROM documents WHERE source = 'src3'), ht AS (SELECT id, count(*)::BIGINT AS hits, min(pos)::BIGINT AS first FROM tk WHERE starts_with(token, 'th') GROUP BY id) SELECT id, hits, first, row_number() OVER (ORDER BY hits DESC, first, id) AS rank FROM ht QUALIFY rank <= 8")
def search_tag_scoped(spark, sf):
    """A query within one tag, on the stored index: the tag's documents are told before the limit."""
    tagged = read(spark, sf, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("id"))
    hits = search.query(_stored(spark, sf, "documents"), ["th"]).join(tagged, "id", "left_semi")
    return search.ranked(hits).select("id", "hits", "first", "rank")


_WIN = r"""tk AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, unnest(range(len(string_split(text, ' ')))) AS pos, len(string_split(text, ' ')) AS n FROM documents),
w AS (SELECT doc_id, n, pos, sum((starts_with(lower(token), 'th') OR starts_with(lower(token), 're'))::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS s FROM tk),
b AS (SELECT doc_id, n, coalesce((SELECT w2.pos FROM w w2 WHERE w2.doc_id = w.doc_id AND w2.pos < w2.n - 30 ORDER BY s DESC, pos DESC LIMIT 1), 0)::BIGINT AS best FROM w GROUP BY doc_id, n)"""


def _best(spark, sf):
    """Documents, their words in lower case, n and the best window."""
    rows = read(spark, sf, "documents").filter("text is not null").select("doc_id", "text", F.split(F.lower("text"), " ").alias("low"))
    return search.best_window(rows, "low", lambda t: t.startswith("th") | t.startswith("re"))


@query(f"WITH {_WIN} SELECT doc_id, n::BIGINT AS n, best FROM b")
def search_window(spark, sf):
    return _best(spark, sf).select("doc_id", "n", "best")


@query(f"WITH {_WIN}, x AS (SELECT doc_id, n, greatest(best - 30, 0) AS a FROM b) SELECT x.doc_id, a::BIGINT AS start, least(a + 60, n - 1)::BIGINT AS stop, array_to_string(string_split(text, ' ')[a + 1:least(a + 60, n - 1)], ' ') AS excerpt FROM x JOIN documents d ON d.doc_id = x.doc_id")
def search_excerpt(spark, sf):
    start, stop = search.excerpt_bounds(F.col("best"), F.col("n"))
    rows = _best(spark, sf).select("doc_id", "text", start.alias("start"), stop.alias("stop"))
    words = F.slice(F.split("text", " "), F.col("start").cast("int") + 1, F.greatest(F.col("stop") - F.col("start"), F.lit(0)).cast("int"))
    return rows.select("doc_id", "start", "stop", F.array_join(words, " ").alias("excerpt"))


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda t: CASE WHEN contains(lower(t), 'the') THEN t[1:instr(lower(t), 'the') - 1] || '<span class="highlight">' || t[instr(lower(t), 'the'):instr(lower(t), 'the') + 2] || '</span>' || t[instr(lower(t), 'the') + 3:] WHEN contains(lower(t), 're') THEN t[1:instr(lower(t), 're') - 1] || '<span class="highlight">' || t[instr(lower(t), 're'):instr(lower(t), 're') + 1] || '</span>' || t[instr(lower(t), 're') + 2:] ELSE t END), ' ') AS shown FROM documents WHERE text IS NOT NULL""")
def search_highlight(spark, sf):
    """Every word with the first term that it holds marked; of two terms the longer is tried first."""
    rows = read(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words")).filter("words is not null")
    terms = F.array(F.lit("the"), F.lit("re"))
    return rows.select("doc_id", F.array_join(F.transform("words", lambda w: text.highlighted(w, terms)), " ").alias("shown"))


@query("SELECT DISTINCT event_type, array_to_string([event_type || ' to the'] || [event_type || ' to'] || list_transform(list_sort(list_transform([event_type, 'the', 'to'], lambda t: {'n': -length(t), 't': t})), lambda x: x.t), '|') AS terms FROM events")
def search_terms(spark, sf):
    """Words and phrases of a query, in the order in which they are tried: longest first."""
    terms = text.search_terms(F.concat("event_type", F.lit(" to the")))
    return read(spark, sf, "events").select("event_type", F.array_join(terms, "|").alias("terms")).distinct()


#: References that the documents lack stand behind their whole texts: each is said to refer to articles by its id and length.
_REF = "rf AS (SELECT doc_id, coalesce(text, '') || ' See [[Article ' || doc_id % 99 + 1 || ']] and Article ' || n_chars % 120 || '(1) of the act; Article 6 and 7' AS body FROM documents)"


def _bodies(spark, sf):
    d = read(spark, sf, "documents")
    s = lambda c: c.cast("string")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" See [[Article "), s(F.col("doc_id") % 99 + 1), F.lit("]] and Article "), s(F.col("n_chars") % 120), F.lit("(1) of the act; Article 6 and 7"))
    return d.select("doc_id", body.alias("body"))


_NUM = r"list_sort(list_distinct(list_transform(regexp_extract_all(body, 'Article\s+(\d+)', 1), lambda x: x::INTEGER)))"


@query(rf"WITH {_REF} SELECT doc_id, array_to_string({_NUM}, ',') AS articles, array_to_string(list_transform(regexp_extract_all(body, '\[\[Article (\d+)', 1), lambda x: x), ',') AS bracketed FROM rf")
def ref_extract(spark, sf):
    rows = _bodies(spark, sf)
    return rows.select("doc_id", F.array_join(refs.numbers(F.col("body")).cast("array<string>"), ",").alias("articles"), F.array_join(F.regexp_extract_all("body", F.lit(refs.BRACKETED), F.lit(1)), ",").alias("bracketed"))


@query(f"WITH {_REF}, x AS (SELECT doc_id::VARCHAR AS d, unnest({_NUM})::BIGINT AS article FROM rf) SELECT article, part, string_agg(d, ', ' ORDER BY d) AS items, count(*)::BIGINT AS n FROM (SELECT *, (row_number() OVER (PARTITION BY article ORDER BY d) - 1) // 1000 AS part FROM x) GROUP BY ALL")
def inverted_index(spark, sf):
    from ..sources.sinks import grouped_lines

    rows = _bodies(spark, sf).select(F.explode(refs.numbers(F.col("body"))).alias("article"), "doc_id")
    return grouped_lines(rows.withColumn("article", F.col("article").cast("long")), "article", "doc_id")


@query(f"WITH {_REF}, x AS (SELECT doc_id, unnest({_NUM}) AS article FROM rf) SELECT doc_id, array_to_string(list(article ORDER BY article), ',') AS articles, count(*)::BIGINT AS n FROM x GROUP BY doc_id")
def forward_index(spark, sf):
    rows = _bodies(spark, sf).select("doc_id", F.explode(refs.numbers(F.col("body"))).alias("article"))
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("article")).cast("array<string>"), ",").alias("articles"), F.count("*").alias("n"))


@query("SELECT name, row_number() OVER (ORDER BY TRY_CAST(name AS INTEGER) NULLS LAST, name) AS place FROM (SELECT DISTINCT p_size::VARCHAR AS name FROM part UNION SELECT '6 and 7')")
def refs_numeric_sort(spark, sf):
    from pyspark.sql import Window

    names = read(spark, sf, "part").select(F.col("p_size").cast("string").alias("name")).unionByName(spark.createDataFrame([("6 and 7",)], "name string")).distinct()
    order = Window.orderBy(F.col("name").try_cast("int").asc_nulls_last(), "name")  # of distinct sizes
    return names.withColumn("place", F.row_number().over(order).cast("long"))


@query(rf"WITH {_REF} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({_NUM}, [6, 7], CASE WHEN doc_id % 2 = 0 THEN [doc_id::INTEGER % 10] ELSE [] END))), ',') AS articles FROM rf")
def refs_union(spark, sf):
    own = F.when(F.col("doc_id") % 2 == 0, F.array((F.col("doc_id") % 10).cast("int")))
    return _bodies(spark, sf).select("doc_id", F.array_join(refs.all_numbers(refs.numbers(F.col("body")), refs.split_compound(F.lit("6 and 7")), own).cast("array<string>"), ",").alias("articles"))


@query(f"WITH {_REF}, a AS (SELECT i AS article FROM range(1, 100) t(i)) SELECT doc_id, article::BIGINT AS article FROM rf JOIN a ON regexp_matches(body, '(?i)article\\s*' || article || '\\b')")
def theta_regex_join(spark, sf):
    """Documents that name an article, as an equi join on the numbers they hold."""
    articles = spark.range(1, 100).select(F.col("id").cast("int").alias("article"))
    found = relations.theta_matches(_bodies(spark, sf), articles, refs.numbers(F.col("body"), r"(?i)article\s*(\d+)\b"), "article")
    return found.select("doc_id", F.col("article").cast("long").alias("article"))


_RUL = r"""ru AS (SELECT item_id, '1. Article ' || item_id % 5 || ' holds. ' || text || chr(10) || '2. No more.' || chr(10) || '3. Article ' || item_id % 5 || ' and Article ' || item_id % 7 || '.' AS ruling FROM benchmark),
pt AS (SELECT item_id, trim(p) AS rule, pos FROM (SELECT item_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM (SELECT item_id, list_filter(list_transform(string_split_regex(chr(10) || ruling, '\n\s*\d+\.\s+'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM ru))),
nm AS (SELECT item_id, rule, pos, unnest(list_distinct(list_transform(regexp_extract_all(rule, 'Article\s+(\d+)', 1), lambda x: x::BIGINT))) AS article FROM pt)"""


def _rulings(spark, sf):
    s = lambda c: c.cast("string")
    b, i = read(spark, sf, "benchmark"), F.col("item_id")
    ruling = F.concat(F.lit("1. Article "), s(i % 5), F.lit(" holds. "), F.col("text"), F.lit("\n2. No more.\n3. Article "), s(i % 5), F.lit(" and Article "), s(i % 7), F.lit("."))
    return b.select("item_id", ruling.alias("ruling"))


@query(f"WITH {_RUL} SELECT item_id, article, row_number() OVER (PARTITION BY item_id, article ORDER BY pos) AS place, rule FROM nm")
def rules_by_key(spark, sf):
    rows = relations.rules_for(_rulings(spark, sf), "item_id", refs.points(F.col("ruling")), refs.numbers(F.col("rule")))
    return rows.withColumn("article", F.col("article").cast("long"))


@query(f"WITH {_RUL}, nh AS (SELECT item_id, rule, pos, unnest(list_distinct(list_transform(regexp_extract_all(rule, 'Article\\s+(\\d+) holds', 1), lambda x: x::BIGINT))) AS article FROM pt), w AS (SELECT item_id, unnest([2, 6]) AS article FROM ru) SELECT w.item_id, w.article::BIGINT AS article, coalesce(n.rule, f.rule) AS rule FROM w LEFT JOIN nh n ON n.item_id = w.item_id AND n.article = w.article JOIN pt f ON f.item_id = w.item_id AND f.pos = 0 WHERE n.rule IS NOT NULL OR EXISTS (SELECT 1 FROM nm m WHERE m.item_id = w.item_id AND m.article = w.article)")
def rules_fallback(spark, sf):
    """The points that say that an article holds; where none does, the first point if the ruling mentions the article."""
    r = _rulings(spark, sf)
    wanted = r.select("item_id", F.explode(F.array(F.lit(2), F.lit(6))).alias("article"))
    found = relations.rules_or_first(r, "item_id", refs.points(F.col("ruling")), refs.numbers(F.col("rule"), r"Article\s+(\d+) holds"), wanted, refs.numbers(F.col("ruling")))
    return found.withColumn("article", F.col("article").cast("long"))


@query(r"SELECT o_orderkey, replace(c, '/', '-') AS file, regexp_replace(c, '/', '⧸') AS shown, replace(c, '/', '∕') AS timeline, regexp_replace(replace(c, '/', '-'), '^C-(\d+)-(\d+)$', 'C-\1/\2') AS label FROM (SELECT o_orderkey, 'C-' || o_orderkey || '/' || o_custkey % 100 || CASE WHEN o_orderkey % 5 = 0 THEN '/x' ELSE '' END AS c FROM orders)")
def case_number_forms(spark, sf):
    o = read(spark, sf, "orders")
    c = F.concat(F.lit("C-"), F.col("o_orderkey").cast("string"), F.lit("/"), (F.col("o_custkey") % 100).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "/x").otherwise(""))
    rows = o.select("o_orderkey", c.alias("c"))
    c = F.col("c")
    return rows.select("o_orderkey", text.case_file_name(c).alias("file"), text.case_display(c).alias("shown"), text.case_timeline(c).alias("timeline"), text.link_case_label(text.case_file_name(c)).alias("label"))


@query(f"WITH {_REF} SELECT doc_id, regexp_replace(body, '\\[\\[(Article)\\s+(\\d{{3,}})(\\|[^\\]]*)?\\]\\]', '\\1 \\2', 'g') AS body FROM (SELECT doc_id, replace(body, 'Article ' || doc_id % 99 + 1 || ']]', 'Article ' || doc_id % 150 || ']]') AS body FROM rf)")
def unlink_articles(spark, sf):
    rows = _bodies(spark, sf)
    s = lambda c: c.cast("string")
    body = F.replace("body", F.concat(F.lit("Article "), s(F.col("doc_id") % 99 + 1), F.lit("]]")), F.concat(F.lit("Article "), s(F.col("doc_id") % 150), F.lit("]]")))
    return rows.select("doc_id", refs.unlink_beyond(body).alias("body"))


@query(f"WITH {_REF} SELECT doc_id, regexp_replace(body, '\\bArticle (\\d+)((?:\\(\\w+\\))+)', '[[Article \\1|Article \\1\\2]]', 'g') AS body FROM rf")
def link_articles(spark, sf):
    return _bodies(spark, sf).select("doc_id", refs.to_wikilinks(F.col("body")).alias("body"))
