"""Queries on helpers of paths, links, names, lists and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, paths, refs, text
from ..operators import graph, relations
from .graph_queries import _FK, _edges
from .tables import LINKS, PAGES, PATH, links, pages, query, read

_S = lambda c: c.cast("string")


@query(f"WITH {LINKS} SELECT src, dst AS other, 'out' AS way FROM lk UNION SELECT dst, src, 'in' FROM lk")
def graph_neighbours(spark, sf):
    """Both neighbours of every edge."""
    return graph.neighbours(links(spark, sf)).select(F.col("node").alias("src"), "other", "way")


@query(f"WITH {_FK} SELECT src, dst FROM e UNION SELECT 'x', 'y'")
def graph_add_edge(spark, sf):
    return graph.merge(_edges(spark, sf), spark.createDataFrame([("x", "y")], "src string, dst string"))


_ANC = "an AS (SELECT DISTINCT array_to_string(string_split(slug, '/')[1:i], '/') AS path FROM (SELECT slug, unnest(range(1, len(string_split(slug, '/')))) AS i FROM pg))"


@query(f"WITH {PAGES}, {_ANC} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM an")
def folder_paths(spark, sf):
    """Folders in pre-order."""
    return graph.folder_paths(pages(spark, sf))


@query(f"WITH {PAGES}, t AS (SELECT DISTINCT array_to_string(string_split(slug, '/')[1:i], '/') AS path, i FROM (SELECT slug, unnest(range(1, len(string_split(slug, '/')) + 1)) AS i FROM pg)) SELECT path, upper(replace(regexp_extract(path, '[^/]*$'), '-', ' ')) AS shown FROM t")
def tree_map(spark, sf):
    """Every node of the tree with a made name to show."""
    shown = F.upper(F.replace(paths.basename(F.col("path")), F.lit("-"), F.lit(" ")))
    return graph.tree(pages(spark, sf)).select("path", shown.alias("shown")).distinct()


_DATED = "dp AS (SELECT c.c_mktsegment || '/' || o_orderpriority || '/o' || o_orderkey AS slug, o_orderdate AS date FROM orders JOIN customer c ON c_custkey = o_custkey)"


@query(f"WITH {_DATED}, f AS (SELECT unnest([split_part(slug, '/', 1), split_part(slug, '/', 1) || '/' || split_part(slug, '/', 2)]) AS folder, date FROM dp) SELECT folder, max(date) AS date, count(*)::BIGINT AS n FROM f GROUP BY folder")
def folder_dates(spark, sf):
    """Subfolders with the date of their newest page, at any depth, and how many pages they hold."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    slug = F.concat_ws("/", "c_mktsegment", "o_orderpriority", F.concat(F.lit("o"), _S(F.col("o_orderkey"))))
    return relations.folder_dates(o.select(slug.alias("slug"), F.col("o_orderdate").alias("date"), F.lit("").alias("title")))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 2")
def case_pages(spark, sf):
    """Pages of the case-law folder, by slug in any case or by the folder that they name."""
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(k.alias("id"), F.concat(F.when(k % 3 == 0, "Case-Law/").otherwise("notes/"), _S(k)).alias("slug"), F.when(k % 3 == 1, "Case law").alias("folder"))
    return rows.filter(relations.is_case_page(F.col("slug"), F.col("folder"))).select("id")


_KINDED = "kd AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'GDPR/Article-' || p_size WHEN 1 THEN 'tags/' || p_brand WHEN 2 THEN 'index' ELSE 'notes/' || p_partkey END AS slug FROM part)"


@query(f"WITH {_KINDED} SELECT id, CASE id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'tag' WHEN 2 THEN 'index' ELSE 'page' END AS kind, CASE WHEN id % 4 = 0 THEN (SELECT p_size::INTEGER FROM part WHERE p_partkey = id) END AS article FROM kd")
def page_kinds(spark, sf):
    """What a page is by its slug, and the article that its name holds."""
    k = F.col("p_partkey")
    slug = F.when(k % 4 == 0, F.concat(F.lit("GDPR/Article-"), _S(F.col("p_size")))).when(k % 4 == 1, F.concat(F.lit("tags/"), "p_brand")).when(k % 4 == 2, "index").otherwise(F.concat(F.lit("notes/"), _S(k)))
    rows = read(spark, sf, "part").select(k.alias("id"), slug.alias("slug"))
    return rows.select("id", paths.page_kind(F.col("slug")).alias("kind"), refs.article_of_slug(F.col("slug")).alias("article"))


@query(f"WITH {PAGES}, h AS (SELECT DISTINCT slug, unnest(list_concat(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ['./img/' || page_id || '.png', '../up#x', 'https://a.example/', '#top', './page.md'])) AS url FROM pg) SELECT slug, url FROM h WHERE starts_with(url, '.') AND NOT regexp_matches(url, '(^|/)index$') AND NOT regexp_matches(url, '[.](md|html)$')")
def relative_dependencies(spark, sf):
    """The relative addresses of each page, on which its output depends."""
    made = F.array(F.concat(F.lit("./img/"), _S(F.col("page_id")), F.lit(".png")), F.lit("../up#x"), F.lit("https://a.example/"), F.lit("#top"), F.lit("./page.md"))
    rows = pages(spark, sf, "page_id", "html").select("slug", F.explode(F.concat(markup.hrefs(F.col("html")), made)).alias("url"))
    return rows.filter(paths.is_relative_url(F.col("url"))).distinct()


@query("SELECT tag, n FROM (SELECT lang AS tag, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) UNION ALL SELECT 'index', 0")
def tags_with_index(spark, sf):
    """Tags and the one that is always there."""
    tags = read(spark, sf, "documents").filter("lang is not null").groupBy(F.col("lang").alias("tag")).agg(F.count("*").alias("n"))
    return relations.with_member(tags, "tag", "index", n=0)


@query(f"WITH {PAGES}, s AS (SELECT slug FROM pg UNION ALL SELECT lower(split_part(title, ' ', 1)) FROM pg) SELECT regexp_extract(slug, '[^/]*$') AS name, count(*)::BIGINT AS n FROM s GROUP BY 1")
def alias_slug_counts(spark, sf):
    """How many slugs end in each name, aliases included and repeats counted: only names of one are unique."""
    p = pages(spark, sf).select("slug", F.array(F.lower(F.split_part("title", F.lit(" "), F.lit(1)))).alias("aliases"))
    return relations.with_alias_slugs(p).groupBy(paths.basename(F.col("slug")).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '../' ELSE './' END || CASE WHEN page_id % 3 = 2 THEN 'a-b' ELSE 'a-' || page_id END || CASE page_id % 3 WHEN 1 THEN '/' ELSE '' END || CASE page_id % 3 WHEN 2 THEN '#the-part-' || page_id ELSE '' END AS url FROM pages")
def internal_links(spark, sf):
    """Links as they are written, with blanks, percent codes, dots, extensions and anchors, as relative addresses."""
    k = _S(F.col("page_id"))
    n = F.col("page_id") % 3
    link = F.when(n == 0, F.concat(F.lit("../a%20"), k, F.lit(".md"))).when(n == 1, F.concat(F.lit("a "), k, F.lit("/index"))).otherwise(F.concat(F.lit("a b.html#The part "), k, F.lit("!")))
    return read(spark, sf, "pages").select("page_id", paths.transform_internal_link(link).alias("url"))


@query(f"SELECT page_id, p AS path, CASE page_id % 3 WHEN 0 THEN '#the-part-' || page_id WHEN 1 THEN '#The Part' ELSE '' END AS anchor FROM (SELECT page_id, CASE page_id % 3 WHEN 1 THEN {PATH} || '.pdf' ELSE {PATH} END AS p FROM pages)")
def split_anchors(spark, sf):
    """Paths and anchors of links; that of a PDF stays as it is."""
    n, path = F.col("page_id") % 3, paths.url_path(F.col("url"))
    link = F.when(n == 0, F.concat(path, F.lit("#The Part "), _S(F.col("page_id")))).when(n == 1, F.concat(path, F.lit(".pdf#The Part"))).otherwise(path)
    rows = read(spark, sf, "pages").select("page_id", link.alias("link"))
    own, anchor = paths.split_anchor(F.col("link"))
    return rows.select("page_id", own.alias("path"), anchor.alias("anchor"))


@query("SELECT p_partkey AS id, replace(lower(p_brand), '#', '') || '/' || replace(p_name, ' ', '-') || '/q-and-a' AS tag FROM part")
def slug_tags(spark, sf):
    """Tags slugged segment by segment."""
    tag = F.concat_ws("/", F.lower("p_brand"), "p_name", F.lit("q&a?/"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.rtrim(markup.slug_tag(tag), F.lit("/")).alias("tag"))


@query(f"SELECT page_id, ends_with({PATH}, '/') OR regexp_matches({PATH}, '(^|/)index(\\.md|\\.html)?$') AS folder, regexp_replace({PATH}, '/$', '') AS stripped, regexp_matches({PATH}, '\\.[A-Za-z0-9]+$') AS extension, CASE WHEN starts_with({PATH}, '.') THEN {PATH} ELSE './' || regexp_replace({PATH}, '^/', '') END AS relative FROM pages")
def path_helpers(spark, sf):
    """What paths end in, without their slashes, and as relative ones."""
    rows = read(spark, sf, "pages").select("page_id", paths.url_path(F.col("url")).alias("p"))
    p = F.col("p")
    return rows.select("page_id", paths.is_folder_path(p).alias("folder"), paths.strip_slashes(p).alias("stripped"), paths.has_extension(p).alias("extension"), paths.with_relative_start(p).alias("relative"))


@query("SELECT doc_id, 'a ' || regexp_replace(coalesce(text, '') || '%%' || chr(10) || '%% b', '(?s)%%.*?%%', '', 'g') AS plain FROM documents")
def strip_comments(spark, sf):
    """Whole texts without a comment that spans lines."""
    body = F.concat(F.lit("a %%one\ntwo%%"), F.lit("%%x%% "), F.coalesce("text", F.lit("")), F.lit("%%\n%% b"))
    return read(spark, sf, "documents").select("doc_id", F.regexp_replace(text.strip_comments(body), "^a  ", "a ").alias("plain"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def plain_text(spark, sf):
    """Pages as text."""
    return read(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: x <> ''), ' ') AS tokens FROM documents")
def search_tokens(spark, sf):
    """The words of whole texts as the index has them."""
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.search_tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'C-' || o_orderkey || '/' || o_custkey % 90 + 10 ELSE 'some-page' END AS number, 'C-' || o_orderkey || '/' || o_custkey % 90 + 10 AS title, 'Mr A said ' || o_custkey || '. Mr B did.' AS body FROM orders")
def case_names(spark, sf):
    """Case numbers of slugs, else their last segment; titles of file names; sentences replaced in turn."""
    k, year = _S(F.col("o_orderkey")), _S(F.col("o_custkey") % 90 + 10)
    slug = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("case-law/C-"), k, F.lit("-"), year)).otherwise("case-law/some-page")
    pairs = F.array(F.struct(F.lit("(.*)").alias("old"), _S(F.col("o_custkey")).alias("new")), F.struct(F.lit("X").alias("old"), F.lit("Mr A").alias("new")), F.struct(F.lit("Y+").alias("old"), F.lit("Mr B").alias("new")))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.case_of_slug(slug).alias("number"), text.title_from_file(F.concat(F.lit("C-"), k, F.lit("-"), year, F.lit(".md"))).alias("title"), text.replace_in_turn(F.lit("X said (.*). Y+ did."), pairs).alias("body"))


@query(f"WITH {LINKS} SELECT src, dst, CASE WHEN regexp_matches(dst, '^([a-z][a-z0-9+.\\-]*:|//)') THEN 'external' WHEN starts_with(dst, '#') THEN 'anchor' ELSE 'internal' END AS kind, CASE WHEN regexp_matches(dst, '^([a-z][a-z0-9+.\\-]*:|//)') OR starts_with(dst, '#') THEN dst ELSE coalesce(nullif(regexp_extract(regexp_replace(dst, '#.*$', ''), '[^/]*$'), ''), dst) END AS shown FROM lk")
def link_display(spark, sf):
    """Links that show their own address show its last segment."""
    rows = links(spark, sf).withColumn("p", markup.pretty_text(F.col("dst"), F.col("dst")))
    return rows.select("src", "dst", F.col("p.kind").alias("kind"), F.col("p.text").alias("shown"))


@query("SELECT s_suppkey AS id, 'C-1/22, ' || s_name AS shown, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'sub' END AS subtitle FROM supplier")
def flat_names(spark, sf):
    """Names without the brackets of links; parties, else a subtitle, below them."""
    k = F.col("s_suppkey")
    shown = refs.flatten_name(F.concat(F.lit('[["C-1/22"]], '), "s_name"))
    return read(spark, sf, "supplier").select(k.alias("id"), shown.alias("shown"), F.coalesce(text.truthy(F.when(k % 2 == 0, F.col("s_name")).otherwise("")), F.lit("sub")).alias("subtitle"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '[[C-' || o_orderkey || '-22|C-' || o_orderkey || '⧸22]]' WHEN 1 THEN '([[Article 5]]\\)' ELSE '### First question, ' || o_orderkey END AS line FROM orders")
def editorial_rules(spark, sf):
    """House style of lines."""
    k, n = _S(F.col("o_orderkey")), F.col("o_orderkey") % 3
    line = F.when(n == 0, F.concat(F.lit("[[C-"), k, F.lit("-22|C-"), k, F.lit("/22]]"))).when(n == 1, "([[Article 5]])").otherwise(F.concat(F.lit("First question, "), k))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), refs.editorial(line).alias("line"))


@query("SELECT p_partkey AS id, '/GDPR/Article-' || p_size AS url, p_size > 40 AS missing FROM part")
def article_chips(spark, sf):
    """Where chips lead, whether or not the article is there; that is told apart."""
    chips = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", refs.article_url(F.col("p_size")).alias("url"))
    there = spark.range(1, 41).select(F.col("id").cast("int").alias("p_size"), F.lit(True).alias("there"))
    return chips.join(F.broadcast(there), "p_size", "left").select("id", "url", F.col("there").isNull().alias("missing"))  # 40 rows


@query("SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey || ' Dokumente' WHEN 1 THEN CASE WHEN n_nationkey = 1 THEN '1 item' ELSE n_nationkey || ' items' END ELSE n_nationkey || ' items' END AS label, CASE n_nationkey % 3 WHEN 0 THEN 'Suche' ELSE 'Search' END AS search FROM nation")
def locale_strings(spark, sf):
    """Interface texts by locale, English where a locale lacks them, singular and plural."""
    k = F.col("n_nationkey")
    locale = F.when(k % 3 == 0, "de").when(k % 3 == 1, "en").otherwise("xx")
    return read(spark, sf, "nation").select(k.cast("long").alias("id"), text.counted(locale, k).alias("label"), text.localised(locale, "search").alias("search"))


@query("SELECT o_custkey AS id, string_agg(CASE WHEN o_orderkey % 2 = 0 THEN 'even ' ELSE '' END || 'shown', ' ' ORDER BY o_orderkey) AS names FROM orders GROUP BY o_custkey")
def class_names(spark, sf):
    """Class names that are set, joined by blanks."""
    name = text.class_names(F.when(F.col("o_orderkey") % 2 == 0, "even"), F.lit("shown"), F.lit(""))
    rows = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", name.alias("c")))).alias("all"))
    return rows.select("id", F.array_join(F.transform("all", lambda x: x["c"]), " ").alias("names"))


@query(f"WITH RECURSIVE {_FK}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT 'n3' AS node, 0 AS h UNION SELECT b.dst, h + 1 FROM k JOIN b ON b.src = node WHERE h < 1), l AS (SELECT DISTINCT e.src, e.dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)) SELECT src, dst, coalesce(a.n_name, src) AS src_name, coalesce(b.n_name, dst) AS dst_name FROM l LEFT JOIN nation a ON 'n' || a.n_nationkey = src LEFT JOIN nation b ON 'n' || b.n_nationkey = dst")
def graph_neighbourhood_records(spark, sf):
    """The links of a neighbourhood with the records of both ends."""
    e = _edges(spark, sf)
    own = read(spark, sf, "nation").select(F.concat(F.lit("n"), _S(F.col("n_nationkey"))).alias("node"), F.col("n_name").alias("name"))
    found = relations.neighbourhood_links(e, graph.reach(e, graph.start_rows(spark, ["n3"]), 1, undirected=True))
    found = relations.with_records(found, own, "node", ["name"])
    return found.select("src", "dst", F.coalesce("src_name", "src").alias("src_name"), F.coalesce("dst_name", "dst").alias("dst_name"))
