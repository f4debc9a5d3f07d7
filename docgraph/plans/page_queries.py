"""Queries on paths, links, folders and tags of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, paths, text
from ..operators import graph, relations
from .tables import LINKS, NODES, PAGES, PATH, SLUG, links, nodes, pages, query, read, sql_sluggify, sql_slugify


@query(f"SELECT page_id, {PATH} AS path, {SLUG} AS slug FROM pages")
def url_slug(spark, sf):
    return read(spark, sf, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"), paths.page_slug(F.col("url")).alias("slug"))


@query(f"WITH {PAGES} SELECT page_id, CASE WHEN s = '' THEN '/' ELSE s END AS simple FROM (SELECT page_id, regexp_replace(regexp_replace(slug, '(^|/)index$', '\\1'), '^/', '') AS s FROM pg)")
def slug_simplify(spark, sf):
    return pages(spark, sf, "page_id").select("page_id", paths.simplify_slug(F.col("slug")).alias("simple"))


_EXT, _BAD = r"'\.[A-Za-z0-9]+$'", "'[ #?&]'"
_P = f"(CASE page_id % 4 WHEN 0 THEN {PATH} WHEN 1 THEN './' || {PATH} WHEN 2 THEN url ELSE 'x/' || {PATH} END)"


@query(rf"""SELECT page_id, p, NOT starts_with(p, '.') AND regexp_matches(p, {_EXT}) AS file_path, NOT regexp_matches(p, '^[./]') AND NOT ends_with(p, '/') AND NOT regexp_matches(p, {_BAD}) AS full_slug,
NOT (starts_with(p, '.') OR (length(p) > 1 AND starts_with(p, '/'))) AND NOT regexp_matches(p, '(^|/)index$') AND NOT regexp_matches(p, {_BAD}) AND NOT regexp_matches(p, {_EXT}) AS simple_slug,
regexp_matches(p, '^\.{{1,2}}') AND NOT regexp_matches(p, '(^|/)index$') AND NOT regexp_matches(p, '\.(md|html)$') AS relative_url FROM (SELECT page_id, {_P} AS p FROM pages)""")
def slug_guards(spark, sf):
    path, n = paths.url_path(F.col("url")), F.col("page_id") % 4
    p = F.when(n == 0, path).when(n == 1, F.concat(F.lit("./"), path)).when(n == 2, F.col("url")).otherwise(F.concat(F.lit("x/"), path))
    rows = read(spark, sf, "pages").select("page_id", p.alias("p"))
    c = F.col("p")
    return rows.select("page_id", "p", paths.is_file_path(c).alias("file_path"), paths.is_full_slug(c).alias("full_slug"), paths.is_simple_slug(c).alias("simple_slug"), paths.is_relative_url(c).alias("relative_url"))


@query(f"WITH {PAGES} SELECT page_id, CASE WHEN d <= 0 THEN '.' ELSE array_to_string(list_transform(range(d), lambda i: '..'), '/') END AS root FROM (SELECT page_id, len(list_filter(string_split(slug, '/'), lambda s: s <> '')) - 1 AS d FROM pg)")
def path_to_root(spark, sf):
    return pages(spark, sf, "page_id").select("page_id", paths.path_to_root(F.col("slug")).alias("root"))


@query(f"WITH {PAGES} SELECT page_id, array_to_string(list_transform(range(1, len(string_split(slug, '/')) + 1), lambda i: array_to_string(string_split(slug, '/')[1:i], '/')), '|') AS prefixes FROM pg")
def segment_prefixes(spark, sf):
    return pages(spark, sf, "page_id").select("page_id", F.array_join(paths.segment_prefixes(F.col("slug")), "|").alias("prefixes"))


@query(f"WITH {PAGES} SELECT page_id, '/' || array_to_string(list_filter(['a', slug, lower(split_part(title, ' ', 1))], lambda s: s <> '' AND s <> '/'), '/') || '/' AS joined FROM pg")
def join_segments(spark, sf):
    return pages(spark, sf, "page_id").select("page_id", paths.join_segments(F.lit("/a/"), F.col("slug"), F.lower(F.split_part("title", F.lit(" "), F.lit(1))), F.lit("/")).alias("joined"))


@query(f"WITH {PAGES} SELECT page_id, 'data/' || {sql_slugify(chr(39) + 'data/' + chr(39) + ' || regexp_replace(title, ' + chr(39) + '[.].*$' + chr(39) + ', ' + chr(39) * 2 + ') || ' + chr(39) + '.png' + chr(39))}[6:] AS destination FROM pg")
def asset_manifest(spark, sf):
    """Files named by page titles, as assets: source name to slugged destination."""
    name = F.concat(F.lit("data/"), F.regexp_replace("title", "[.].*$", ""), F.lit(".png"))
    return pages(spark, sf, "page_id").select("page_id", paths.slugify_file_path(name).alias("destination"))


_HEADS = r"list_transform(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>'), lambda x: trim(regexp_replace(x, '(?s)<[^>]*>', '', 'g')))"


@query(f"WITH {PAGES} SELECT page_id, title, array_to_string({_HEADS}, '|') AS headings, len({_HEADS})::BIGINT AS n FROM pg")
def page_title_headings(spark, sf):
    h = markup.html_headings(F.col("html"))
    return pages(spark, sf, "page_id", "html").select("page_id", "title", F.array_join(F.transform(h, lambda x: x["text"]), "|").alias("headings"), F.size(h).cast("long").alias("n"))


#: Headings that the pages lack are made of their list items: depth 1 to 3 by the length of the word.
_ITEMS = r"""it AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS word, generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)"', 1), 1) - 1 AS pos FROM pages),
hd AS (SELECT page_id, pos, length(word) % 3 + 1 AS depth, word AS text, replace(regexp_replace(lower(trim(word)), '[^\w\p{L}\p{N}\- ]', '', 'g'), ' ', '-') AS base FROM it)"""


def _items(spark, sf):
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    return read(spark, sf, "pages").select("page_id", F.transform(found, lambda w: F.struct((F.length(w) % 3 + 1).alias("depth"), w.alias("text"))).alias("items"))


@query(f"""WITH {_ITEMS} SELECT page_id, pos::BIGINT AS pos, (depth - min(depth) OVER (PARTITION BY page_id))::BIGINT AS depth, text, base || CASE WHEN again = 0 THEN '' ELSE '-' || again END AS slug
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, base ORDER BY pos) - 1 AS again, count(*) OVER (PARTITION BY page_id) AS n FROM hd WHERE depth <= 3) WHERE n >= 2""")
def toc_entries(spark, sf):
    return markup.toc(_items(spark, sf), "page_id", F.col("items"))


@query(f"""WITH {_ITEMS} SELECT page_id, base, count(*)::BIGINT AS n FROM hd GROUP BY ALL HAVING count(*) > 1""")
def heading_slug_dedup(spark, sf):
    rows = _items(spark, sf).select("page_id", F.explode("items").alias("h")).select("page_id", paths.slug_anchor(F.col("h.text")).alias("base"))
    return rows.groupBy("page_id", "base").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"WITH {_ITEMS}, s AS (SELECT a.page_id, a.pos, min(b.pos) AS e FROM hd a LEFT JOIN hd b ON a.page_id = b.page_id AND b.pos > a.pos AND b.depth <= a.depth GROUP BY ALL) SELECT s.page_id, s.pos::BIGINT AS start, coalesce(e, (SELECT max(pos) + 1 FROM hd h WHERE h.page_id = s.page_id))::BIGINT AS stop FROM s")
def heading_section(spark, sf):
    rows = _items(spark, sf).select("page_id", F.posexplode("items").alias("pos", "h")).select("page_id", "pos", "h.depth", F.col("h.text").alias("slug"))
    return markup.section(rows, "page_id", rows).select("page_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query(f"WITH {LINKS} SELECT src, dst FROM lk")
def outgoing_links(spark, sf):
    return links(spark, sf)


_KIND = "CASE WHEN starts_with(h, '#') THEN 'anchor' WHEN regexp_matches(h, '^([a-z][a-z0-9+.\\-]*:|//)') THEN 'external' ELSE 'internal' END"


@query(f"""SELECT {_KIND} AS kind, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), [url, '#' || page_id])) AS h FROM pages) GROUP BY ALL""")
def link_kind(spark, sf):
    all_of = F.concat(markup.hrefs(F.col("html")), F.array("url", F.concat(F.lit("#"), F.col("page_id").cast("string"))))
    return read(spark, sf, "pages").select(F.explode(all_of).alias("h")).groupBy(markup.link_kind(F.col("h")).alias("kind")).agg(F.count("*").alias("n"))


_EXTS = "CASE page_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.mp3' WHEN 3 THEN '.pdf' WHEN 4 THEN '.webp' ELSE '' END"


@query(f"""SELECT page_id, CASE WHEN e IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'svg', 'webp') THEN 'image' WHEN e IN ('mp4', 'webm', 'ogv', 'mov', 'mkv') THEN 'video' WHEN e IN ('mp3', 'wav', 'm4a', 'ogg', '3gp', 'flac') THEN 'audio' WHEN e = 'pdf' THEN 'pdf' ELSE 'transclude' END AS kind, target
FROM (SELECT page_id, target, CASE WHEN contains(target, '.') THEN split_part(lower(target), '.', -1) END AS e FROM (SELECT page_id, {PATH} || {_EXTS} AS target FROM pages))""")
def embed_kind(spark, sf):
    n, path = F.col("page_id") % 6, paths.url_path(F.col("url"))
    ext = F.when(n == 0, ".PNG").when(n == 1, ".mp4").when(n == 2, ".mp3").when(n == 3, ".pdf").when(n == 4, ".webp").otherwise("")
    rows = read(spark, sf, "pages").select("page_id", F.concat(path, ext).alias("target"))
    return rows.select("page_id", markup.embed_kind(F.col("target")).alias("kind"), "target")


@query(f"WITH {NODES} SELECT dst, src, place FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS place FROM lk WHERE dst IN (SELECT slug FROM nd)) WHERE place <= 10")
def backlinks_topk(spark, sf):
    """Every page's first ten referrers: the flagship query."""
    return relations.backlinks(links(spark, sf), nodes(spark, sf), 10)


@query(f"WITH {NODES} SELECT slug, count(src)::BIGINT AS n FROM nd LEFT JOIN lk ON dst = slug GROUP BY slug")
def backlinks_left(spark, sf):
    return relations.backlink_counts(links(spark, sf), nodes(spark, sf))


@query(f"WITH {NODES} SELECT dst, count(DISTINCT src)::BIGINT AS n FROM lk WHERE dst NOT IN (SELECT slug FROM nd) GROUP BY dst")
def dangling_links(spark, sf):
    return relations.dangling_links(links(spark, sf), nodes(spark, sf))


@query(f"WITH {NODES} SELECT src, dst FROM lk WHERE dst IN (SELECT slug FROM nd)")
def valid_links(spark, sf):
    return relations.valid_links(links(spark, sf), nodes(spark, sf))


@query(f"""WITH {PAGES}, ln AS (SELECT slug AS src, regexp_extract(slug, '[^/]*$') AS target FROM pg UNION SELECT slug, 'nowhere' FROM pg),
u AS (SELECT regexp_extract(slug, '[^/]*$') AS name, count(*) AS n, min(slug) AS hit FROM pg GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT src, target, CASE WHEN target <> 'index' THEN hit END AS hit, CASE WHEN len(list_filter(string_split(src, '/'), lambda s: s <> '')) <= 1 THEN '.' ELSE array_to_string(list_transform(range(len(list_filter(string_split(src, '/'), lambda s: s <> '')) - 1), lambda i: '..'), '/') END AS root FROM ln LEFT JOIN u ON name = target)
SELECT src, target, CASE WHEN target = 'index' AND hit IS NULL THEN root || '/' WHEN hit IS NULL THEN root || '/' || target WHEN hit = 'index' THEN root || '/' WHEN regexp_matches(hit, '/index$') THEN root || '/' || regexp_replace(hit, 'index$', '') ELSE root || '/' || hit END AS url FROM r""")
def shortest_link_resolution(spark, sf):
    """Links by bare names: those of one page only lead there, others stay as written."""
    p = pages(spark, sf).select("slug")
    ln = p.select(F.col("slug").alias("src"), paths.basename(F.col("slug")).alias("target")).unionByName(p.select(F.col("slug").alias("src"), F.lit("nowhere").alias("target"))).distinct()
    return paths.resolve_links(ln, p, "shortest").select("src", "target", "url")


@query(f"WITH {PAGES} SELECT regexp_extract(slug, '^(.*)/[^/]*$', 1) AS folder, count(*)::BIGINT AS n FROM pg WHERE contains(slug, '/') AND NOT regexp_matches(slug, '(^|/)index$') GROUP BY 1")
def folder_listing(spark, sf):
    return relations.folder_children(pages(spark, sf)).groupBy("folder").agg(F.count("*").alias("n"))


_ANC = "an AS (SELECT DISTINCT array_to_string(string_split(slug, '/')[1:i], '/') AS folder FROM (SELECT slug, unnest(range(1, len(string_split(slug, '/')))) AS i FROM pg))"


@query(f"WITH {PAGES}, {_ANC} SELECT folder, regexp_extract(folder, '[^/]*$') AS name FROM an")
def folder_ancestors(spark, sf):
    return relations.folders(pages(spark, sf)).select("folder", paths.basename(F.col("folder")).alias("name"))


@query(f"WITH {PAGES}, {_ANC} SELECT folder, folder || '/index' AS slug FROM an WHERE folder || '/index' NOT IN (SELECT slug FROM pg)")
def folder_synthetic_index(spark, sf):
    return relations.missing_indexes(pages(spark, sf))


@query(f"WITH {PAGES}, own AS (SELECT min(slug) AS slug, min(title) AS title FROM pg GROUP BY slug), c AS (SELECT slug, i - 1 AS pos, array_to_string(string_split(slug, '/')[1:i], '/') AS folder FROM (SELECT slug, unnest(range(1, len(string_split(slug, '/')))) AS i FROM own)) SELECT c.slug, pos::BIGINT AS pos, folder, coalesce(CASE WHEN lower(o.title) <> 'index' THEN o.title END, replace(regexp_extract(folder, '[^/]*$'), '-', ' ')) AS label FROM c LEFT JOIN own o ON o.slug = folder || '/index'")
def breadcrumbs(spark, sf):
    return relations.breadcrumbs(pages(spark, sf).groupBy("slug").agg(F.min("title").alias("title")))


_TREE = f"WITH {PAGES}, t AS (SELECT slug, i, array_to_string(string_split(slug, '/')[1:i], '/') AS path FROM (SELECT slug, unnest(range(1, len(string_split(slug, '/')) + 1)) AS i FROM pg)) "


@query(_TREE + "SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, i::BIGINT AS depth, bool_or(path = slug) AS is_file FROM t GROUP BY ALL")
def explorer_tree(spark, sf):
    return graph.tree(pages(spark, sf))


#: Numbers by their value, which the engine never computes.
NATURAL = r"list_transform(regexp_extract_all(lower({x}), '(\d+|\D+)'), lambda p: {{'t': CASE WHEN regexp_matches(p, '^\d') THEN '0' ELSE p END, 'n': CASE WHEN regexp_matches(p, '^\d') THEN p::HUGEINT ELSE 0 END}})"


@query(_TREE + f", k AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, bool_or(path = slug) AS is_file FROM t GROUP BY ALL) SELECT path, row_number() OVER (PARTITION BY parent ORDER BY is_file, {NATURAL.format(x="regexp_extract(path, '[^/]*$')")}, path) AS place FROM k")
def explorer_sort(spark, sf):
    """Folders before files, numbers by value."""
    rows = graph.tree(pages(spark, sf)).withColumn("key", text.natural_key(paths.basename(F.col("path"))))
    return relations.numbered(rows, "parent", [F.col("is_file"), F.col("key"), F.col("path")]).select("path", "place")


@query(_TREE + "SELECT DISTINCT path FROM t WHERE NOT list_contains(string_split(path, '/'), 'en')")
def explorer_filter(spark, sf):
    return graph.without_subtrees(graph.tree(pages(spark, sf)), lambda s: s == "en").select("path").distinct()


_TAGS = "tg AS (SELECT doc_id, lang || '/' || source AS tag FROM documents), tp AS (SELECT doc_id, split_part(tag, '/', 1) AS tag FROM tg UNION SELECT doc_id, tag FROM tg)"


def _tags(spark, sf):
    """Pages with one nested tag, lang/source."""
    return read(spark, sf, "documents").select("doc_id", F.array(F.concat_ws("/", "lang", "source")).alias("tags"))


@query(f"WITH {_TAGS} SELECT tag, count(*)::BIGINT AS n FROM tp GROUP BY tag")
def tag_hierarchy(spark, sf):
    return relations.page_tags(_tags(spark, sf), "doc_id", F.col("tags")).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"WITH {_TAGS} SELECT tag, doc_id, place FROM (SELECT tag, tp.doc_id, row_number() OVER (PARTITION BY tag ORDER BY n_chars DESC, tp.doc_id) AS place FROM tp JOIN documents d ON d.doc_id = tp.doc_id) WHERE place <= 10")
def tag_topk(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars", F.array(F.concat_ws("/", "lang", "source")).alias("tags"))
    tags = relations.page_tags(d, "doc_id", F.col("tags"), keep=("n_chars",))
    return relations.first_in_group(tags, "tag", [F.desc("n_chars"), F.col("doc_id")], 10).select("tag", "doc_id", "place")


@query(f"WITH {_TAGS} SELECT DISTINCT tag, CASE WHEN tag IN ('en', 'de') THEN 'Tag page of ' || tag ELSE tag END AS title FROM tp")
def tag_page_override(spark, sf):
    """Two tags have pages of their own; others get the default title."""
    tags = relations.page_tags(_tags(spark, sf), "doc_id", F.col("tags")).select("tag").distinct().withColumn("title", F.col("tag"))
    own = spark.createDataFrame([(t, f"Tag page of {t}") for t in ("en", "de")], "tag string, title string")
    return relations.override(tags, own, "tag", ["title"])


@query(f"WITH {_TAGS} SELECT doc_id, tag FROM tp WHERE NOT starts_with(tag, 'en')")
def tag_exclude(spark, sf):
    return relations.page_tags(_tags(spark, sf), "doc_id", F.filter("tags", lambda t: ~t.startswith("en")))


@query(f"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/]*)', 1) = 'blog.ththan.example.net' AS same_origin FROM pages")
def url_origin(spark, sf):
    host = F.parse_url("url", F.lit("HOST"))
    return read(spark, sf, "pages").select("page_id", host.alias("host"), (host == "blog.ththan.example.net").alias("same_origin"))


@query(f"""WITH {PAGES}, out AS (SELECT DISTINCT slug || '.html' AS file FROM pg), rq AS (SELECT page_id, regexp_replace(regexp_replace({PATH}, '^/', ''), '/$', '') AS bare, ends_with({PATH}, '/') AS folder FROM pages)
SELECT page_id, coalesce(a.file, b.file) AS file FROM (SELECT page_id, CASE WHEN regexp_matches(bare, '\\.[A-Za-z0-9]+$') THEN bare WHEN folder THEN bare || '/index.html' ELSE bare || '.html' END AS f1, CASE WHEN regexp_matches(bare, '\\.[A-Za-z0-9]+$') THEN NULL WHEN folder THEN bare || '.html' ELSE bare || '/index.html' END AS f2 FROM rq) LEFT JOIN out a ON a.file = f1 LEFT JOIN out b ON b.file = f2""")
def request_resolution(spark, sf):
    """Request paths to output files: two candidates, each a left join."""
    out = pages(spark, sf).select(F.concat("slug", F.lit(".html")).alias("file")).distinct()
    path = paths.url_path(F.col("url"))
    rows = read(spark, sf, "pages").select("page_id", paths.output_candidates(path).alias("c"))
    for i in (1, 2):
        rows = rows.join(out.select(F.col("file").alias(f"f{i}")), F.try_element_at("c", F.lit(i)) == F.col(f"f{i}"), "left")
    return rows.select("page_id", F.coalesce("f1", "f2").alias("file"))


_ROOT = "(CASE WHEN len(list_filter(string_split({x}, '/'), lambda s: s <> '')) <= 1 THEN '.' ELSE array_to_string(list_transform(range(len(list_filter(string_split({x}, '/'), lambda s: s <> '')) - 1), lambda i: '..'), '/') END)"


@query(f"WITH {PAGES}, al AS (SELECT DISTINCT slug, lower({sql_sluggify('title')}) AS alias FROM pg) SELECT slug, alias, {_ROOT.format(x='alias')} || '/' || regexp_replace(regexp_replace(slug, '(^|/)index$', '\\1'), '^/', '') AS url FROM al")
def alias_redirects(spark, sf):
    """Each page's title as an alias, and the relative URL that it leads to."""
    rows = pages(spark, sf).select("slug", F.lower(paths.sluggify(F.col("title"))).alias("alias")).distinct()
    return rows.select("slug", "alias", paths.resolve_relative(F.col("alias"), F.col("slug")).alias("url"))


@query(f"""WITH {PAGES}, pp AS (SELECT min(title) AS title, slug FROM pg GROUP BY slug), an AS (SELECT DISTINCT array_to_string(string_split(slug, '/')[1:i], '/') AS folder FROM (SELECT slug, unnest(range(1, len(string_split(slug, '/')))) AS i FROM pp)), tg AS (SELECT slug, split_part(slug, '/', 1) AS tag FROM pp WHERE contains(slug, '/'))
SELECT 'content' AS kind, slug, title, 1::BIGINT AS n FROM pp UNION ALL SELECT 'folder', folder || '/index', regexp_extract(folder, '[^/]*$'), (SELECT count(*) FROM pp WHERE regexp_extract(slug, '^(.*)/[^/]*$', 1) = folder AND NOT regexp_matches(slug, '(^|/)index$')) FROM an WHERE folder <> 'tags'
UNION ALL SELECT 'tag', 'tags/' || tag, tag, count(*) FROM tg GROUP BY tag UNION ALL SELECT 'tags', 'tags/index', 'Tags', count(DISTINCT tag) FROM tg UNION ALL SELECT 'index', 'index', 'Home', count(*) FROM pp HAVING count(*) FILTER (slug = 'index') = 0 UNION ALL SELECT 'lost', '404', 'Not found', 0""")
def page_models(spark, sf):
    """The rows behind all pages of a site; the first folder of a page is its tag."""
    from ..sources import sinks

    p = pages(spark, sf).groupBy("slug").agg(F.min("title").alias("title"))
    tags = p.filter(F.contains("slug", F.lit("/"))).select("slug", F.split_part("slug", F.lit("/"), F.lit(1)).alias("tag"))
    return sinks.page_models(p, tags)


@query(f"WITH {PAGES}, lk AS (SELECT DISTINCT slug AS src, split_part(slug, '/', 1) AS dst FROM pg WHERE contains(slug, '/') UNION SELECT DISTINCT slug, slug FROM pg), tx AS (SELECT slug, min(title) AS preview FROM pg GROUP BY slug) SELECT src, dst, preview FROM lk JOIN tx ON tx.slug = dst")
def link_previews(spark, sf):
    """What a link shows when it is pointed at: each target is read once, however many links lead there."""
    p = pages(spark, sf)
    own = p.select(F.col("slug").alias("src"), F.split_part("slug", F.lit("/"), F.lit(1)).alias("dst")).filter(F.contains("src", F.lit("/")))
    found = own.unionByName(p.select(F.col("slug").alias("src"), F.col("slug").alias("dst"))).distinct()
    return relations.previews(found, p.groupBy("slug").agg(F.min("title").alias("preview")), "preview")
