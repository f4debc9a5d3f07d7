"""Queries on Markdown that the tables lack: it is made of their keys and words, as each docstring says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators.relations import transclude
from ..sources import vault
from .tables import query, read


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_custkey ELSE c_name END AS title, 'lang/' || lower(c_mktsegment) || ', seg' AS tags, c_custkey % 3 = 0 AS draft, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') END AS created, 'Body ' || c_custkey AS body FROM customer")
def frontmatter_parse(spark, sf):
    """Files of front matter made of customers, parsed as a vault is."""
    s, k = (lambda c: c.cast("string")), F.col("c_custkey")
    title = F.when(k % 4 != 0, F.concat(F.lit('title: "'), "c_name", F.lit('"\n'))).otherwise("")
    date = F.when(k % 5 != 0, F.concat(F.lit("date: 2024-01-"), F.lpad(s(k % 28 + 1), 2, "0"), F.lit("\n"))).otherwise("date: \n")
    tags = F.when(k % 2 == 0, F.concat(F.lit("tags:\n  - lang/"), F.lower("c_mktsegment"), F.lit("\n  - seg\n"))).otherwise(F.concat(F.lit("tags: [lang/"), F.lower("c_mktsegment"), F.lit(", seg]\n")))
    value = F.concat(F.lit("---\n"), title, date, tags, F.when(k % 3 == 0, "draft: true\n").otherwise(""), F.lit("---\nBody "), s(k))
    files = read(spark, sf, "customer").select(F.concat(F.lit("c"), s(k), F.lit(".md")).alias("path"), value.alias("value"), F.lit(None).cast("timestamp").alias("modified"))
    p = vault.pages(files)
    return p.select(F.substr("slug", F.lit(2)).cast("long").alias("id"), "title", F.array_join("tags", ", ").alias("tags"), (F.coalesce("draft", F.lit("")) == "true").alias("draft"), F.date_format("dates.created", "yyyy-MM-dd").alias("created"), "body")


def _notes(spark, sf):
    """A note for each order, with links, tags, callouts and blocks."""
    s, k = (lambda c: c.cast("string")), F.col("o_orderkey")
    body = F.concat(
        F.lit("Links to [[Order "), s(k + 1), F.lit("|the next]], [[Order "), s(k + 2), F.lit("#Part "), s(k % 7), F.lit("]] and ![[pic"), s(k % 9), F.lit(".png|100x50]].\n\n> [!"),
        F.when(k % 3 == 0, "Caution").when(k % 3 == 1, "tldr").otherwise("my-own"), F.lit("]- About "), s(k), F.lit("\n\nTagged #lang/"), F.lower("o_orderstatus"), F.lit(" and #"), s(k % 100), F.lit(" too.\n\nA block ^b"), s(k % 2), F.lit("\n\n^alone"),
    )
    return read(spark, sf, "orders").select(k.alias("id"), body.alias("body"), "o_orderstatus")


@query("SELECT o_orderkey AS id, pos::BIGINT AS pos, CASE pos WHEN 0 THEN 'Order ' || o_orderkey + 1 WHEN 1 THEN 'Order ' || o_orderkey + 2 ELSE 'pic' || o_orderkey % 9 || '.png' END AS name, CASE WHEN pos = 1 THEN '#Part ' || o_orderkey % 7 ELSE '' END AS heading, CASE pos WHEN 0 THEN 'the next' WHEN 1 THEN '' ELSE '100x50' END AS alias, pos = 2 AS embed FROM orders, (VALUES (0), (1), (2)) t(pos)")
def wikilink_parse(spark, sf):
    rows = _notes(spark, sf).select("id", F.posexplode(markup.wikilinks(F.col("body"))).alias("pos", "w"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "w.name", "w.heading", "w.alias", "w.embed")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'abstract' ELSE 'my-own' END AS kind, '-' AS fold, 'About ' || o_orderkey AS title FROM orders")
def callout_parse(spark, sf):
    line = F.element_at(F.split("body", "\n\n"), 2)
    return _notes(spark, sf).select("id", markup.callout(line).alias("c")).select("id", "c.kind", "c.fold", "c.title")


@query("SELECT o_orderkey AS id, 'lang/' || lower(o_orderstatus) AS tags FROM orders")
def inline_tags(spark, sf):
    return _notes(spark, sf).select("id", F.array_join(markup.inline_tags(F.col("body")), "|").alias("tags"))


@query("SELECT o_orderkey AS id, b.block, 'A block' AS paragraph FROM orders, LATERAL (SELECT 'b' || o_orderkey % 2 AS block UNION ALL SELECT 'alone') b")
def block_references(spark, sf):
    notes = _notes(spark, sf).withColumnRenamed("id", "note")
    return markup.block_table(notes, "note", F.col("body")).select(F.col("note").alias("id"), F.col("id").alias("block"), "paragraph")


@query("SELECT o_orderkey AS src, CASE o_orderkey % 4 WHEN 0 THEN 'A block' WHEN 1 THEN 'whole ' || o_orderkey + 1 WHEN 2 THEN 'Under ' || o_orderkey + 1 END AS content FROM orders WHERE o_orderkey + 1 IN (SELECT o_orderkey FROM orders)")
def transclusion(spark, sf):
    """Each order embeds the next one: a block, the whole, a heading's section, or a block that isn't there."""
    o = read(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    body = F.concat(F.lit("whole "), k.cast("string"))
    blocks, sections = F.create_map(F.lit("b0"), F.lit("A block")), F.create_map(F.lit("part-one"), F.concat(F.lit("Under "), k.cast("string")))
    pages = o.select(k.cast("string").alias("slug"), body.alias("text"), blocks.alias("blocks"), sections.alias("sections"))
    block = F.when(k % 4 == 0, "^b0").when(k % 4 == 1, "").when(k % 4 == 2, "#part-one").otherwise("lost")
    embeds = o.join(o.select((k - 1).alias("o_orderkey")), "o_orderkey").select(k.alias("src"), F.lit(0).alias("pos"), (k + 1).cast("string").alias("target"), block.alias("block"))
    return transclude(embeds, pages).select("src", "content")


@query("SELECT o_orderkey AS id, 'a <mark>' || o_orderkey || '</mark> <em>b</em> <input type=\"checkbox\" disabled> x `__code__`' || chr(10) || '<blockquote>said ' || o_custkey || '</blockquote>' AS body FROM orders")
def roam_rewrite(spark, sf):
    s = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("a ^^"), s, F.lit("^^ __b__ {{[[TODO]]}} {{or:x}} `__code__`\n[[>]] said "), F.col("o_custkey").cast("string"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), markup.roam(body).alias("body"))


@query("SELECT o_orderkey AS id, '[to](p' || o_orderkey || ') and ![](f.png) $a_' || o_custkey || '$ $$x_1' || chr(10) || 'y$$ but b\\_c and `<figure src=\"g.png\">`' AS body FROM orders")
def oxhugo_rewrite(spark, sf):
    s = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('[to]({{< relref "p'), s, F.lit('" >}}) and {{< figure src="f.png" >}} $a\\_'), F.col("o_custkey").cast("string"), F.lit('$ \\\\[x\\_1\ny\\\\] but b\\_c and `<figure src="g.png">`'))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), markup.oxhugo(body).alias("body"))


@query("SELECT p_partkey AS id, 'a &rarr; b <span class=\"text-highlight\">' || p_name || '</span> &hArr;' AS body FROM part")
def inline_rewrites(spark, sf):
    body = markup.highlights(markup.arrows(F.concat(F.lit("a -> b =="), "p_name", F.lit("== <==>"))))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), body.alias("body"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN lpad(p_partkey::VARCHAR, 11, 'x') END AS video, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS done, CASE WHEN p_partkey % 5 = 0 THEN 'PL' || p_partkey END AS playlist, p_partkey % 4 = 0 AS mermaid FROM part")
def youtube_checkbox(spark, sf):
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), F.when(k % 2 == 0, F.lpad(k.cast("string"), 11, "x")).otherwise("short"), F.when(k % 5 == 0, F.concat(F.lit("&list=PL"), k.cast("string"), F.lit("&index=2"))).otherwise(""))
    body = F.when(k % 4 == 0, "text\n```mermaid\ngraph\n```").otherwise("```js\nmermaid\n```")
    item = F.when(k % 3 == 0, "- [x] done").when(k % 3 == 1, "- [ ] open").otherwise("- plain")
    return read(spark, sf, "part").select(k.alias("id"), markup.youtube_id(url).alias("video"), markup.checkbox(item).alias("done"), markup.youtube_playlist(url).alias("playlist"), markup.has_mermaid(body).alias("mermaid"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'logo' WHEN p_size % 2 = 0 THEN '' ELSE 'alt text' END AS alt, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'auto' END AS width, CASE WHEN p_size % 4 = 0 THEN '7' ELSE 'auto' END AS height FROM part")
def embed_sizes(spark, sf):
    k = F.col("p_size")
    alias = F.when(k % 4 == 0, F.concat(F.lit("logo|"), k.cast("string"), F.lit("x7"))).when(k % 2 == 0, k.cast("string")).otherwise("alt text")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), markup.embed_size(alias).alias("e")).select("id", "e.alt", "e.width", "e.height")


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS yaml FROM nation")
def fenced_blocks(spark, sf):
    k = F.col("n_nationkey")
    body = F.when(k % 2 == 0, F.concat(F.lit("x\n```yaml\n"), "n_name", F.lit("\n```\ny"))).otherwise("none")
    return read(spark, sf, "nation").select(k.cast("long").alias("id"), vault.fenced(body).alias("yaml"))

