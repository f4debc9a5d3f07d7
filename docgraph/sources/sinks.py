"""Sinks: indexes, feeds, reports and manifests as relations, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, resolve_relative, slugify_file_path
from ..functions.text import escape_html, rss_date
from ..operators.relations import folder_children, folders, numbered
from .vault import split_front


def content_index(pages: DataFrame, with_empty: bool = False) -> DataFrame:
    """slug, title, links, tags and content of pages that have text."""
    rows = pages.select("slug", "title", "links", "tags", "content")
    return rows if with_empty else rows.filter("content <> ''")


def index_lines(index: DataFrame) -> DataFrame:
    """One JSON object a page, keyed by slug: the distributed form of the index."""
    page = F.struct("title", "links", "tags", "content")
    return index.select(F.to_json(F.create_map(F.col("slug"), page)).alias("value"))


def sitemap_rows(pages: DataFrame, base: str) -> DataFrame:
    """slug and its entry."""
    when = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit(""))
    return pages.select("slug", F.concat(F.lit(f"<url><loc>https://{base}/"), "slug", F.lit("</loc><lastmod>"), when, F.lit("</lastmod></url>")).alias("entry"))


def rss_items(pages: DataFrame, base: str, most: int = 10) -> DataFrame:
    """The newest pages as items, in order of ``place``."""
    top = pages.orderBy(F.col("date").desc_nulls_last(), F.lower("title"), "slug").limit(most)
    place = F.row_number().over(Window.orderBy(F.col("date").desc_nulls_last(), F.lower("title"), "slug"))  # of ``most`` rows
    item = F.concat(F.lit("<item><title>"), escape_html(F.col("title")), F.lit(f"</title><link>https://{base}/"), "slug", F.lit("</link><pubDate>"), F.coalesce(rss_date(F.col("date")), F.lit("")), F.lit("</pubDate></item>"))
    return top.select(place.cast("long").alias("place"), "slug", item.alias("item"))


def alias_redirects(pages: DataFrame) -> DataFrame:
    """alias and the relative URL it leads to."""
    return pages.select("slug", F.explode("aliases").alias("alias")).select("alias", resolve_relative(F.col("alias"), F.col("slug")).alias("url"))


def asset_manifest(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("source"), slugify_file_path(F.col("path")).alias("destination"))


def host(base: Column) -> Column:
    return F.parse_url(F.concat(F.lit("https://"), base), F.lit("HOST"))


CHUNK_ITEMS = 1000  #: items of a line of a report


def grouped_lines(rows: DataFrame, group: str, item: str, chunk: int = CHUNK_ITEMS) -> DataFrame:
    """group, part, items and n: a report's lines, each with at most ``chunk`` of the group's distinct items, joined in order of their text.

    Items are numbered within their group by ranges, so a group of any size is spread over tasks and lines; a sink writes the parts
    of a group one after another.
    """
    each = rows.select(group, F.col(item).cast("string").alias("_item")).distinct()
    placed = numbered(each, group, [F.col("_item")], "_place").withColumn("part", F.floor((F.col("_place") - 1) / F.lit(chunk)).cast("long"))
    lines = placed.groupBy(group, "part").agg(F.array_sort(F.collect_list("_item")).alias("_all"))
    return lines.select(group, "part", F.array_join("_all", ", ").alias("items"), F.size("_all").cast("long").alias("n"))


def splice(text: Column, heading: str, section: Column) -> Column:
    """The text with the section under ``heading`` replaced, or put at the end."""
    pattern = rf"(?s)(^|\n){heading}\n.*?(?=\n## |\z)"
    return F.when(text.rlike(pattern), F.regexp_replace(text, F.lit(pattern), F.concat(F.lit(f"$1{heading}\n"), section))).otherwise(F.concat(text, F.lit(f"\n{heading}\n"), section))


def last_writer_wins(outputs: DataFrame, key: str, order: str) -> DataFrame:
    """Of outputs to one place the one that would be written last."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return outputs.withColumn("_place", place).filter("_place = 1").drop("_place")


def orphaned(outputs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Outputs that nothing produces any more."""
    return outputs.join(wanted.select(key).distinct(), key, "left_anti")


def changed_rows(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """A change log of a copy-on-write rewrite: rows whose value differs."""
    old = before.select(key, F.col(value).alias("before"))
    return after.select(key, F.col(value).alias("after")).join(old, key).filter(~F.col("before").eqNullSafe(F.col("after")))


def rewrites(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """What a rewrite in place would write, as a new dataset: each changed row under its key, and what it was under the key with ``.backup``."""
    log = changed_rows(before, after, key, value)
    backup = log.select(F.concat(key, F.lit(".backup")).alias(key), F.col("before").alias(value))
    return log.select(key, F.col("after").alias(value)).unionByName(backup)


def write_pages(pages: DataFrame, folder: str) -> None:
    """One folder a page (slug, value), named by its slug; missing folders are made."""
    pages.select("slug", "value").write.partitionBy("slug").option("lineSep", "\n").text(folder)


def front_dump(files: DataFrame) -> DataFrame:
    """path and entry: the front matter of every file that has some, under its path."""
    front, _ = split_front(F.col("value"))
    return files.select("path", front.alias("_front")).filter("_front <> ''").select("path", F.concat(F.lit("## "), "path", F.lit("\n"), "_front").alias("entry"))


def page_models(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """(kind, slug, title, n): the rows behind every page that a site has.

    ``pages`` has slug and title, ``tags`` slug and tag.  A content page is itself; folders count what is directly in them, tags their pages; one
    page lists all tags, one is the root's if no page is, and one says that nothing was found.
    """
    row = lambda kind, slug, title, n: (F.lit(kind).alias("kind"), slug.alias("slug"), title.alias("title"), n.cast("long").alias("n"))
    content = pages.select(*row("content", F.col("slug"), F.col("title"), F.lit(1)))
    inside = folder_children(pages).groupBy("folder").agg(F.count("*").alias("n"))
    folder = folders(pages).join(inside, "folder", "left").select(*row("folder", F.concat("folder", F.lit("/index")), basename(F.col("folder")), F.coalesce("n", F.lit(0))))
    counted = tags.groupBy("tag").agg(F.countDistinct("slug").alias("n"))
    tag = counted.select(*row("tag", F.concat(F.lit("tags/"), "tag"), F.col("tag"), F.col("n")))
    listing = counted.agg(F.count("*").alias("n")).select(*row("tags", F.lit("tags/index"), F.lit("Tags"), F.col("n")))
    root = pages.agg(F.count_if(F.col("slug") == "index").alias("own"), F.count("*").alias("n")).filter("own = 0").select(*row("index", F.lit("index"), F.lit("Home"), F.col("n")))
    lost = pages.sparkSession.range(1).select(*row("lost", F.lit("404"), F.lit("Not found"), F.lit(0)))
    out = content
    for part in (folder, tag, listing, root, lost):
        out = out.unionByName(part)
    return out
