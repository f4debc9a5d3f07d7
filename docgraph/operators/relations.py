"""Relations between pages: links, tags, folders, transclusion and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, parent, segment_prefixes
from .tables import written


def edges(pages: DataFrame, key: str, links: Column) -> DataFrame:
    """Distinct (src, dst) from an array of targets."""
    return pages.select(F.col(key).alias("src"), F.explode(F.array_distinct(links)).alias("dst"))


def backlinks(links: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """(dst, src) of links to pages (slug); with ``most``, the first referrers of each page and their place."""
    found = links.join(pages.select(F.col("slug").alias("dst")).distinct(), "dst", "left_semi").select("dst", "src").distinct()
    if most is None:
        return found
    place = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    return found.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def backlink_counts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """slug and n for every page, 0 where nothing links to it."""
    n = links.distinct().groupBy("dst").agg(F.count("*").alias("n"))
    return pages.select("slug").distinct().join(n, F.col("slug") == F.col("dst"), "left").select("slug", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def valid_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return links.join(nodes.select(F.col("slug").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def dangling_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets that no page has, with how many pages link there."""
    lost = links.join(nodes.select(F.col("slug").alias("dst")).distinct(), "dst", "left_anti")
    return lost.groupBy("dst").agg(F.countDistinct("src").alias("n"))


def neighbourhood_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links with both ends in ``members`` (node)."""
    for end in ("src", "dst"):
        links = links.join(members.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return links.select("src", "dst")


def page_tags(pages: DataFrame, key: str, tags: Column, hierarchical: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (key, tag) with the columns ``keep``; a nested tag also counts as those it is nested in."""
    names = F.flatten(F.transform(tags, segment_prefixes)) if hierarchical else tags
    return pages.select(key, F.explode(F.array_distinct(names)).alias("tag"), *keep).distinct()


def first_in_group(rows: DataFrame, group: str, order: list[Column], most: int, place: str = "place") -> DataFrame:
    """The first rows of each group, numbered from 1 (planned as a window group limit)."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col(place) <= most)


def numbered(rows: DataFrame, group: str, order: list[Column], place: str = "place") -> DataFrame:
    """Every row's number within its group, from 1, without a task that holds a whole group.

    Rows are dealt by ranges of (group, order), written with their range's number, and numbered within (range, group); the
    rows of earlier ranges are added, of which there are at most as many counts as ranges and groups.
    """
    dealt = written(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    size = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    found = dealt.withColumn(place, own.cast("long")).join(size, (F.col(group).eqNullSafe(F.col("_group"))) & (F.col("_range") == F.col("_at")))
    return found.withColumn(place, F.col(place) + F.col("_before")).select(*rows.columns, place)


def folder_dates(pages: DataFrame) -> DataFrame:
    """folder, date and n for the folders that hold pages (slug, date, title): the date of the first page under the order of lists."""
    below = pages.select(F.explode(ancestors(F.col("slug"))).alias("folder"), "slug", "date", "title")
    return below.groupBy("folder").agg(F.max("date").alias("date"), F.count("*").alias("n"))


def is_case_page(slug: Column, folder: Column) -> Column:
    """Pages of the case-law folder, by their slug or by the folder that they name."""
    return F.lower(slug).startswith("case-law/") | F.coalesce(F.lower(folder).isin("case law", "case-law"), F.lit(False))


def with_alias_slugs(pages: DataFrame) -> DataFrame:
    """Every slug that names may mean: pages (slug, aliases) and their aliases, repeats and all, as repeats tell that a name is not unique."""
    return pages.select("slug").unionByName(pages.select(F.explode("aliases").alias("slug")))


def override(defaults: DataFrame, own: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``defaults`` with the columns that ``own`` knows better."""
    better = own.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = defaults.join(better, key, "left")
    return out.select(*[c for c in defaults.columns if c not in columns], *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def folders(pages: DataFrame) -> DataFrame:
    """Distinct ancestor folders of pages (slug); the root and ``tags`` are none."""
    return pages.select(F.explode(ancestors(F.col("slug"))).alias("folder")).filter(~F.col("folder").isin("", ".", "tags")).distinct()


def folder_children(pages: DataFrame) -> DataFrame:
    """(folder, slug) of pages directly within a folder, by whole segments; a folder's index page isn't its own child."""
    return pages.select(parent(F.col("slug")).alias("folder"), "slug").filter((F.col("folder") != "") & (basename(F.col("slug")) != "index"))


def missing_indexes(pages: DataFrame) -> DataFrame:
    """A row for each folder without an index page."""
    slug = F.concat("folder", F.lit("/index"))
    return folders(pages).withColumn("slug", slug).join(pages.select("slug").distinct(), "slug", "left_anti").select("folder", "slug")


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """slug, pos and label of each ancestor: its index page's title, unless that is ``index``, else its name with blanks."""
    crumbs = pages.select("slug", F.posexplode(ancestors(F.col("slug"))).alias("pos", "folder"))
    titles = pages.select(F.col("slug").alias("_index"), F.col("title").alias("_title"))
    named = crumbs.join(titles, F.concat("folder", F.lit("/index")) == F.col("_index"), "left")
    own = F.when(F.lower("_title") != "index", F.col("_title"))
    return named.select("slug", F.col("pos").cast("long").alias("pos"), "folder", F.coalesce(own, F.replace(basename(F.col("folder")), F.lit("-"), F.lit(" "))).alias("label"))


def transclude(embeds: DataFrame, pages: DataFrame) -> DataFrame:
    """embeds (src, pos, target, block) with ``content``: the block of that id, a heading's section, else the whole page; null where unresolved.

    ``pages`` has slug, text and blocks (a map from id to paragraph), and may have sections (a map from a heading's slug to its
    text).  A block is named ``^id`` or ``id``, a heading ``#slug``.
    """
    has = "sections" in pages.columns
    found = embeds.join(pages.select(F.col("slug").alias("target"), "text", "blocks", *(["sections"] if has else [])), "target", "left")
    name = F.coalesce("block", F.lit(""))
    content = F.when(name == "", F.col("text"))
    if has:
        content = content.when(name.startswith("#"), F.try_element_at("sections", F.substr(name, F.lit(2))))
    content = content.otherwise(F.try_element_at("blocks", F.regexp_replace(name, r"^\^", "")))
    return found.select("src", "pos", "target", "block", content.alias("content"))


def by_date_and_title(date: str = "date", title: str = "title", key: str = "slug") -> list[Column]:
    """The order of lists: newest first, undated last and by title; the key breaks ties."""
    return [F.col(date).desc_nulls_last(), F.lower(title), F.col(key)]


def theta_matches(left: DataFrame, right: DataFrame, numbers_left: Column, number_right: str) -> DataFrame:
    """Rows that name a number, as an equi join on the numbers extracted, not a regex for each pair."""
    return left.withColumn(number_right, F.explode(numbers_left)).join(right, number_right)


def rules_for(rulings: DataFrame, key: str, points: Column, number: Column) -> DataFrame:
    """key, article, place and rule: the points that name an article, in their order.

    ``number`` is an array of the articles of a point as a function of rule.
    """
    each = rulings.select(key, F.posexplode(points).alias("pos", "rule"))
    named = each.withColumn("article", F.explode(number))
    place = F.row_number().over(Window.partitionBy(key, "article").orderBy("pos"))
    return named.select(key, "article", place.cast("long").alias("place"), "rule")


def rules_or_first(rulings: DataFrame, key: str, points: Column, number: Column, wanted: DataFrame, mentioned: Column) -> DataFrame:
    """key, article, rule for each row of ``wanted`` (key, article): the points that name the article; failing those, the first point if the whole ruling mentions it.

    ``mentioned`` is an array of the articles that a whole ruling mentions.  An article that it doesn't mention has no rule.
    """
    named = rules_for(rulings, key, points, number).select(key, "article", "rule")
    whole = rulings.select(key, F.get(points, F.lit(0)).alias("_first"), mentioned.alias("_mentioned"))
    asked = wanted.join(named, [key, "article"], "left").join(whole, key)
    rule = F.coalesce("rule", F.when(F.array_contains("_mentioned", F.col("article")), F.col("_first")))
    return asked.select(key, "article", rule.alias("rule")).filter("rule is not null")


def rollup_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by both columns, by the outer, and of all; what is summed over is null."""
    return rows.rollup(outer, inner).agg(F.count("*").alias("n"))


def ordered_union(*hits: DataFrame) -> DataFrame:
    """(id, prio, rank): rows of ranked lists (id, rank), each id once, at its first list and best rank there."""
    both = None
    for prio, h in enumerate(hits):
        rows = h.select("id", F.lit(prio).cast("long").alias("prio"), F.col("rank").cast("long").alias("rank"))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy("id").agg(F.min(F.struct("prio", "rank")).alias("k")).select("id", "k.prio", "k.rank")


def with_member(rows: DataFrame, key: str, member: str, **values) -> DataFrame:
    """Rows with one that is always there, with the given values unless it is among them."""
    own = rows.sparkSession.range(1).select(*[F.lit(member if c == key else values[c]).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(own.join(rows.select(key), key, "left_anti"))


def with_records(links: DataFrame, records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Links (src, dst) with columns of the records of both ends, as src_... and dst_..."""
    for end in ("src", "dst"):
        links = links.join(records.select(F.col(key).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end, "left")
    return links


def previews(links: DataFrame, pages: DataFrame, column: str) -> DataFrame:
    """Links (src, dst) to pages (slug) with a column of theirs; only pages that are linked are joined, each once."""
    linked = pages.select(F.col("slug").alias("dst"), column).join(links.select("dst").distinct(), "dst", "left_semi")
    return links.join(linked, "dst").select("src", "dst", column)
