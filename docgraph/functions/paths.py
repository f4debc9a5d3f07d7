"""Paths, slugs and URLs as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXTENSION = r"\.[A-Za-z0-9]+$"
_FORBIDDEN = r"[ #?&]"


def _ends(path: Column, word: str) -> Column:
    """The path is ``word`` or its last segment is."""
    return path.rlike(rf"(^|/){word}$")


def strip_slashes(path: Column, only_leading: bool = False) -> Column:
    path = F.regexp_replace(path, "^/", "")
    return path if only_leading else F.regexp_replace(path, "/$", "")


def sluggify(path: Column) -> Column:
    """White space to hyphens, & and % spelled out, ? and # dropped, no slash at the end."""
    path = F.regexp_replace(path, r"(?U)\s", "-")
    for char, word in (("&", "-and-"), ("%", "-percent"), ("?", ""), ("#", "")):
        path = F.replace(path, F.lit(char), F.lit(word))
    return F.regexp_replace(path, "/$", "")


def slugify_file_path(path: Column, without_extension: bool = False) -> Column:
    """The slug of a file: pages lose their extension, other files keep it, ``_index`` is ``index``."""
    path = strip_slashes(path)
    extension = F.regexp_extract(path, _EXTENSION, 0)
    page = extension.isin("", ".md", ".html") | F.lit(without_extension)
    slug = F.regexp_replace(sluggify(F.regexp_replace(path, _EXTENSION, "")), "(^|/)_index$", "$1index")
    return F.concat(slug, F.when(page, "").otherwise(extension))


def simplify_slug(slug: Column) -> Column:
    """Without a trailing ``index``; the root is ``/``."""
    slug = strip_slashes(F.regexp_replace(slug, "(^|/)index$", "$1"), only_leading=True)
    return F.when(slug == "", "/").otherwise(slug)


def has_extension(path: Column) -> Column:
    return path.rlike(_EXTENSION)


def is_file_path(path: Column) -> Column:
    return ~path.startswith(".") & has_extension(path)


def is_full_slug(path: Column) -> Column:
    return ~path.rlike(r"^[./]") & ~path.endswith("/") & ~path.rlike(_FORBIDDEN)


def is_simple_slug(path: Column) -> Column:
    bad_start = path.startswith(".") | ((F.length(path) > 1) & path.startswith("/"))
    return ~bad_start & ~_ends(path, "index") & ~path.rlike(_FORBIDDEN) & ~has_extension(path)


def is_relative_url(path: Column) -> Column:
    return path.rlike(r"^\.{1,2}") & ~_ends(path, "index") & ~path.rlike(r"\.(md|html)$")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_to_root(slug: Column) -> Column:
    depth = F.greatest(F.size(segments(slug)) - 1, F.lit(0))
    return F.when(depth == 0, ".").otherwise(F.array_join(F.array_repeat(F.lit(".."), depth), "/"))


def join_segments(*parts: Column) -> Column:
    """Parts joined by single slashes; a slash that starts the first or ends the last part stays."""
    own = F.filter(F.array(*parts), lambda s: ~s.isin("", "/"))
    joined = F.array_join(F.transform(own, lambda s: strip_slashes(s)), "/")
    lead = F.when(parts[0].startswith("/"), "/").otherwise("")
    trail = F.when(parts[-1].endswith("/"), "/").otherwise("")
    return F.concat(lead, joined, trail)


def segment_prefixes(path: Column) -> Column:
    """``a/b/c`` to [a, a/b, a/b/c]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ancestors(path: Column) -> Column:
    """The folders above a path, the nearest last; an empty array at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.slice(segment_prefixes(path), F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def slug_anchor(text: Column) -> Column:
    """A heading's anchor: lower case, letters, digits, hyphens and underscores, blanks as hyphens."""
    return F.replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\- ]", ""), F.lit(" "), F.lit("-"))


def split_anchor(link: Column) -> tuple[Column, Column]:
    """(path, ``#anchor`` or empty); the anchor of a .pdf stays as it is."""
    path = F.substring_index(link, "#", 1)
    raw = F.when(F.contains(link, F.lit("#")), F.expr("0") + F.length(path) + 2)
    rest = F.when(raw.isNull(), F.lit(None)).otherwise(F.substr(link, raw))
    anchor = F.when(rest.isNull() | (rest == ""), "").when(path.endswith(".pdf"), F.concat(F.lit("#"), rest)).otherwise(F.concat(F.lit("#"), slug_anchor(rest)))
    return path, anchor


def is_folder_path(path: Column) -> Column:
    return path.endswith("/") | path.rlike(r"(^|/)index(\.md|\.html)?$")


def transform_internal_link(link: Column) -> Column:
    """A link as written to a relative URL: percent codes read, anchor slugged, page extensions dropped."""
    link = F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B")))
    path, anchor = split_anchor(link)
    own = segments(path)
    dots = F.array_join(F.filter(own, lambda s: s.rlike(r"^\.{1,2}$")), "/")
    rest = F.array_join(F.filter(own, lambda s: ~s.rlike(r"^\.{1,2}$")), "/")
    joined = join_segments(strip_slashes(dots), strip_slashes(simplify_slug(slugify_file_path(rest))))
    relative = F.when(joined == "", ".").when(joined.startswith("."), joined).otherwise(join_segments(F.lit("."), joined))
    return F.concat(relative, F.when(is_folder_path(path), "/").otherwise(""), anchor)


def resolve_relative(here: Column, there: Column) -> Column:
    return join_segments(path_to_root(here), simplify_slug(there))


def resolve_links(links: DataFrame, slugs: DataFrame, strategy: str) -> DataFrame:
    """``links`` (src, target, ...) with ``url``, by strategy ``absolute``, ``shortest`` or ``relative``.

    Shortest: a target that is the last segment of exactly one row of ``slugs`` (slug) leads there; a slug that stands
    twice counts twice.  The lookup is an aggregation and a left join, never a loop over all slugs.
    """
    url = transform_internal_link(F.col("target"))
    if strategy == "relative":
        return links.withColumn("url", url)
    canonical = strip_slashes(F.substr(F.col("_url"), F.lit(2)))
    path, anchor = split_anchor(canonical)
    tail = F.when(F.col("_url").endswith("/") | F.col("_url").rlike("(^|/)index$"), "/").otherwise("")
    absolute = F.concat(join_segments(path_to_root(F.col("src")), canonical), tail)
    links = links.withColumn("_url", url).withColumn("_name", path).withColumn("_anchor", anchor)
    if strategy == "absolute":
        return links.withColumn("url", absolute).drop("_url", "_name", "_anchor")
    unique = slugs.groupBy(basename(F.col("slug")).alias("_name")).agg(F.count("*").alias("_n"), F.min("slug").alias("_hit")).filter("_n = 1").drop("_n")
    found = F.concat(resolve_relative(F.col("src"), F.col("_hit")), F.col("_anchor"))
    return links.join(unique, "_name", "left").withColumn("url", F.when(F.col("_hit").isNotNull(), found).otherwise(absolute)).drop("_url", "_name", "_anchor", "_hit")


def url_path(url: Column) -> Column:
    """A URL's path without the slashes around it."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z][a-z0-9+.\-]*://[^/]*/?", ""), r"[?#].*$", "")


def page_slug(url: Column) -> Column:
    """The slug of a web page from its URL; a URL that ends in a slash is a folder's index."""
    path = url_path(url)
    return F.when(path == "", "index").otherwise(slugify_file_path(F.concat(path, F.when(path.endswith("/"), "index").otherwise(""))))


def output_candidates(path: Column) -> Column:
    """Files that may answer a request, the likeliest first: ``a/`` tries a/index.html, then a.html; ``a`` the other way."""
    bare = strip_slashes(F.regexp_replace(path, r"[?#].*$", ""))
    index, page = join_segments(bare, F.lit("index.html")), F.concat(bare, F.lit(".html"))
    return F.when(has_extension(bare), F.array(bare)).when(path.rlike(r"/([?#]|$)"), F.array(index, page)).otherwise(F.array(page, index))


def rebase(url: Column, here: Column, there: Column) -> Column:
    """A relative URL of the page ``there`` as the page ``here`` has to write it; other URLs stay."""
    return F.when(url.rlike(r"^\.{1,2}/"), join_segments(resolve_relative(here, there), F.lit(".."), url)).otherwise(url)


def canonical(html: Column) -> Column:
    """The address that a redirecting page names, or null."""
    return F.nullif(F.regexp_extract(html, r'<link rel="canonical" href="([^"]*)"', 1), F.lit(""))


def with_relative_start(path: Column) -> Column:
    """A path that begins with a dot: one that doesn't is taken from here."""
    return F.when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), strip_slashes(path, only_leading=True)))


def page_kind(slug: Column) -> Column:
    """article, tag, index or page, by the slug."""
    return F.when(basename(slug).rlike(r"^Article-\d+$"), "article").when(slug.startswith("tags/"), "tag").when(_ends(slug, "index"), "index").otherwise("page")
