"""Links, headings, tags and dialects of Markdown and HTML as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import slug_anchor, sluggify

HREF = r'href="([^"]*)"'
WIKILINK = r"(!?)\[\[([^\[\]\|#\\]*)(#[^\[\]\|\\]*)?(?:\\?\|([^\[\]]*))?\]\]"
#: The dialects' own signs.  A callout is ``[!kind|metadata]`` with - or + for folded; an image's alias ends in ``WxH``;
#: a block's id stands behind ^; Roam writes {{...}}, ^^ and __; ox-hugo writes {{< >}}, {#id} and doubled backslashes.
CALLOUT = r"^>?\s*\[!([\w-]+)\|?(.*?)\]([+-]?)\s*(.*)$"
SIZED = r"^(?:(.*)\|)?(\d+)(?:x(\d+))?$"
HIGHLIGHT, BLOCK = r"==([^=]+)==", r"\^([-_A-Za-z0-9]+)$"
YOUTUBE, PLAYLIST = r"^.*(?:youtu\.be/|v/|u/\w/|embed/|watch\?v=|&v=)([^#&?]*).*", r"[?&]list=([^#?&]*)"
CHECKBOX = r"^\s*[-*+]\s+\[([ xX])\]"
ROAM = (
    (r"\{\{or:(.*?)\}\}", "$1"), (r"\{\{.*?\bTODO\b.*?\}\}", '<input type="checkbox" disabled>'), (r"\{\{.*?\bDONE\b.*?\}\}", '<input type="checkbox" checked disabled>'),
    (r"\{\{.*?\[\[video\]\].*?:(.*?)\}\}", '<video src="$1" controls>'), (r"\{\{.*?\[\[audio\]\].*?:(.*?)\}\}", '<audio src="$1" controls>'),
    (r"\{\{.*?\[\[pdf\]\].*?:(.*?)\}\}", '<embed src="$1">'), (r"(?m)^\[\[>\]\]\s*(.*)$", "<blockquote>$1</blockquote>"), (r"\^\^(.+?)\^\^", "<mark>$1</mark>"), (r"__(.+?)__", "<em>$1</em>"),
)
OXHUGO = (
    (r"\[([^\]]+)\]\(\{\{< relref \"([^\"]+)\" >\}\}\)", "[$1]($2)"), (r"(?m)^(.*)\{#[^}]*\}$", "$1"), (r'<figure src="(.*)">', "![]($1)"), (r'\{\{<\s*figure src="([^"]*)"[^>]*>\}\}', "![]($1)"),
    (r"\\\\\((.+?)\\\\\)", "\\$$1\\$"), (r"(?s)(?:\\begin\{equation\}|\\\\\[)(.+?)(?:\\\\\]|\\end\{equation\})", "\\$\\$$1\\$\\$"), (r"\{\{<[^>]*>\}\}", ""),
)
MATH = r"(?s)\$\$?.+?\$\$?"
CODE = r"(?s)```.*?```|`[^`\n]*`"

_TAG = r"(?:^|[\s])#((?:[-_\p{L}\p{M}\p{N}\x{1F300}-\x{1FAFF}]+)(?:/[-_\p{L}\p{M}\p{N}\x{1F300}-\x{1FAFF}]+)*)"

#: Other names of callouts.
CALLOUTS = {
    "note": "note", "abstract": "abstract", "summary": "abstract", "tldr": "abstract", "info": "info", "todo": "todo",
    "tip": "tip", "hint": "tip", "important": "tip", "success": "success", "check": "success", "done": "success",
    "question": "question", "help": "question", "faq": "question", "warning": "warning", "attention": "warning", "caution": "warning",
    "failure": "failure", "missing": "failure", "fail": "failure", "danger": "danger", "error": "danger", "bug": "bug",
    "example": "example", "quote": "quote", "cite": "quote",
}

#: Arrows and their entities, longest first.
ARROWS = (("<==>", "&hArr;"), ("-->", "&rArr;"), ("==>", "&rArr;"), ("=>", "&rArr;"), ("<--", "&lArr;"), ("<==", "&lArr;"), ("->", "&rarr;"), ("<-", "&larr;"))

#: What a file's extension embeds as.
EMBEDS = {
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp"),
    "video": (".mp4", ".webm", ".ogv", ".mov", ".mkv"),
    "audio": (".mp3", ".wav", ".m4a", ".ogg", ".3gp", ".flac"),
    "pdf": (".pdf",),
}


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def link_kind(href: Column) -> Column:
    return F.when(href.startswith("#"), "anchor").when(href.rlike(r"^([a-z][a-z0-9+.\-]*:|//)"), "external").otherwise("internal")


def embed_kind(target: Column) -> Column:
    extension = F.lower(F.regexp_extract(target, r"\.[A-Za-z0-9]+$", 0))
    out = F.when(F.lit(False), "")
    for kind, names in EMBEDS.items():
        out = out.when(extension.isin(*names), kind)
    return out.otherwise("transclude")


def wikilinks(text: Column) -> Column:
    """An array of structs: embed, name, heading and alias of each wikilink."""
    whole = F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(0))
    return F.transform(
        whole,
        lambda w: F.struct(
            w.startswith("!").alias("embed"), F.trim(F.regexp_extract(w, WIKILINK, 2)).alias("name"), F.regexp_extract(w, WIKILINK, 3).alias("heading"), F.regexp_extract(w, WIKILINK, 4).alias("alias")
        ),
    )


def embed_size(alias: Column) -> Column:
    """(alt, width, height) of an image's alias such as ``100x50`` or ``logo|100x50``; ``auto`` where it has no size, and then all of it is alt."""
    sized = alias.rlike(SIZED)
    side = lambda k: F.coalesce(F.nullif(F.regexp_extract(alias, SIZED, k), F.lit("")), F.lit("auto"))
    return F.struct(F.when(sized, F.regexp_extract(alias, SIZED, 1)).otherwise(alias).alias("alt"), side(2).alias("width"), side(3).alias("height"))


def callout(line: Column) -> Column:
    """Kind, metadata, fold and title of a callout's first line; a kind of null where there is none."""
    kind = F.lower(F.regexp_extract(line, CALLOUT, 1))
    names = F.create_map(*[F.lit(x) for pair in CALLOUTS.items() for x in pair])
    return F.struct(
        F.when(kind != "", F.coalesce(F.try_element_at(names, kind), kind)).alias("kind"),
        F.regexp_extract(line, CALLOUT, 2).alias("metadata"),
        F.regexp_extract(line, CALLOUT, 3).alias("fold"),
        F.trim(F.regexp_extract(line, CALLOUT, 4)).alias("title"),
    )


def slug_tag(tag: Column) -> Column:
    """A tag with each of its segments slugged."""
    return F.array_join(F.transform(F.split(tag, "/"), sluggify), "/")


def inline_tags(text: Column) -> Column:
    """Distinct slugged tags; those of digits and slashes alone are none."""
    found = F.regexp_extract_all(text, F.lit(_TAG), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda t: ~t.rlike(r"^[/\d]+$")), slug_tag))


def highlights(text: Column) -> Column:
    return F.regexp_replace(text, HIGHLIGHT, '<span class="text-highlight">$1</span>')


def arrows(text: Column) -> Column:
    for sign, entity in ARROWS:
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def block_id(paragraph: Column) -> Column:
    return F.regexp_extract(paragraph, BLOCK, 1)


def youtube_id(url: Column) -> Column:
    found = F.regexp_extract(url, YOUTUBE, 1)
    return F.when(F.length(found) == 11, found)


def youtube_playlist(url: Column) -> Column:
    """The list that a video's address names, or null."""
    return F.nullif(F.regexp_extract(url, PLAYLIST, 1), F.lit(""))


def has_mermaid(text: Column) -> Column:
    """Whether a fenced block is a diagram."""
    return text.rlike(r"(?m)^\s*```mermaid\s*$")


def checkbox(item: Column) -> Column:
    mark = F.regexp_extract(item, CHECKBOX, 1)
    return F.when(mark != "", F.lower(mark) == "x")


def outside(text: Column, pattern: str, rewrite) -> Column:
    """``rewrite`` on the parts of a text between the matches of ``pattern``, which stay as they are."""
    gaps, kept = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(rewrite(g), F.coalesce(F.get(kept, i), F.lit("")))), "")


def inside(text: Column, pattern: str, rewrite) -> Column:
    """``rewrite`` on the matches of ``pattern``; what is between stays."""
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(rewrite(F.get(found, i)), F.lit("")))), "")


def _replaced(text: Column, rules) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def roam(text: Column) -> Column:
    """The Roam dialect: choices, to-dos, embeds, quotes, highlights and italics; code stays as it is."""
    return outside(text, CODE, lambda t: _replaced(t, ROAM))


def oxhugo(text: Column) -> Column:
    """The ox-hugo dialect: references, heading ids, short codes, figures and math, in which an escaped underscore loses its escape; code stays as it is."""
    return outside(text, CODE, lambda t: inside(_replaced(t, OXHUGO), MATH, lambda m: F.replace(m, F.lit("\\_"), F.lit("_"))))


def pretty_text(text: Column, href: Column) -> Column:
    """(text, kind) of a link: what is written as its own path shows the last segment; other wording is an alias and stays."""
    bare = F.regexp_replace(href, "#.*$", "")
    own = text == href
    short = F.when(link_kind(href) == "internal", F.coalesce(F.nullif(F.element_at(F.split(bare, "/"), -1), F.lit("")), text)).otherwise(text)
    return F.struct(F.when(own, short).otherwise(text).alias("text"), F.when(own, link_kind(href)).otherwise(F.concat(F.lit("alias "), link_kind(href))).alias("kind"))


def markdown_headings(text: Column) -> Column:
    """Depth and text of each heading, in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})[ \t]+(.*)$"), F.lit(0))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("depth"), F.trim(F.regexp_extract(x, r"^#+\s+(.*)$", 1)).alias("text")))


def html_headings(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?s)<h([1-6])[^>]*>(.*?)</h\1>"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substring(x, 3, 1).cast("int").alias("depth"), F.trim(F.regexp_replace(x, "(?s)<[^>]*>", "")).alias("text")))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1))


def toc(pages: DataFrame, key: str, headings: Column, max_depth: int = 3, least: int = 2) -> DataFrame:
    """key, pos, depth (relative to the page's least), text and slug (repeats numbered) of each heading.

    Pages with fewer than ``least`` headings have none.
    """
    rows = pages.select(key, F.posexplode(headings).alias("pos", "h")).select(key, "pos", "h.depth", "h.text").filter(F.col("depth") <= max_depth)
    page, same = Window.partitionBy(key), Window.partitionBy(key, "base").orderBy("pos")
    rows = rows.withColumn("base", slug_anchor(F.col("text"))).withColumn("again", F.row_number().over(same) - 1)
    rows = rows.withColumn("n", F.count("*").over(page)).withColumn("top", F.min("depth").over(page)).filter(F.col("n") >= least)
    slug = F.when(F.col("again") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("again").cast("string")))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), (F.col("depth") - F.col("top")).cast("long").alias("depth"), "text", slug.alias("slug"))


def blocks(text: Column) -> Column:
    """Paragraphs in order."""
    return F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(p) != "")


def block_table(pages: DataFrame, key: str, text: Column) -> DataFrame:
    """key, id and paragraph of each block reference; a reference alone stands for the paragraph before; the first of an id wins."""
    rows = pages.select(key, F.posexplode(blocks(text)).alias("pos", "paragraph"))
    order = Window.partitionBy(key).orderBy("pos")
    bare = F.trim(F.regexp_replace("paragraph", r"\s*\^[-_A-Za-z0-9]+$", ""))
    rows = rows.withColumn("id", block_id(F.trim(F.col("paragraph")))).withColumn("own", F.when(bare != "", bare))
    rows = rows.withColumn("before", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.filter("id <> ''").withColumn("place", F.row_number().over(Window.partitionBy(key, "id").orderBy("pos")))
    return rows.filter("place = 1").select(key, "id", F.coalesce("own", "before").alias("paragraph"))


def section(pages: DataFrame, key: str, rows_of: DataFrame) -> DataFrame:
    """For lines (key, pos, depth or null, slug or null): each heading's section, up to the next heading as high.

    The end is the least later place of a heading that is as high, found per depth by windows instead of a self-join.
    """
    later = Window.partitionBy(key).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("depth") <= d, F.col("pos"))).over(later) for d in range(1, 7)]
    end = F.when(F.lit(False), F.lit(None))
    for d, e in enumerate(ends, 1):
        end = end.when(F.col("depth") == d, e)
    last = F.max("pos").over(Window.partitionBy(key))
    return rows_of.withColumn("end", F.coalesce(end, last + 1)).filter("depth is not null").select(key, "slug", "depth", F.col("pos").alias("start"), "end")
