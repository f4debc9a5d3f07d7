"""References to articles in legal text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKETED = r"\[\[Article (\d+)"
PLAIN = r"(?:^|[^\[])Article (\d+)(?:\(| of)"
EITHER = r"Article\s+(\d+)"


def numbers(text: Column, pattern: str = EITHER) -> Column:
    """Distinct numbers that a pattern finds, ascending."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


def all_numbers(*arrays: Column) -> Column:
    """Sorted union of arrays of numbers; nulls count as empty."""
    out = F.array().cast("array<int>")
    for a in arrays:
        out = F.array_union(out, F.coalesce(a, F.array().cast("array<int>")))
    return F.array_sort(out)


def split_compound(name: Column) -> Column:
    """``6 and 7`` to the single numbers."""
    return F.filter(F.transform(F.split(name, r"\s+and\s+|,\s*"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def flatten_name(value: Column) -> Column:
    """A name that YAML may have read as nested lists, as plain text."""
    return F.trim(F.regexp_replace(value, r"[\[\]\"]", ""))


def points(ruling: Column, literal: bool = False) -> Column:
    """The numbered points of a ruling, without blanks; ``literal`` splits at any number with a full stop."""
    pattern = r"\s*\d+\.\s+" if literal else r"(?m)(?:^|\n)\s*(?:\*\*)?\d+\.(?:\*\*)?\s+"
    return F.filter(F.transform(F.split(ruling, pattern), lambda p: F.trim(p)), lambda p: p != "")


def per_article(entry: Column) -> Column:
    """``Article X | text`` as number and text."""
    return F.struct(F.regexp_extract(entry, r"^Article\s+(\d+)", 1).try_cast("int").alias("article"), F.trim(F.regexp_extract(entry, r"\|\s*(.*)$", 1)).alias("text"))


def mentions(text: Column, number: Column) -> Column:
    """Whether a text names an article; the number may be a column."""
    return F.regexp_like(text, F.concat(F.lit(r"(?i)article\s*"), number.cast("string"), F.lit(r"\b")))


def is_relevant(text: Column) -> Column:
    return F.contains(text, F.lit("GDPR")) | F.contains(text, F.lit("2016/679")) | F.contains(text, F.lit("General Data Protection Regulation"))


def to_wikilinks(text: Column) -> Column:
    """``Article 6(1)`` to a link with the wording as its alias; what is linked stays."""
    return F.regexp_replace(text, r"(?<!\[\[)(?<!\|)\bArticle (\d+)((?:\(\w+\))+)", "[[Article $1|Article $1$2]]")


def unlink_beyond(text: Column, most_digits: int = 2) -> Column:
    """Links to articles of three digits and more become plain text."""
    return F.regexp_replace(text, rf"\[\[(Article)\s+(\d{{{most_digits + 1},}})(?:\|[^\]]*)?\]\]", "$1 $2")


def context(text: Column, pattern: str, width: int = 100) -> Column:
    """The first match with up to ``width`` characters around it, cut at words."""
    found = F.regexp_extract(text, rf"(?s)((?:\b.{{0,{width}}})?{pattern}(?:.{{0,{width}}}\b)?)", 1)
    return F.when(found != "", F.concat(F.lit("..."), F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit("...")))


def interpretation(text: Column, number: Column) -> Column:
    """The numbered paragraph that names an article, else the first sentence that does, else a fixed text."""
    name = F.concat(F.lit(r"Article\s+"), number.cast("string"), F.lit(r"\b"))
    paragraph = F.regexp_substr(text, F.concat(F.lit(r"(?m)^\s*\d+\.[^\n]*"), name, F.lit(r"[^\n]*")))
    sentence = F.regexp_substr(text, F.concat(F.lit(r"[^.\n]*"), name, F.lit(r"[^.\n]*\.?")))
    return F.trim(F.coalesce(paragraph, sentence, F.lit("No specific interpretation found")))


def article_url(number: Column) -> Column:
    """Where a chip that names an article leads; nothing asks whether that page is there."""
    return F.concat(F.lit("/GDPR/Article-"), number.cast("string"))


def editorial(line: Column) -> Column:
    """House style: the big solidus in a case number behind a pipe, an escaped bracket behind a link, questions as headings."""
    line = F.regexp_replace(line, r"\|(C-\d+)/(\d+)", "|$1⧸$2")
    line = F.regexp_replace(line, r"\]\]\)", r"]]\\)")
    return F.regexp_replace(line, r"(?i)^#*\s*((?:first|second|third|fourth|preliminary) question.*)$", "### $1")


def article_of_slug(slug: Column) -> Column:
    """The article that an article page's slug names, or null."""
    return F.nullif(F.regexp_extract(slug, r"(?:^|/)Article-(\d+)$", 1), F.lit("")).cast("int")
