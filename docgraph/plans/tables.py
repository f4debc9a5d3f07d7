"""The driver's tables as the relations that the operators take, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import hrefs, page_title
from ..functions.paths import page_slug

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """slug, title and the columns ``more`` of the table pages."""
    return read(spark, sf_dir, "pages").select(page_slug(F.col("url")).alias("slug"), page_title(F.col("html")).alias("title"), *more)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst): a page's links without their first slash."""
    p = read(spark, sf_dir, "pages").select(page_slug(F.col("url")).alias("src"), F.explode(F.array_distinct(hrefs(F.col("html")))).alias("dst"))
    return p.select("src", F.regexp_replace("dst", "^/", "").alias("dst")).distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs: of pages, and, as the pages link to none of them, of link targets of up to four characters, which stand in for pages."""
    own = pages(spark, sf_dir).select("slug")
    return own.unionByName(links(spark, sf_dir).select(F.col("dst").alias("slug")).filter(F.length("slug") <= 4)).distinct()


PATH = r"regexp_replace(regexp_replace(url, '^[a-z][a-z0-9+.\-]*://[^/]*/?', ''), '[?#].*$', '')"
_EXT = r"'\.[A-Za-z0-9]+$'"


def sql_sluggify(x: str) -> str:
    return rf"regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '\s', '-', 'g'), '&', '-and-'), '%', '-percent'), '?', ''), '#', ''), '/$', '')"


def sql_slugify(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '^/', ''), '/$', '')"
    without = f"regexp_replace({bare}, {_EXT}, '')"
    ext = f"regexp_extract({bare}, {_EXT})"
    return f"(regexp_replace({sql_sluggify(without)}, '(^|/)_index$', '\\1index') || CASE WHEN {ext} IN ('', '.md', '.html') THEN '' ELSE {ext} END)"


_FILE = f"({PATH} || CASE WHEN ends_with({PATH}, '/') THEN 'index' ELSE '' END)"
SLUG = f"(CASE WHEN {PATH} = '' THEN 'index' ELSE {sql_slugify(_FILE)} END)"
TITLE = r"trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1))"
PAGES = f"pg AS (SELECT page_id, url, html, {SLUG} AS slug, {TITLE} AS title FROM pages)"
LINKS = f"""{PAGES}, lk AS (SELECT DISTINCT slug AS src, regexp_replace(d, '^/', '') AS dst FROM (SELECT slug, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS d FROM pg))"""
NODES = f"{LINKS}, nd AS (SELECT slug FROM pg UNION SELECT dst FROM lk WHERE length(dst) <= 4)"
