"""Sources: folders of Markdown and other files, front matter, reports and link lists."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import slugify_file_path
from ..functions.text import parse_date, truthy
from .front import parse_front

FRONT = r"(?s)\A(?:---[ \t]*(?:yaml)?|(---[ \t]*toml|\+\+\+))[ \t]*\r?\n(.*?)\r?\n(?:---|\+\+\+)[ \t]*(?:\r?\n|\z)"
_RELATIVE = r"^[a-z]+:/*"


def read_files(spark: SparkSession, folder: str, pattern: str = "*.md", ignore: tuple[str, ...] = ()) -> DataFrame:
    """path (below the folder), value (trimmed), modified of every file; ``ignore`` holds patterns of paths to leave out."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    base = F.lit(folder.removeprefix("file://").rstrip("/") + "/")
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.replace(F.concat(F.lit("/"), F.regexp_replace(uri, _RELATIVE, "")), base, F.lit(""))
    rows = files.select(path.alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"), F.col("_metadata.file_modification_time").alias("modified"))
    for p in ignore:
        rows = rows.filter(~F.col("path").rlike(p))
    return rows


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the lines of a .gitignore leave a path out: the last rule that fits decides, ``!`` takes back, a folder's rule holds below it."""
    out = F.lit(False)
    for line in rules:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
        out = F.when(path.rlike(_rule(rule)), F.lit(not keep)).otherwise(out)
    return out


def _rule(rule: str) -> str:
    """A .gitignore rule as a pattern of paths below the folder that holds it."""
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            inner = rule[i + 1 : end].replace("\\", r"\\")
            out, i = out + ("[^" + inner[1:] if inner[0] in "!^" else "[" + inner) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/" if folder else "(?:/|$)")


def read_assets(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of files that aren't pages; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).filter(~F.col("path").endswith(".md"))


def split_front(value: Column) -> tuple[Column, Column]:
    """(front matter or empty, body): the fence, which may name its language, has to stand on lines of its own."""
    return F.regexp_extract(value, FRONT, 2), F.regexp_replace(value, FRONT, "")


def is_toml(value: Column) -> Column:
    """Whether the front matter's fence says that it is TOML."""
    return F.regexp_extract(value, FRONT, 1) != ""


def split_front_naive(value: Column) -> Column:
    """Front matter up to the next three hyphens wherever they stand."""
    end = F.locate("---", value, 4)
    return F.when(value.startswith("---") & (end > 0), F.substr(value, F.lit(4), end - 4))


def _flat(value) -> str | None:
    """A value as text; nested lists, as of an unquoted wikilink, lose their brackets."""
    if isinstance(value, list):
        inner = [_flat(v) for v in value]
        return ", ".join(v for v in inner if v is not None)
    if isinstance(value, dict):
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return value


def _items(value) -> list[str] | None:
    if value is None:
        return None
    if isinstance(value, str):
        return [v.strip() for v in value.split(",") if v.strip()]
    if isinstance(value, dict):
        return list(value)
    return [t for t in (_flat(v) for v in value) if t]


_PARSED = T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("error", T.StringType())])


@F.pandas_udf(_PARSED)
def front_fields(text: pd.Series, toml: pd.Series) -> pd.DataFrame:
    """fields (every value as text; maps as JSON), lists (every value as a list) and error of front matter, YAML or TOML."""
    rows = []
    for t, other in zip(text, toml, strict=True):
        try:
            found, error = parse_front(t or "", "toml" if other else "yaml"), None
        except (ValueError, IndexError, RecursionError) as e:
            found, error = {}, str(e) or type(e).__name__
        rows.append(({k: _flat(v) for k, v in found.items()}, {k: _items(v) for k, v in found.items()}, error and str(error)))
    return pd.DataFrame(rows, columns=["fields", "lists", "error"])


def _first(*names: str) -> Column:
    return F.coalesce(*[truthy(F.try_element_at("fields", F.lit(n))) for n in names])


def _list(*names: str) -> Column:
    return F.coalesce(*[F.try_element_at("lists", F.lit(n)) for n in names], F.array().cast("array<string>"))


def pages(files: DataFrame) -> DataFrame:
    """The page relation of files (path, value, modified): slug, title, tags, aliases, flags, dates, body and error.

    A file that doesn't parse is kept, with its error.  Missing and invalid dates are null; ``date_invalid`` tells which.
    """
    front, body = split_front(F.col("value"))
    rows = files.select("path", "modified", body.alias("body"), front_fields(front, is_toml(F.col("value"))).alias("front")).select("path", "modified", "body", "front.*")
    slug = slugify_file_path(F.col("path"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    tags = F.array_distinct(F.transform(_list("tags", "tag"), lambda t: F.regexp_replace(F.replace(t, F.lit(" "), F.lit("-")), "^#", "")))
    created, changed, published = _first("created", "date"), _first("modified", "lastmod", "updated", "last-modified"), _first("published", "publishDate", "date")
    return rows.select(
        slug.alias("slug"), F.col("path").alias("file_path"), F.coalesce(_first("title"), stem).alias("title"), tags.alias("tags"), alias_slugs(slug, F.concat(_list("aliases", "alias"), _list("permalink"))).alias("aliases"),
        _list("cssclasses", "cssclass").alias("cssclasses"), _first("draft").alias("draft"), _first("publish").alias("publish"), _first("lang").alias("lang"), _first("description").alias("description"),
        F.struct(parse_date(created).alias("created"), F.coalesce(parse_date(changed), F.col("modified").cast("timestamp")).alias("modified"), parse_date(published).alias("published")).alias("dates"),
        (created.isNotNull() & parse_date(created).isNull()).alias("date_invalid"), F.col("fields").alias("extra"), F.col("lists").alias("extra_lists"), "body", "error",
    )


def alias_slugs(slug: Column, names: Column) -> Column:
    """Slugs of aliases, beside the page; one that ends in a slash is an index."""
    folder = F.regexp_extract(slug, "^(.*/)[^/]*$", 1)
    return F.transform(names, lambda n: F.when(n.startswith("/"), slugify_file_path(n)).otherwise(F.concat(folder, slugify_file_path(F.when(n.endswith("/"), F.concat(n, F.lit("index"))).otherwise(n)))))


def cases(files: DataFrame) -> DataFrame:
    """Case records; rows without a case number are left out, file names are the key and a disagreeing number is flagged."""
    p = pages(files)
    fields, lists = F.col("extra"), F.col("extra_lists")
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    number = truthy(F.try_element_at(fields, F.lit("case-number")))
    entry = F.transform(F.try_element_at(lists, F.lit("per-article")), lambda e: F.struct(F.regexp_extract(e, r"^Article\s+(\d+)", 1).try_cast("int").alias("article"), F.trim(F.regexp_extract(e, r"\|\s*(.*)$", 1)).alias("text")))
    return p.filter(number.isNotNull()).select(
        stem.alias("file_name"), "title", F.to_date("dates.created").alias("date"), number.alias("case_number"), truthy(F.try_element_at(fields, F.lit("parties"))).alias("parties"), F.try_element_at(lists, F.lit("topics")).alias("topics"),
        truthy(F.try_element_at(fields, F.lit("final-ruling"))).alias("final_ruling"), F.try_element_at(lists, F.lit("ruling-articles")).alias("ruling_articles"), entry.alias("per_article"),
        (F.replace(number, F.lit("/"), F.lit("-")) != stem).alias("number_differs"), "body",
    )


def fenced(text: Column) -> Column:
    """The first fenced block of YAML or JSON; without one, what stands before a line of equal signs."""
    return F.coalesce(truthy(F.regexp_extract(text, r"(?s)```(?:ya?ml|json)\s*\n(.*?)\n```", 1)), truthy(F.regexp_extract(text, r"(?s)\A(.*?)\n=+\n", 1)))


def report_sections(text: Column) -> Column:
    """A report's ``#### [[Article N]]`` sections as (article, cases)."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)#### \[\[Article \d+\]\].*?(?=\n#### |\z)"), F.lit(0))
    return F.transform(parts, lambda s: F.struct(F.regexp_extract(s, r"Article (\d+)", 1).cast("int").alias("article"), F.regexp_extract_all(s, F.lit(r"(?m)^- \[\[([^\]|]+)"), F.lit(1)).alias("cases")))


def first_lines(text: Column, n: int = 100) -> Column:
    return F.slice(F.split(text, "\n"), 1, n)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A content index (one JSON object by slug) as rows."""
    kind = "map<string,struct<title:string,links:array<string>,tags:array<string>,content:string>>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", kind)).alias("slug", "page")).select("slug", "page.*")


def read_index_lines(spark: SparkSession, path: str) -> DataFrame:
    """A content index of one JSON object a line as rows: the distributed form."""
    kind = "map<string,struct<title:string,links:array<string>,tags:array<string>,content:string>>"
    lines = spark.read.text(path)
    return lines.select(F.explode(F.from_json("value", kind)).alias("slug", "page")).select("slug", "page.*")


def front_is_valid(files: DataFrame) -> DataFrame:
    """path and error of files whose front matter doesn't parse."""
    return files.select("path", front_fields(split_front(F.col("value"))[0], is_toml(F.col("value"))).error.alias("error")).filter("error is not null")


def state_or_default(rows: DataFrame, saved: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a saved state where there is one."""
    return rows.join(saved.select(key, F.col(column).alias("_saved")), key, "left").withColumn(column, F.coalesce("_saved", column)).drop("_saved")


def git_dates(logs: DataFrame) -> DataFrame:
    """path and its last commit's time, of rows of whole logs (value), as ``git log --name-only --format='commit %ct'`` writes them."""
    commits = logs.select(F.explode(F.split("value", r"(?m)^commit (?=\d+$)")).alias("c")).filter("c <> ''")
    lines = commits.select(F.timestamp_seconds(F.regexp_extract("c", r"^(\d+)", 1).cast("long")).alias("at"), F.explode(F.split("c", "\n")).alias("path"))
    return lines.filter((F.trim("path") != "") & ~F.col("path").rlike(r"^\d+$")).groupBy("path").agg(F.max("at").alias("at"))
