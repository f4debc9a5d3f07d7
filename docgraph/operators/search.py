"""Full-text search over an inverted index: prefix match, all terms, ranked, with excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 30  #: tokens of an excerpt's window
SHOWN = 8  #: results a field


def index(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(field, token, id, pos) of every word."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), tokens.alias("tokens")) for f, tokens in fields.items()])
    rows = docs.select(F.col(key).alias("id"), F.explode(named).alias("f")).select("id", "f.field", F.posexplode("f.tokens").alias("pos", "token"))
    return rows.select("field", "token", "id", F.col("pos").cast("long").alias("pos"))


def store(postings: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write an index once: postings by token and document (positions in an array), split by the token's first two letters and sorted by token.

    A query by prefix reads the folders of its letters and, by the statistics of sorted files, few row groups there.  What
    every task writes is sorted; common tokens are dealt by document too, so that none fills one task.
    """
    rows = postings.groupBy("field", "token", "id").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    rows = rows.select(F.col("field"), "token", "id", F.size("at").cast("long").alias("hits"), F.element_at("at", 1).alias("first"), "at", head(F.col("token")).alias("head"))
    parts = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "head", "token", "id").sortWithinPartitions("head", "token", "id")
    rows.write.partitionBy("head").parquet(path)
    return read_index(rows.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("field string, token string, id long, hits long, first long, at array<long>, head string").parquet(path)


def head(token: Column) -> Column:
    """The folder of a token: the code points of its first two letters, so that any letter makes a plain name."""
    return F.concat_ws("-", F.ascii(token).cast("string"), F.when(F.length(token) > 1, F.ascii(F.substring(token, 2, 1)).cast("string")))


def heads(term: str) -> Column:
    """Whether a folder may hold words that begin with ``term``."""
    codes = [str(ord(c)) for c in term[:2]]
    column = F.col("head")
    return column == "-".join(codes) if len(codes) == 2 else (column == codes[0]) | column.startswith(codes[0] + "-")


def query(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(field, id, hits, first): documents in whose field each term begins a word.

    ``postings`` is an index or a stored one.  Terms are few, so each is a test on the token that the scan can push down;
    no join is needed.
    """
    kept = postings
    if "head" in postings.columns:
        folders = heads(terms[0])
        for t in terms[1:]:
            folders = folders | heads(t)
        kept = postings.filter(folders)
    begins = F.col("token").startswith(terms[0])
    for t in terms[1:]:
        begins = begins | F.col("token").startswith(t)
    found = kept.filter(begins)
    n, first = (F.sum("hits"), F.min("first")) if "hits" in postings.columns else (F.count("*"), F.min("pos"))
    rows = found.groupBy("field", "id").agg(n.alias("hits"), first.alias("first"), *[F.max(F.col("token").startswith(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    for i in range(len(terms)):
        rows = rows.filter(F.col(f"t{i}"))
    return rows.select("field", "id", "hits", "first")


def ranked(hits: DataFrame, most: int = SHOWN) -> DataFrame:
    """The best of each field: most hits, then the earliest, then the smaller id."""
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("hits"), "first", "id"))
    return hits.withColumn("rank", place.cast("long")).filter(F.col("rank") <= most)


def merged(results: DataFrame, fields: tuple[str, ...] = ("title", "content", "tags")) -> DataFrame:
    """Each document once, at its first field and its rank there."""
    prio = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    best = results.groupBy("id").agg(F.min(F.struct(prio.cast("long").alias("prio"), "rank")).alias("k"))
    return best.select("id", "k.prio", "k.rank")


def records(results: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Results (id, ...) with the columns of their documents; results are few, documents are not moved."""
    return docs.join(F.broadcast(results.withColumnRenamed("id", key)), key)  # SHOWN rows a field


def best_window(docs: DataFrame, tokens: str, hit, width: int = WINDOW) -> DataFrame:
    """docs with n (tokens) and best: where the window of ``width`` tokens with most hits starts; the last of equals, 0 for short texts.

    ``tokens`` names a column of words and ``hit`` is a condition on a word.  All is done within the row, in one pass over the words and one over
    the places of hits, which stand in a column of their own, as a lambda would work an expression out anew for each element.
    Starts stop ``width`` before the end.
    """
    places = F.filter(F.transform(tokens, lambda t, i: F.when(hit(t), i)), lambda i: i.isNotNull())
    rows = docs.withColumn("n", F.size(tokens).cast("long")).withColumn("_hits", places)
    # of windows with most hits the last starts at a hit, or as late as it can; those from a hit on are among the next ``width``
    last = (F.col("n") - width - 1).cast("int")
    own = F.transform("_hits", lambda p, i: F.struct(F.size(F.filter(F.slice("_hits", i + 1, F.lit(width)), lambda q: q < p + width)).alias("s"), p.alias("pos")))
    end = F.struct(F.size(F.filter("_hits", lambda q: (q >= last) & (q < last + width))).alias("s"), last.alias("pos"))
    best = F.array_max(F.array_append(F.filter(own, lambda w: w["pos"] <= last), end))
    return rows.withColumn("best", F.when(last < 0, 0).otherwise(best["pos"]).cast("long")).drop("_hits")


def excerpt_bounds(best: Column, n: Column, width: int = WINDOW) -> tuple[Column, Column]:
    """First token and the end (not included) of an excerpt."""
    start = F.greatest(best - width, F.lit(0))
    return start, F.least(start + 2 * width, n - 1)
