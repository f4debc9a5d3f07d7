"""Incremental maintenance: change events to snapshots, and what has to be built again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import leaf_ancestors, leaves
from ..operators.tables import written


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key; ``order`` decides, the last of its columns ties."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("_place", place).filter("_place = 1").drop("_place")


def merge_snapshot(snapshot: DataFrame, events: DataFrame, key: str, *order: str) -> DataFrame:
    """The snapshot after events (change: add, change or delete): the last event of a key wins.

    A snapshot tells nothing of when its rows came, so every event is later; see ``merge_state`` for states that know.
    """
    last = latest(events, key, *order)
    kept = snapshot.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("change <> 'delete'").select(*snapshot.columns))


def merge_state(state: DataFrame, events: DataFrame, key: str, *order: str) -> DataFrame:
    """A state that knows its order (its columns, ``order`` among them, and ``gone``) after events: of each key's states and events the last stays.

    Deleted keys stay as rows that are gone, so an event that comes late, in whichever batch, never undoes a newer one.
    """
    new = events.withColumn("gone", F.col("change") == "delete").select(*state.columns)
    return latest(state.unionByName(new), key, *order)


def debounced(events: DataFrame, key: str, gap: str, *order: str) -> DataFrame:
    """(key, asked, the columns of the last event): events of a key that follow one another within ``gap`` ask for one build, which the last of them stands for."""
    turns = events.groupBy(key, F.session_window(order[0], gap)).agg(F.count("*").alias("asked"), F.max(F.struct(*order, *[c for c in events.columns if c not in (key, *order)])).alias("_last"))
    return turns.select(key, "asked", "_last.*")


def pending(events: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(to build, to remove) of a batch of events."""
    last = latest(events, key, *order)
    return last.filter("change <> 'delete'").select(key), last.filter("change = 'delete'").select(key)


def rebuilt(before: DataFrame, events: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages (path, ...) after events (path, ts, change): those that were added or changed as ``parsed`` has them, the others as they were."""
    build, remove = pending(events, "path", "ts", "change")
    kept = before.join(build.unionByName(remove), "path", "left_anti")
    return kept.unionByName(parsed.join(build, "path", "left_semi").select(*before.columns))


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(origin, node) to build again when ``changed`` (node) changes: the outputs it reaches and all that leads to them."""
    start = changed.select(F.col("node").alias("origin"), "node")
    ends = written(leaves(edges, start))
    return ends.unionByName(leaf_ancestors(edges, start, ends)).distinct()


def watch_folder(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """A stream of whole files as they appear; a file source sees additions, so changes come as new files, deletions by ``listing_events``."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("ts"), "value")


def listing_events(before: DataFrame, now: DataFrame, at) -> DataFrame:
    """(path, ts, change) between two listings (path, modified): what is new, what is newer, what is gone (at the time ``at``)."""
    old = before.select("path", F.col("modified").alias("_old"))
    both = now.select("path", "modified").join(old, "path", "full")
    change = F.when(F.col("_old").isNull(), "add").when(F.col("modified").isNull(), "delete").when(F.col("modified") > F.col("_old"), "change")
    return both.select("path", F.coalesce("modified", F.lit(at)).alias("ts"), change.alias("change")).filter("change is not null")


def tracked(events: DataFrame, extension: str = ".md") -> tuple[DataFrame, DataFrame]:
    """(events of pages, events of other files): the latter are only kept track of."""
    page = F.col("path").endswith(extension)
    return events.filter(page), events.filter(~page)


def read_state(spark: SparkSession, state_path: str, schema: T.StructType, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """A state's rows, those that are gone too, as the batches below ``before`` left them; only the given buckets, if any."""
    log = spark.read.schema("bucket int, version long").option("recursiveFileLookup", True).parquet(f"{state_path}/log").filter("bucket is not null")
    if before is not None:
        log = log.filter(F.col("version") < before)
    if buckets is not None:
        log = log.filter(F.col("bucket").isin(buckets))
    at = [f"{state_path}/data/version={r.v}/bucket={r.bucket}" for r in log.groupBy("bucket").agg(F.max("version").alias("v")).collect()]  # one row a bucket
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def run_incremental(events: DataFrame, state_path: str, checkpoint: str, key: str, columns: list[str], order: tuple[str, ...], emit: Callable[[DataFrame, int], None] | None = None, buckets: int = 64):
    """Start a stream that merges each micro-batch into a state table; ``emit`` sees the rows that are there after each batch.

    The state is split into buckets by the key's hash.  A batch writes new versions of the buckets that it touches and a log
    of which these are; others are neither read nor written.  A batch that is run again after a failure reads what the batches before
    it left and writes the same version again, so the state is exact.  ``live`` reads the result, also where no batch came.
    """
    spark = events.sparkSession
    own = list(dict.fromkeys([*columns, *order]))
    schema = T.StructType([*events.select(*own).schema.fields, T.StructField("gone", T.BooleanType())])
    spark.createDataFrame([], "bucket int, version long").write.mode("ignore").parquet(f"{state_path}/log/none")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = latest(batch, key, *order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r.bucket for r in last.select("bucket").distinct().collect()]
            before = read_state(spark, state_path, schema, number, touched)
            new = merge_state(before.select(*own, "gone"), last, key, *order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/data/version={number}")
            spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{state_path}/log/batch{number}")
        finally:
            last.unpersist()
        if emit:
            emit(live(spark, state_path, schema, columns), number)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark: SparkSession, state_path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """The columns of the rows that are there; ``schema`` is that of the stream."""
    fields = T.StructType([*schema.fields, T.StructField("gone", T.BooleanType())]) if "gone" not in schema.fieldNames() else schema
    return read_state(spark, state_path, fields).filter("not gone").select(*columns)
