"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all runs in one process (local mode, as in tests) a temporary folder is taken; on a cluster
    each executor would write to its own disk, so there an error says what to set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = sc._docgraph_folder = getattr(sc, "_docgraph_folder", None) or "file://" + tempfile.mkdtemp(prefix="docgraph-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder, which the loss of an executor doesn't touch, and read it again.

    What was shuffled for it is removed at once, not when the driver happens to collect its garbage; ``df`` itself should not be
    executed again.  An empty table keeps its schema.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{name}", spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)
