"""Cutting lineage on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once on shared storage and forget how it was made.

    Uses the cluster's ``spark.checkpoint.dir``. Where that is unset, a local
    session (tests, a laptop) gets a temporary folder; on a cluster it is an
    error, since executors do not share such folders. The files are replicated
    by the store, so a lost executor costs a re-read.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="groundwell-"))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Deletes the files of a ``cut`` table that nothing will read again, so that rounds do not pile up on disk."""
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
