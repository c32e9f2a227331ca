"""Session and shared-folder helpers.

Written stages live below spark.checkpoint.dir, which the driver and all executors see. They are left
to the session: `clear_scratch` removes what this session has written, and runs when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(app: str = "fieldledger", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # rows hashed on a subset of the join keys may be joined where they are
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local one if the executors are threads
    of this process, and an error if they are not: they would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fieldledger-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: list[tuple[SparkSession, str]] = []


def clear_scratch(spark: SparkSession | None = None) -> int:
    """Remove what cut_lineage has written in this session (all sessions if None); frames that read it end there."""
    mine = [(s, p) for s, p in _WRITTEN if spark is None or s is spark]
    for session, path in mine:
        _WRITTEN.remove((session, path))
        if session.sparkContext._jsc is None:  # stopped: it cannot delete any more
            continue
        with contextlib.suppress(Exception):
            place = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(mine)


atexit.register(clear_scratch)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that nothing refers to any more, so that a job in several passes needs the disk of
    its largest pass and not of all. Spark deletes them when the driver collects garbage, which is else left to chance."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def passed(df, name: str, *before):
    """df from a table in the shared folder, when all that it was made from is no longer needed: shuffle files go, and so do the tables
    of the passes before, which are frames from cut_lineage that nothing reads any more."""
    spark = df.sparkSession
    out = cut_lineage(df, name, compression="zstd")
    del df
    for frame in before:
        drop_scratch(frame)
    release(spark)
    return out


def drop_scratch(frame) -> None:
    """Remove the table that a frame from cut_lineage reads."""
    path = frame._fieldledger_path
    for i, (session, known) in enumerate(_WRITTEN):
        if known == path:
            remove(session, path)
            del _WRITTEN[i]
            break


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> str:
    """Give the package to executors that do not have it installed; returns the archive's path."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fieldledger-"), "fieldledger.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    return archive


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/fieldledger/{name}-{uuid.uuid4().hex}"


def spread(df):
    """df in as many parts as spark.fieldledger.spread says, as it is where that is not set. For small files whose rows
    cost far more to work on than to move; whoever sets up the session knows whether it has such."""
    parts = df.sparkSession.conf.get("spark.fieldledger.spread", None)
    return df.repartition(int(parts)) if parts else df


def deal(df):
    """df in several parts per core, for rows that cost far more to work on than to move: a table in one file of few row
    groups is otherwise read, and worked on, by as few tasks."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


def cut_lineage(df, name: str = "stage", by: str | None = None, parts: int = 0, move: bool = True, compression: str = "snappy"):
    """Write df below the shared folder and read it back, so that a lost executor
    does not replay everything before it. by: a column with few values; a filter on it reads only its files, of which there
    are as many as its rows fill, or `parts`, or one per task if the rows are not to `move`."""
    path = scratch_path(df.sparkSession, name)
    _WRITTEN.append((df.sparkSession, path))
    if by:
        (df.repartition(parts) if parts else df.hint("rebalance", by) if move else df).write.partitionBy(by).parquet(path, compression=compression)
    else:
        df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fieldledger_path = path
    return out
