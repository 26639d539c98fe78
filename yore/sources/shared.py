"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(session: SparkSession) -> str:
    """The folder for checkpoints and tables that the cluster shares: spark.checkpoint.dir, or what the session was told by setCheckpointDir.

    Only a local master (tests, a laptop) may go without one and gets a temporary folder; no executor could read that of
    a cluster's driver.
    """
    context = session.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    told = context._jsc.sc().getCheckpointDir()
    if told.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="yore-checkpoints-"))
        told = context._jsc.sc().getCheckpointDir()
    return told.get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to folder(); lineage ends there."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in folder(): like cut(), but columnar and compressed, for what is large."""
    session = df.sparkSession
    path = f"{folder(session)}/yore-tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return session.read.parquet(path)


#: Rows that a task of dealt() sorts and adds up.
DEALT = 500_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by the hash of `by` over as many tasks as `rows` ask for, DEALT for each, though never fewer than the session's shuffles have, so that a task's memory does not grow with the table. Tables dealt alike meet where they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // DEALT)), *by)


def names(session: SparkSession, path: str) -> list[str]:
    """What lies in a folder of any storage that Spark reads, sorted; nothing if there is none."""
    at = session._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(session._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def put(session: SparkSession, path: str, text: str) -> None:
    """Write a small text as a file, at once: readers see it whole or not at all. The file must not be there."""
    of = session._jvm.org.apache.hadoop.fs.Path
    at, draft = of(path), of(f"{path}.{uuid.uuid4().hex}")
    files = at.getFileSystem(session._jsc.hadoopConfiguration())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(at) or not files.rename(draft, at):
        files.delete(draft, False)
        raise FileExistsError(path)


def release(session: SparkSession) -> None:
    """Have the shuffle files of finished steps removed now: Spark's cleaner drops them once the driver's garbage is collected, which a small driver may not do for long."""
    gc.collect()
    session.sparkContext._jvm.System.gc()
