"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local master whose session names no folder, as in tests on one machine.
LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else what setCheckpointDir() set; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = LOCAL_DEFAULT
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A written table has at least this many files per core of the cluster, if its plan has as many partitions, or a quarter
#: of the shuffle partitions if that is more, and one for so many bytes that the plan's tables are estimated to have.
FILES_PER_CORE, FILE_BYTES = 4, 256 << 20


def file_count(df: DataFrame, rows: int | None = None) -> int:
    """Files of a written table at most. rows: about how many there are, if they are known to be few and narrow."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(FILES_PER_CORE * cores, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, min(size // FILE_BYTES, 1 << 30))
    return files if rows is None else min(files, max(cores, rows >> 18))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors.

    Neighbouring partitions are joined only where they are small by the optimizer's estimate, so a task never gets much more than
    FILE_BYTES of input however large the tables are. rows: as in file_count.
    """
    path = scratch_path(df.sparkSession, name)
    df.coalesce(file_count(df, rows)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it these settings hold, then those from before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_settings(spark: SparkSession, parts: int = 1) -> dict[str, str]:
    """For writing a table, or one of its parts: shuffle files go when it is written (otherwise they stay until the driver happens to collect
    its garbage), and a part is dealt out to as many tasks as its share of the table takes."""
    whole, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    return {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.shuffle.partitions": str(min(whole, max(2 * cores, -(-whole // parts))))}
