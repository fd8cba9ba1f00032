"""Intermediate tables in the folder that the cluster shares.

Every operator that needs a result twice, or needs to cut lineage, writes it here as Parquet.
The files belong to the cluster's storage, so a lost executor costs a task and not the job.
A table goes when what was made of it is stored itself (`discard`), or when a later stage of a
pipeline begins that does not read it (`release`).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and Spark is local (tests)."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        got = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one table."""
    path = f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}/{name}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; the lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """While it holds, the paths of new tables are added to paths; afterwards to the list around it."""
    before = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(before)
        if (around := _noted.get()) is not None:
            around.extend(paths)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch_path gave."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave. What was made of them must be stored by now."""
    for t in tables:
        if files := t.inputFiles():
            delete(t.sparkSession, files[0].rpartition("/")[0])


def release(paths: list[str], *readers: DataFrame) -> None:
    """Delete the tables at paths which none of the readers reads, and take them off the list."""
    read = {urlparse(f).path for df in readers for f in df.inputFiles()}
    spark = readers[0].sparkSession
    for path in list(paths):
        if not any(f.startswith(urlparse(path).path + "/") for f in read):
            delete(spark, path)
            paths.remove(path)


def free(columns: list[str], name: str) -> str:
    """name, or name with underscores behind it, so that no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle is to have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
