"""Cutting lineage: intermediate tables that later plans start from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Lists that take the paths of settled tables; see scratch().
_SCOPES: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the tables that calls inside it settle, for release() once their results are written."""
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.remove(held)


def release(spark: SparkSession, held: list[str]) -> None:
    """Delete the tables of a list, and only those."""
    for path in held:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    held.clear()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it has run; else they lie there until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it.

    What several branches of a plan use is computed once, plans stay small, and
    a lost executor costs nothing that has been written. The write's shuffle
    files go with it.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    for held in _SCOPES:
        held.append(path)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def still_there(*tables: DataFrame) -> bool:
    """Whether settled tables haven't been deleted since."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{t._settled}/_SUCCESS")
        if not p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).exists(p):
            return False
    return True
