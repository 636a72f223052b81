"""Where intermediate results go when lineage has to be cut.

Everything here lives under ``spark.checkpoint.dir``, the folder that a cluster
shares between the driver and all executors, so that a lost executor costs a
re-run of its tasks and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in local tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session (one of our own only where it is unset and the session is local)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/factspark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths to be deleted, a list for each open ``scratch``, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, label: str, compression: str = "zstd", lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Inside ``scratch`` the table lives until its end; ``lasting`` ones go to the scope around it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    scopes = _scopes.get()[: -1 if lasting else None]
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end: nothing lazy that reads them may leave."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
