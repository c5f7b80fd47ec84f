"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder on a local master, an error on a cluster, whose machines would
    each have a folder of their own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="recurscan-"))
        path = sc._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for what is run inside; afterwards as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts the lineage and outlives any executor. Deleted when the
    scope ends in which it is written (keep: the scope around that one), without one when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recurscan/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with setting(spark, _CLEANUP, "true"):  # the shuffles of this write are of no use after it
        df.write.option("parquet.block.size", 1 << 24).parquet(path)  # small row groups: their buffers are on the heap
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """A scope: tables written inside are deleted at its end, those to keep at the end of the scope around it. Other calls' tables
    are not touched."""
    own: list[str] = []
    mark = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(mark)
        for path in own:
            delete(spark, path)
