"""Session helpers shared by the tests, the bench and the driver entry point."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def local_session(cpus: int | str = 8, app: str = "gyre") -> SparkSession:
    """A single-machine session; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GYRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the session names it.

    Only a single-machine session without one gets a folder of its own; elsewhere its absence is
    an error, as files on one machine's disk would be missed by the others. The setting itself
    cannot be changed in a running session and is left alone.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all machines share")
    return f"{tempfile.gettempdir()}/gyre-{context.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """Folder for tables that outlive no session: this application's own part of the shared folder."""
    return "/".join([shared_dir(spark), f"scratch-{spark.sparkContext.applicationId}", *_scopes.get()])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables written inside are deleted at the end; what was read from them must be written by then."""
    token = _scopes.set((*_scopes.get(), uuid.uuid4().hex))
    try:
        yield
    finally:
        folder = scratch_dir(spark)
        _scopes.reset(token)
        _delete(spark, folder)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application has written to its scratch folder."""
    _delete(spark, f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")


def written(df: DataFrame, **options) -> DataFrame:
    """`df` as a compressed table in the scratch folder: cuts lineage, and survives lost executors. `options` go to the writer."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
