"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCRATCH_KEY = "spark.checkpoint.dir"

_local_scratch: dict[str, str] = {}
_scope: list[str] = []  # folders, below the scratch folder, that tables written now go to


def get_spark(app: str = "steepgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on. Cluster settings given at submit time win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: what the cluster names, a temp folder only in local mode."""
    application = spark.sparkContext.applicationId
    configured = spark.conf.get(SCRATCH_KEY, None)
    if configured:
        return f"{configured.rstrip('/')}/steepgrid-{application}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SCRATCH_KEY} to a folder every executor can reach")
    if application not in _local_scratch:
        _local_scratch[application] = tempfile.mkdtemp(prefix="steepgrid-")
    return _local_scratch[application]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    The written table survives executor loss, is computed once however often it is read, keeps
    columnar pruning, and gives the planner an exact size, so small results are broadcast by
    Spark's own size check rather than by a hint.
    """
    spark = df.sparkSession
    path = "/".join([scratch_dir(spark), *_scope, f"{label}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """Intermediate tables written inside go to a folder of their own, which ``drop_scratch`` can delete alone."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def drop_scratch(spark: SparkSession, scope: str | None = None) -> None:
    """Delete this application's intermediate tables, or those of one scope, once no frame that reads them is needed."""
    folder = scratch_dir(spark) if scope is None else f"{scratch_dir(spark)}/{scope}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
