"""Session defaults, the shared scratch folder, and broadcast size checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_LIMIT = 64 * 1024 * 1024


def local_session(cpus: int = 8, name: str = "harrow", shared: str | None = None) -> SparkSession:
    """A session for tests and the local benchmark. Clusters bring their own.

    shared is where intermediate tables go (spark.checkpoint.dir).
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Where it is unset, a folder in the warehouse is used, which executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_harrow"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def conf_set(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Inside, the session has these settings; afterwards it has those of before."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession):
    """Inside, a finished execution leaves no shuffle files on the executors' disks."""
    return conf_set(spark, {_DROP_SHUFFLES: "true"})


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder and read back from there.

    Lost executors cost no recomputation, later readers prune columns, and the
    planner knows the size. The shuffles that made the table are dropped with it.
    """
    spark = df.sparkSession
    path = new_run_dir(spark, "table")
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame as one aggregate: text lengths plus a fixed cost per field."""
    size = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        size = size + F.lit(16)
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif not isinstance(field.dataType, T.AtomicType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint when the measured size is within the limit, else leave it to a shuffle join."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df
