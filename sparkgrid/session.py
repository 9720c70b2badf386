"""Session settings and tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that is ever broadcast on purpose; both limits are checked first.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "sparkgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Recording a Python call site per column costs a round trip each; it only serves error messages.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where the package is not installed on the executors nor on a shared path,
    submit it with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, as the cluster names it.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = spark.conf.get("spark.sparkgrid.localStaging", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="sparkgrid-")
            spark.conf.set("spark.sparkgrid.localStaging", folder)
    return folder.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later removal."""
    scope = "".join(f"/{name}" for name in _scopes)
    return f"{application_folder(spark)}{scope}/{label}-{uuid.uuid4().hex}"


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sparkgrid/{spark.conf.get('spark.app.id', 'session')}"


_scopes: list[str] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Owner of the tables staged inside: they are dropped at its end.

    Results that still read them must be written or collected before.
    """
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = f"{application_folder(spark)}/{'/'.join(_scopes)}"
    try:
        yield folder
    finally:
        _scopes.pop()
        remove_folder(spark, folder)


@contextmanager
def staging_as(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables staged inside lie in a folder of their own and stay; ``remove_folder`` drops them."""
    _scopes.append(f"{name}-{uuid.uuid4().hex}")
    folder = f"{application_folder(spark)}/{'/'.join(_scopes)}"
    try:
        yield folder
    finally:
        _scopes.pop()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back, so that later passes see the same rows.

    Used where a result is read more than once and must not be computed twice:
    the written table survives the loss of executors and is pruned by column.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point iterative training at the shared folder if the context has no folder yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(spark)}/sparkgrid/checkpoints")


def table_size(small: DataFrame) -> tuple[int, int]:
    """Rows of a table and their approximate bytes in memory, from one pass."""
    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 16
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
        return F.lit(8)

    per_row = F.lit(16)
    for name, kind in small.dtypes:
        per_row = per_row + width(name, kind)
    row = small.agg(F.count("*").alias("rows"), F.coalesce(F.sum(per_row), F.lit(0)).alias("bytes")).first()
    return row.rows, row.bytes


def join_keys(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner",
              known: Iterable[str] = ()) -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key; the key columns come from the left side.

    ``known`` are key columns that are not NULL, or whose NULLs must not meet.
    """
    taken = [f"_right_{c}" for c in on]
    renamed = other.withColumnsRenamed(dict(zip(on, taken)))
    condition = reduce(lambda a, b: a & b, [
        df[c] == renamed[t] if c in known else df[c].eqNullSafe(renamed[t]) for c, t in zip(on, taken)])
    return df.join(renamed, condition, how).drop(*taken)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               rows: int | None = None) -> DataFrame:
    """NULL-safe equi-join with a side that is usually small.

    Its rows and bytes are measured unless ``rows`` is known and the columns
    are numbers. Up to ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` it is
    broadcast; beyond that the join shuffles and adaptive execution splits hot
    keys.
    """
    if rows is None or any(kind in ("string", "binary") or "<" in kind for _, kind in small.dtypes):
        rows, size = table_size(small)
    else:
        size = rows * 8 * (len(small.columns) + 2)
    fits = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return join_keys(df, F.broadcast(small) if fits else small, on, how)


def one_row(df: DataFrame, *columns: str):
    """A one-row table as a struct column: a scalar subquery, not a join."""
    return df.select(F.struct(*(columns or df.columns)).alias("row")).scalar()
