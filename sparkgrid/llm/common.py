"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.session import join_small

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ROOT = str(Path(__file__).resolve().parents[2])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character, accented capitals too, stays."""
    return F.translate(c, UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where the package is not installed on the executors nor on a shared path,
    submit it with ``--py-files``. Batches of rows become smaller, unless the
    session has a size of its own.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    for name, default, value in BATCH_SETTINGS:
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


# Rows and bytes of a batch between the JVM and a Python worker, after Spark's own defaults: documents, and blocks of
# them, are long rows, and both sides hold a batch several times.
BATCH_SETTINGS = [("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
                  ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")]


def released() -> None:
    """Give memory that is free now back to the system: a worker lives on after its task, and idles or serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def lean(function):
    """A task's generator that releases its memory at its end."""
    @wraps(function)
    def wrapped(*args):
        yield from function(*args)
        released()
    return wrapped


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that added columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, name: str = "row", **added: Column) -> DataFrame:
    """The packed columns, followed by ``added``; an added name replaces a packed one."""
    inner = df.schema[name].dataType.names
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in inner if c not in added],
                     *[c.alias(n) for n, c in added.items()])


def sample_texts(df: DataFrame, most: int, chars: int, text: str = "text", id_column: str = "doc_id") -> list[str]:
    """Texts of up to ``most`` documents of at most ``chars`` characters, the same for the same ids."""
    bodies = df.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text).alias("text"))
    chosen = df.select(F.col(f"`{id_column}`").alias("id")).where("id is not null").distinct().orderBy(
        F.xxhash64("id"), "id").limit(most)
    rows = join_small(bodies.where(F.char_length("text") <= chars), chosen, ["id"])
    return [r.text for r in rows.dropDuplicates(["id"]).orderBy("id").select("text").collect()]
