"""What the operators of this subpackage share: text rules, scratch folders, Arrow limits."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.base import forget, scratch, settled, written

__all__ = ["bound_batches", "col", "forget", "fresh", "lower_ascii", "others", "release", "scratch", "settled", "typed", "word_count", "words", "written"]

#: The white space that separates words, as characters and as the inside of a regex class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of one Arrow batch handed to a Python worker, so that very long texts can't fill its memory.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The array of words of a text; empty for null or blank texts."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def others(df: DataFrame, *added: str) -> list[str]:
    """The names of df's columns besides those that added ones replace; names that differ in case only are the same."""
    gone = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in gone]


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def typed(first: str, kind: DataType, rest: str) -> StructType:
    """A schema of one column of a given type and more in DDL."""
    return StructType([StructField(first, kind), *StructType.fromDDL(rest)])


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library; its allocator decides
    _trim = None


def release() -> None:
    """Hands the freed memory of a Python worker back to the system; an executor may keep several idle workers."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session's Python operators by rows and by bytes. The settings are read when a query runs, which is after the operator
    has returned it, so they stay; bounds that are tighter already stay as they are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
