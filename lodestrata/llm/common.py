"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, written  # noqa: F401 (the operators take them from here)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling (the first wins), whatever else the table has.

    Columns are renamed by position first, so that other columns whose names differ only in case, or repeat, do not
    make a name ambiguous.
    """
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*(df[f"`{n}`"] for n in names))
    by_position = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return by_position.select(*(F.col(f"_c{at[n]}").alias(n) for n in names))


#: What this Python worker keeps from task to task: name -> table.
KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A table that this worker keeps under a name; those under other names are let go, so that the tables of several
    operators that run one after another never add up."""
    if others := [k for k in KEPT if k != name]:
        for other in others:
            KEPT.pop(other).clear()
        give_back()
    return KEPT.setdefault(name, {})


def give_back() -> None:
    """Return the memory that this worker has freed to the system, which allocators would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def ending(run):
    """run, a function of mapInArrow, that gives memory back when its task ends: workers stay while others work."""
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of rows that the driver holds, by Arrow: plain rows would start further Python workers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds))


def drawn(df: DataFrame, most: int, n: int) -> DataFrame:
    """About `most` of the n rows of df at most, the same ones each time: those whose hash is under a threshold."""
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(1_000_003)) < F.lit(1_000_003 * most // n))


def key_crc(column: str | Column) -> Column:
    """crc32 of a key as decimal text, the remainder of which splits rows into folds; null for a null key."""
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))
