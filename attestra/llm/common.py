"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, staged

__all__ = ["ASCII_SPACE", "bounded_broadcast", "byte_texts", "documents", "let", "shared_dir", "staged", "str_texts"]

#: ASCII white space, the only word separators of this subpackage.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def bounded_broadcast(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A staged table of narrow rows, to be broadcast if it has at most ``rows`` of them; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it.

    Higher-order functions are interpreted, so a repeated expression inside one
    would otherwise run again for each mention and each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_steps(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of an Arrow column, of which only some are Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return _in_steps(pc.fill_null(column.cast(pa.binary()), b""))


def str_texts(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column; null counts as empty."""
    return _in_steps(pc.fill_null(column, ""))
