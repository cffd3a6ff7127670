"""Column expressions and readers that several corpus operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system: workers outlive their tasks, and stages add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; a text of ASCII only takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_row(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns packed into one struct, so that no helper column can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def unpack(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in columns])


def field(column: str, name: str = "row") -> Column:
    return F.col(f"{name}.`{column}`")
