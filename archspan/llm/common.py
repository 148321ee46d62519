"""Helpers shared by the corpus operators: tables, column names, scratch space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..operators.scratch import Scratch  # noqa: F401  for the operators here

#: White space of the contracts, as a character class body of Java and Python patterns.
SPACE = r"\x20\x09-\x0D"

#: Bytes of a side that may be broadcast once its rows have been counted.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The columns that do not clash with ``names`` in any letter case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def packed(df: DataFrame, **added: Column) -> DataFrame:
    """All columns of ``df`` in a struct ``_row``, beside ``added``: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in added.items()])


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in names]


def words(text: Column) -> Column:
    """Array of maximal runs of non-space characters; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def row_key(*names: str) -> Column:
    """128-bit key of the values of some columns; null and empty differ."""
    value = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.unhex(F.md5(F.concat(*[F.coalesce(value(F.col(n).cast("string")), F.lit("-")) for n in names])))


def small(df: DataFrame, rows: int, row_bytes: int = 96) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` of about ``row_bytes`` allow it; else the join shuffles.

    Rows of ids and hashes alone take at most 96 bytes.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Bytes of rows that go to a Python worker at a time; buffers on both sides hold a multiple.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it.

    Also lowers the session's bytes of an Arrow batch to ``BATCH_BYTES``, if they are
    more: rows hold whole texts, and ten thousand of them are too many to buffer at once.
    """
    shipping.ship(spark)
    if int("".join(filter(str.isdigit, spark.conf.get(_BATCH_SETTING)))) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
