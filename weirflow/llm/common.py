"""What the training-data operators share: word patterns, the shared folder, small column helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.staging import discard, shared_path, staged

__all__ = ["ALNUM_WORD", "PLAIN_WORD", "ascii_lower", "discard", "fresh", "shared_path", "small_batches", "written"]

#: Words as runs of non-blank characters.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
#: Words as runs of ASCII letters, digits and anything beyond ASCII; upper case included.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts that `lower` leaves alone or that are plain ASCII skip the slow path."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: later steps don't compute them a second time,
    and the loss of an executor costs no earlier work."""
    return staged(df.coalesce(partitions) if partitions else df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts that are planned to go to Python go so many at once: a worker, and Spark's buffers for it, hold a batch of them whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
