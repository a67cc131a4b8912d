"""Column expressions: hashes that name a worker or a partition, and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def worker(key: Column, n: int) -> Column:
    """key modulo n, never negative."""
    return F.pmod(key, F.lit(n))


def radix(key: Column, bits: int, skip: int = 0) -> Column:
    """`bits` bits of the key above the lowest `skip`."""
    return F.shiftright(key.bitwiseAND(((1 << bits) - 1) << skip), skip)


def leading_radix(key: Column, key_bits: int, bits: int) -> Column:
    """The highest `bits` of the `key_bits` bits of key - 1: equal parts of dense keys that begin at 1."""
    return F.shiftright((key - 1).bitwiseAND((1 << key_bits) - 1), key_bits - bits)


def next_power_of_two(x: Column) -> Column:
    """The least power of two that isn't below x; 1 for all below."""
    return F.when(x <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(x.cast("double"))))).cast("long")


def epoch_ms(ts: Column) -> Column:
    """The nearest millisecond since the epoch, halves away from zero, as SQL's epoch_ms has it; `unix_millis` takes the one below."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", us + F.when(us < 0, F.lit(-500)).otherwise(F.lit(500)), F.lit(1000))


def tumbling(ts: Column, window_ms: int) -> Column:
    """The start of the tumbling window, aligned to the epoch, in milliseconds."""
    ms = F.unix_millis(ts.cast("timestamp"))
    return ms - F.pmod(ms, F.lit(window_ms))
