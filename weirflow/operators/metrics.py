"""What a stream join is measured by, in event time: when a pair could first be known, how late, how steadily, how out of order.

A pair is emitted when its later member arrives. Matches are ranked in order of emission by ranges (see
`position`), so a metric over all matches is never one task's sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.order import position, running_sum


def emissions(pairs: DataFrame) -> DataFrame:
    """pairs with emit, the time of the later member, and side, whose arrival it was (equal times: S's)."""
    return pairs.withColumn("emit", F.greatest("r_ts", "s_ts")).withColumn("side", F.when(F.col("r_ts") > F.col("s_ts"), F.lit("R")).otherwise(F.lit("S")))


def emission_counts(pairs: DataFrame) -> DataFrame:
    return emissions(pairs).groupBy(F.col("emit").alias("t"), "side").agg(F.count("*").alias("n"))


def ranked(pairs: DataFrame) -> DataFrame:
    """emissions with i, the place in order of emission, and n, how many there are."""
    return position(emissions(pairs), "emit", "r_id", "s_id", name="i", total="n")


def latency(pairs: DataFrame, window_ms: int = 0) -> DataFrame:
    """Adds latency_ms: how long the earlier member waited for the pair; lazy joins, which wait for the window's end, add its length once."""
    ms = (F.unix_micros(F.greatest("r_ts", "s_ts").cast("timestamp")) - F.unix_micros(F.least("r_ts", "s_ts").cast("timestamp"))) / 1000
    return pairs.withColumn("latency_ms", ms + F.lit(window_ms))


def emitted_at(pairs: DataFrame, **places: Callable[[Column], Column]) -> DataFrame:
    """(name, i, emit) for each named place, a function of the number of matches: the zero-based place i in order of emission, and when that match was emitted.
    Matches are counted by time first, so what is put in order is one row per time, and no match itself."""
    counts = emissions(pairs).groupBy("emit").agg(F.count("*").alias("here"))
    upto = running_sum(counts, "here", "emit", name="before", total="n")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), of(F.col("n")).cast("long").alias("i")) for name, of in places.items())))
    found = upto.withColumn("at", wanted).select("before", "here", "emit", "at.*")
    return found.where((F.col("i") >= F.col("before")) & (F.col("i") < F.col("before") + F.col("here"))).select("name", "i", "emit")


def at_share(pairs: DataFrame, share: float) -> DataFrame:
    """(i, emit) of the match of zero-based place floor(share n): share 0.95 is the 95th percentile."""
    return emitted_at(pairs, share=lambda n: F.floor(n * share)).select("i", "emit")


def time_to(pairs: DataFrame, shares: list[float]) -> DataFrame:
    """(share, i, emit): when that share of all matches was known; the match of place ceil((n - 1) share)."""
    found = emitted_at(pairs, **{str(x): lambda n, x=x: F.ceil((n - 1) * x) for x in shares})
    return found.select(F.col("name").cast("double").alias("share"), "i", "emit")


def progress(ranked_pairs: DataFrame) -> DataFrame:
    """(i, y): the share of matches known by the i-th; a single match is 0."""
    return ranked_pairs.select("i", F.coalesce(F.col("i") / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("y"))


def sampled(ranked_pairs: DataFrame, every: int) -> DataFrame:
    """Every `every`-th match in order of emission, beginning with the first."""
    return ranked_pairs.where(F.col("i") % every == 0)


def disorder(pairs: DataFrame, every: int = 1) -> DataFrame:
    """(gap, n): of matches that S's arrival completes, S's place of arrival less the match's place; of every `every`-th match only, counted among those.
    pairs: with s_place, S's place of arrival, which came along with S's rows; so ids may repeat or be null."""
    own = pairs.where(F.col("s_ts") >= F.col("r_ts")).select("s_ts", "s_id", "r_id", "s_place")
    own = position(own, "s_ts", "s_id", "r_id", "s_place", name="m").where(F.col("m") % every == 0)
    return own.groupBy((F.col("s_place") - F.floor(F.col("m") / every)).alias("gap")).agg(F.count("*").alias("n"))


def gap_cdf(gaps: DataFrame) -> DataFrame:
    """(gap, share): the share of matches with that gap or a smaller one; one row per gap."""
    upto = running_sum(gaps, "n", "gap", name="before", total="whole")
    return upto.select("gap", ((F.col("before") + F.col("n")) / F.col("whole")).alias("share"))


def throughput(r: DataFrame, s: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: inputs of both sides, the milliseconds from the first arrival to the last match in event time, and inputs per millisecond (null without a match)."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    one = r.select(F.col("r_ts").alias("ts")).unionByName(s.select(F.col("s_ts").alias("ts"))).agg(F.count("*").alias("inputs"), F.min(ms(F.col("ts"))).alias("first"))
    last = pairs.agg(F.max(ms(F.greatest("r_ts", "s_ts"))).alias("last"))
    both = one.join(F.broadcast(last), F.lit(True))  # single rows
    span = F.col("last") - F.col("first")
    return both.select("inputs", span.alias("ms"), (F.col("inputs") / F.nullif(span, F.lit(0))).alias("per_ms"))


def scale_up(seconds: dict[int, float]) -> dict[int, float]:
    """Throughput on so many workers, relative to the fewest that were timed."""
    return {n: seconds[min(seconds)] / s for n, s in seconds.items()}
