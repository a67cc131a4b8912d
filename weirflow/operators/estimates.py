"""Early answers: matches among the first arrivals, and what they say about the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.order import in_ranges, position


def arrivals(df: DataFrame, id_col: str, ts_col: str) -> DataFrame:
    """Adds i, the place in order of arrival from 0, and n, the side's rows."""
    return position(df, ts_col, id_col, "key", name="i", total="n")


def prefix(df: DataFrame, percent: int) -> DataFrame:
    """Of arrivals(), the first percent of the rows."""
    return df.where(F.col("i") * 100 < percent * F.col("n"))


def snapshots(r: DataFrame, s: DataFrame, percents: list[int]) -> DataFrame:
    """(pct, n): matches among the first pct percent of each side. One join: a pair counts from the percent on at which both are there."""
    r, s = arrivals(r, "r_id", "r_ts"), arrivals(s, "s_id", "s_ts")
    mark = lambda df, name: df.select("key", (F.floor(F.col("i") * 100 / F.col("n")) + 1).alias(name))
    both = mark(r, "rp").join(mark(s, "sp"), "key").select(F.greatest("rp", "sp").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    wanted = F.explode(F.array(*map(F.lit, percents)))
    return both.withColumn("pct", wanted).groupBy("pct").agg(F.sum(F.when(F.col("p") <= F.col("pct"), F.col("n")).otherwise(0)).alias("n"))


def ripple_estimate(r: DataFrame, s: DataFrame, percent: int) -> DataFrame:
    """One row: rows seen of each side, their matches, and the matches of the whole as that lets expect (null if nothing was seen)."""
    r, s = arrivals(r, "r_id", "r_ts"), arrivals(s, "s_id", "s_ts")
    a, b = prefix(r, percent), prefix(s, percent)
    size = lambda df, whole, seen: df.agg(F.max("n").alias(whole), F.sum((F.col("i") * 100 < percent * F.col("n")).cast("long")).alias(seen))
    found = a.select("key").join(b.select("key"), "key").agg(F.count("*").alias("seen_matches"))
    one = found.join(F.broadcast(size(r, "nr", "r_seen")), F.lit(True)).join(F.broadcast(size(s, "ns", "s_seen")), F.lit(True))  # single rows
    scale = F.col("nr").cast("double") * F.col("ns") / F.nullif((F.col("r_seen") * F.col("s_seen")).cast("double"), F.lit(0.0))
    return one.select("r_seen", "s_seen", "seen_matches", (scale * F.col("seen_matches")).alias("estimate"))


def running_estimate(r: DataFrame, s: DataFrame) -> DataFrame:
    """One row per arrival of either side (equal times: R first; then by id): side, key, id, ts, i (its place from 0), and what is known
    once it is there: r_seen, s_seen, matches, and estimate, the matches of the whole as those let expect (the matches themselves while a side has none).

    What an arrival matches is the number of rows of its key on the other side before it: rows of the same range are counted
    in order, those of earlier ranges by (key, range), so neither pairs nor a whole key ever meet in a task. Null keys match nothing.
    """
    one = lambda df, side: df.select(F.lit(side).alias("side"), "key", F.col(f"{side}_id").alias("id"), F.col(f"{side}_ts").alias("ts"))
    laid = in_ranges(one(r, "r").unionByName(one(s, "s")), "ts", "side", "id", "key")
    is_r, is_s = ((F.col("side") == x).cast("long") for x in "rs")
    # by key and range: rows of that key in earlier ranges
    per = laid.where("key IS NOT NULL").groupBy("key", "_b").agg(F.sum(is_r).alias("_nr"), F.sum(is_s).alias("_ns"))
    earlier = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per range at most
    per = per.select("key", "_b", *(F.coalesce(F.sum(f"_n{x}").over(earlier), F.lit(0)).alias(f"_e{x}") for x in "rs"))
    here = Window.partitionBy("key", "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    upto = laid.withColumns({"_hr": F.sum(is_r).over(here), "_hs": F.sum(is_s).over(here)}).join(per, ["key", "_b"], "left")
    new = F.coalesce(F.when(F.col("side") == "r", F.col("_es") + F.col("_hs")).otherwise(F.col("_er") + F.col("_hr")), F.lit(0))
    upto = upto.withColumn("_new", new)
    # and by range: arrivals and matches of all earlier ranges
    own = Window.partitionBy("_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"r_seen": is_r, "s_seen": is_s, "matches": F.col("_new")}
    out = upto.withColumns({k: F.sum(v).over(own) for k, v in sums.items()}).withColumn("i", F.col("_r"))
    ranges = upto.groupBy("_b").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()), F.count("*").alias("_i"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    every = Window.partitionBy()
    ranges = ranges.select(
        F.col("_b").alias("_k"), *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in (*sums, "i")), F.sum("_r_seen").over(every).alias("_nr"), F.sum("_s_seen").over(every).alias("_ns")
    )
    out = out.join(F.broadcast(ranges), F.col("_b") == F.col("_k"))
    out = out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in (*sums, "i")})
    scale = F.col("_nr").cast("double") * F.col("_ns") / F.nullif((F.col("r_seen") * F.col("s_seen")).cast("double"), F.lit(0.0))
    return out.select("side", "key", "id", "ts", "i", "r_seen", "s_seen", "matches", F.coalesce(scale * F.col("matches"), F.col("matches").cast("double")).alias("estimate"))
