"""Joins over streams that say how far they are: running estimates, sorted runs, rates, samples, and rows that come too late.

`foreachBatch` work is keyed by the number of the micro-batch and replaces what an earlier attempt at
it has left, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor, fma

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weirflow.functions.expressions import epoch_ms
from weirflow.sources.staging import shared_path
from weirflow.streaming.joins import symmetric_hash

#: Microseconds by which times are put off under a watermark.
LATER = 1 << 58


class Progress(StreamingQueryListener):
    """Keeps what each micro-batch of one query reports."""

    def __init__(self):
        self.reports: list[dict] = []
        self.ended = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        import json

        self.reports.append(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, batches: int | None = None) -> list[dict]:
    """Runs `each` for every micro-batch (DataFrame, number) until all input is used, or for so many batches in this run; returns their reports.
    checkpoint: where to go on from and to remember; a new folder unless given."""
    spark = stream.sparkSession
    seen, done = Progress(), []

    def work(df: DataFrame, number: int) -> None:
        if batches is not None and len(done) >= batches:
            raise StopAfter
        each(df, number)
        done.append(number)

    spark.streams.addListener(seen)
    query = None
    try:
        query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint or shared_path(spark)).trigger(processingTime="0 seconds").start()
        own = str(query.runId)
        try:
            query.processAllAvailable()
        except Exception:
            if batches is None or len(done) < batches:
                raise
        query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        if query is not None and query.isActive:
            query.stop()
        spark.streams.removeListener(seen)
    return [r for r in seen.reports if r["runId"] == own]


class StopAfter(Exception):
    """Ends a query that has done the batches it was asked for."""


def _part(folder: str, number: int) -> str:
    return f"{folder}/batch={number}"


def batch_rates(reports: list[dict], spark: SparkSession) -> DataFrame:
    """(batch, rows, ms, per_ms, state_rows, dropped) of reports: a micro-batch's input and how long it took, the rows in state after it, and those that the watermark
    dropped. Batches without input and state changes are left out."""
    rows = [
        (r["batchId"], r["numInputRows"], r["batchDuration"], r["numInputRows"] / max(r["batchDuration"], 1), sum(s["numRowsTotal"] for s in r["stateOperators"]), sum(s["numRowsDroppedByWatermark"] for s in r["stateOperators"]))
        for r in reports
    ]
    return spark.createDataFrame(rows, "batch long, rows long, ms long, per_ms double, state_rows long, dropped long").where("rows > 0 OR dropped > 0")


def running_estimates(r: DataFrame, s: DataFrame, r_rows: int, s_rows: int, folder: str, checkpoint: str | None = None, batches: int | None = None) -> DataFrame:
    """Ripple estimates of a stream-stream join, one row per micro-batch: (batch, r_seen, s_seen, matches, estimate), all up to and with that batch.

    r and s are streams and r_rows and s_rows what they will have been in the end. The join's new pairs and the arrivals are counted in one pass; the counts so
    far are the state, kept in `folder` by the number of the batch."""
    spark = r.sparkSession
    kind = lambda df, name: df.select(F.lit(name).alias("kind"))
    seen = kind(symmetric_hash(r, s), "m").unionByName(kind(r, "r")).unionByName(kind(s, "s"))
    schema = "r_seen long, s_seen long, matches long"

    def each(df: DataFrame, number: int) -> None:
        count = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0))
        new = df.agg(count("r").alias("r_seen"), count("s").alias("s_seen"), count("m").alias("matches"))
        if number:
            new = new.unionByName(spark.read.schema(schema).parquet(_part(folder, number - 1))).agg(*(F.sum(c).alias(c) for c in ("r_seen", "s_seen", "matches")))
        new.coalesce(1).write.mode("overwrite").parquet(_part(folder, number))  # a single row

    run(seen, each, checkpoint, batches)
    scale = F.lit(float(r_rows)) * F.lit(float(s_rows)) / F.nullif((F.col("r_seen") * F.col("s_seen")).cast("double"), F.lit(0.0))
    out = spark.read.schema(f"{schema}, batch long").parquet(folder)
    out = out.withColumn("new", F.col("r_seen") + F.col("s_seen") - F.coalesce(F.lag(F.col("r_seen") + F.col("s_seen")).over(Window.orderBy("batch")), F.lit(0))).where("new > 0")  # a row per batch
    return out.select("batch", "r_seen", "s_seen", "matches", F.coalesce(scale * F.col("matches"), F.col("matches").cast("double")).alias("estimate"))


def sorted_runs(r: DataFrame, s: DataFrame, folder: str, checkpoint: str | None = None, batches: int | None = None) -> None:
    """The eager part of a progressive merge join over streams: every micro-batch is written below `folder` as a run, clustered and sorted by key, and the pairs within
    the run come out at once. `merged_runs` gives all others."""
    spark = r.sparkSession
    side = lambda df, x: df.select(F.lit(x).alias("side"), "key", F.col(f"{x}_id").alias("id"), F.col(f"{x}_ts").alias("ts"))
    both = side(r, "r").unionByName(side(s, "s"))

    def each(df: DataFrame, number: int) -> None:
        df.where("key IS NOT NULL").repartition("key").sortWithinPartitions("key").write.mode("overwrite").parquet(_part(f"{folder}/runs", number))
        one = spark.read.schema(both.schema).parquet(_part(f"{folder}/runs", number))
        _pairs(one, one, F.lit(True)).withColumn("phase", F.lit("sort")).write.mode("overwrite").parquet(_part(f"{folder}/pairs", number))

    run(both, each, checkpoint, batches)


def _pairs(a: DataFrame, b: DataFrame, on) -> DataFrame:
    r, s = (x.where(F.col("side") == k).drop("side").withColumnsRenamed({"id": f"{k}_id", "ts": f"{k}_ts", "batch": f"{k}_batch"}) for x, k in ((a, "r"), (b, "s")))
    return s.join(r.hint("merge"), "key").where(on).select("key", "r_id", "s_id", "r_ts", "s_ts")


def merged_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(key, r_id, s_id, r_ts, s_ts, phase): the pairs that came out of the runs, and those of members in different runs, from one merge of all runs."""
    early = spark.read.parquet(f"{folder}/pairs").drop("batch")
    runs = spark.read.parquet(f"{folder}/runs")
    return early.unionByName(_pairs(runs, runs, F.col("r_batch") != F.col("s_batch")).withColumn("phase", F.lit("merge")))


def sampled_emissions(pairs: DataFrame, size: int, folder: str, checkpoint: str | None = None) -> DataFrame:
    """A sample of a stream's pairs in one pass: of each micro-batch the `size` with the least hashes, and how many there were. (batch, n, rate, key, r_id, s_id, r_ts, s_ts);
    each stands for 1 / rate pairs. Hashes are of the pair's ids, so the sample doesn't depend on partitions, and a task keeps `size` pairs at most."""
    spark = pairs.sparkSession
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("r_id").cast("string"), F.lit("")), F.coalesce(F.col("s_id").cast("string"), F.lit(""))))

    def each(df: DataFrame, number: int) -> None:
        df.withColumn("_h", order).orderBy("_h", "r_id", "s_id").limit(size).drop("_h").write.mode("overwrite").parquet(_part(folder, number))

    seen = {}
    for r in run(pairs.observe("pairs", F.count("*").alias("n")), each, checkpoint):
        if "pairs" in r["observedMetrics"]:
            seen[r["batchId"]] = r["observedMetrics"]["pairs"]["n"]
    counts = spark.createDataFrame(list(seen.items()) or [(-1, 0)], "batch long, n long").where("n > 0")
    kept = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pairs.schema)}, batch long").parquet(folder)
    return kept.join(F.broadcast(counts), "batch").withColumn("rate", F.least(F.lit(size) / F.col("n"), F.lit(1.0)))  # a row per batch


def disorder_delays(df: DataFrame, ts: str, place: str, shares: list[float]) -> list[int]:
    """Milliseconds by which rows come after a later one has come, at most, for these shares of the rows: the delays that a watermark must allow for so many to be in
    time. place: the order of arrival. What came before a row is looked up by ranges of places, so no task has all rows."""
    from weirflow.operators.order import in_ranges, running_sum

    ms = epoch_ms(F.col(ts))
    laid = in_ranges(df.where(F.col(ts).isNotNull()).select(ms.alias("ms"), F.col(place).alias("place")), "place")
    tops = laid.groupBy("_b").agg(F.max("ms").alias("top"))
    tops = tops.select("_b", F.max("top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("top"))  # a row per range
    here = F.max("ms").over(Window.partitionBy("_b").orderBy("place"))  # rows of one place came together, and share a range
    late = laid.withColumn("here", here).join(F.broadcast(tops), "_b").select((F.greatest("here", F.coalesce("top", "here")) - F.col("ms")).alias("late"))
    upto = running_sum(late.groupBy("late").agg(F.count("*").alias("n")), "n", "late", name="before", total="whole")
    rows = upto.agg(F.max("whole")).first()[0]
    if not rows:
        return [0 for _ in shares]
    places = [x * (rows - 1) for x in shares]
    ends = sorted({f(p) for p in places for f in (floor, ceil)})
    at = F.explode(F.filter(F.array(*map(F.lit, ends)), lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))))
    late_at = {r["place"]: float(r["late"]) for r in upto.select(at.alias("place"), "late").collect()}  # two rows a share
    between = lambda p: fma(late_at[floor(p)], 1 - (p - floor(p)), late_at[ceil(p)] * (p - floor(p)))  # noqa: E731  rounded as DuckDB's quantile_cont is
    return [ceil(between(p)) for p in places]


def in_time(stream: DataFrame, ts: str, row: str, delay_ms: int, folder: str, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that a watermark with that delay lets through, each once by its id `row`, and `batch_rates` of the run, in which `dropped` is the state operator's own count of
    rows that came too late: all rows = kept + dropped, if ids don't repeat. Rows without a time are left out.

    The watermark is the latest time to the nearest millisecond less the delay. Spark takes the millisecond below, so a time of the second half of one counts as the next
    one, which makes none late that isn't; and as Spark's watermark begins in 1970, all times are put off by thousands of years."""
    us = F.greatest(F.unix_micros(F.col(ts).cast("timestamp")), epoch_ms(F.col(ts)) * 1000)
    timed = stream.where(F.col(ts).isNotNull()).withColumn("_at", F.timestamp_micros(us + F.lit(LATER)))
    kept = timed.withWatermark("_at", f"{delay_ms} milliseconds").dropDuplicates([row, "_at"])
    reports = run(kept, lambda df, number: df.drop("_at").write.mode("overwrite").parquet(_part(folder, number)), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(folder), batch_rates(reports, stream.sparkSession)
