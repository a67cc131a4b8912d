"""Replayed arrivals, running estimates, runs, rates, samples and late rows, with interruptions; sketches, splitters and clustered tables."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from oracle import SMALL, rows
from pyspark.sql import functions as F

from weirflow.operators import estimates, layout, metrics, partitions
from weirflow.plans import catalog
from weirflow.sources import relations
from weirflow.sources.staging import shared_path
from weirflow.streaming import joins as streams
from weirflow.streaming import progressive, replay

AT = datetime(2024, 1, 1)
MINUTE = 60_000


@pytest.fixture(scope="module")
def sides(spark):
    """R and S over 100 minutes, with repeated ids and null keys, and their pairs."""
    rng = random.Random(5)
    r, s = ([(rng.choice([1, 2, 3, None]), rng.choice([i, i // 2]), AT + timedelta(seconds=60 * i + rng.randrange(60))) for i in range(100)] for _ in "rs")
    both = {x: spark.createDataFrame(rows_, f"key long, {x}_id long, {x}_ts timestamp") for x, rows_ in (("r", r), ("s", s))}
    return both, r, s, Counter((a[0], a[1], b[1]) for a in r for b in s if a[0] is not None and a[0] == b[0])


def replayed(spark, both, names=(None, None), tick=20 * MINUTE):
    return [replay.replay(spark, replay.laid_out(both[x], f"{x}_ts", tick), both[x].schema, n) for x, n in zip("rs", names, strict=True)]


def pairs_of(df):
    return Counter(map(tuple, df.select("key", "r_id", "s_id").collect()))


def test_every_row_is_read_once_in_order_of_arrival(spark):
    """Times that are null, before 1970, and far apart; one tick has several files."""
    times = [None, datetime(1969, 12, 31), datetime(1969, 12, 31, 0, 0, 1), *(AT + timedelta(milliseconds=i) for i in range(500)), AT + timedelta(days=3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, ts timestamp").repartition(3)
    folder, seen = replay.laid_out(df, "ts", 1000), []
    progressive.run(replay.replay(spark, folder, df.schema), lambda b, n: seen.append(b.collect()))
    batches = [sorted(r.id for r in b) for b in seen if b]
    assert batches == [[0, 1], [2], list(range(3, 503)), [503]]
    assert {(r.id, r.ts) for b in seen for r in b} == set(enumerate(times))


def test_an_empty_table_replays_nothing(spark):
    df = spark.createDataFrame([], "id long, ts timestamp")
    assert streams.drain(streams.gated(df, "ts", 1000), every="0 seconds").count() == 0


def test_a_query_goes_on_where_it_stopped(spark, sides):
    both, r, s, _ = sides
    folder, mark, name, seen = replay.laid_out(both["r"], "r_ts", 20 * MINUTE), shared_path(spark), "mine", []
    for stop in (2, 1, None):
        progressive.run(replay.replay(spark, folder, both["r"].schema, name), lambda b, n: seen.append((n, sorted(x.r_ts for x in b.collect()))), mark, stop)
    numbers = [n for n, t in seen if t]
    assert numbers == sorted(set(numbers)) and sorted(t for _, ts in seen for t in ts) == sorted(x[2] for x in r)


def test_running_estimates(spark, sides):
    """The last is that of all arrivals, and a run that was interrupted twice gives what an uninterrupted one gives."""
    both, r, s, expected = sides
    whole = progressive.running_estimates(*replayed(spark, both), len(r), len(s), shared_path(spark)).orderBy("batch").collect()
    last = estimates.running_estimate(both["r"], both["s"]).orderBy(F.desc("i")).first()
    assert (whole[-1].r_seen, whole[-1].s_seen, whole[-1].matches, whole[-1].estimate) == (100, 100, sum(expected.values()), last.estimate)
    assert len(whole) == 5 and [x.matches for x in whole] == sorted(x.matches for x in whole)
    folders = [replay.laid_out(both[x], f"{x}_ts", 20 * MINUTE) for x in "rs"]
    out, mark = shared_path(spark), shared_path(spark)
    for stop in (1, 2, None):
        again = progressive.running_estimates(*(replay.replay(spark, f, both[x].schema, f"again {x}") for f, x in zip(folders, "rs", strict=True)), len(r), len(s), out, mark, stop)
    assert [tuple(x)[1:] for x in again.orderBy("batch").collect()] == [tuple(x)[1:] for x in whole]


def test_runs_and_their_merge(spark, sides):
    """Phases add up to all pairs; interrupted and repeated batches add none."""
    both, r, s, expected = sides
    folders, out, mark = [replay.laid_out(both[x], f"{x}_ts", 20 * MINUTE) for x in "rs"], shared_path(spark), shared_path(spark)
    for stop in (2, 2, None):
        progressive.sorted_runs(*(replay.replay(spark, f, both[x].schema, f"runs {x}") for f, x in zip(folders, "rs", strict=True)), out, mark, stop)
    got = progressive.merged_runs(spark, out)
    assert pairs_of(got) == expected
    tick = lambda t: int((t - min(x[2] for x in r)) / timedelta(minutes=20))
    first_s = min(x[2] for x in s)
    same = sum(a[0] == b[0] and a[0] is not None and tick(a[2]) == int((b[2] - first_s) / timedelta(minutes=20)) for a in r for b in s)
    assert got.where("phase = 'sort'").count() == same
    # the same run once more, from its beginning
    progressive.sorted_runs(*replayed(spark, both), out)
    assert pairs_of(progressive.merged_runs(spark, out)) == expected


def test_rates_are_those_of_the_batches(spark, sides):
    both, r, *_ = sides
    rates = progressive.batch_rates(progressive.run(replayed(spark, both)[0], lambda b, n: b.count()), spark).collect()
    assert len(rates) == 5 and all(x.per_ms > 0 and x.ms > 0 for x in rates) and {x.rows for x in rates} != {0}


def test_samples_are_bounded_and_say_how_many_they_stand_for(spark, sides):
    both, r, s, expected = sides
    r_, s_ = replayed(spark, both)
    out = progressive.sampled_emissions(streams.symmetric_hash(r_, s_), 30, shared_path(spark)).collect()
    per = Counter(x.batch for x in out)
    assert max(per.values()) <= 30 and sum({x.batch: x.n for x in out}.values()) == sum(expected.values())
    assert all(x.rate == min(1, 30 / x.n) and per[x.batch] == min(30, x.n) for x in out)
    assert {(x.key, x.r_id, x.s_id) for x in out} <= set(expected)


def test_a_sample_tells_how_gaps_are_spread(spark):
    """Kolmogorov distance of waits in the sample, weighed by 1 / rate, from those of all pairs."""
    got = catalog.QUERIES["latency"](spark, SMALL).collect()
    arrivals = catalog._arrivals(spark, SMALL)
    pairs = streams.symmetric_hash(catalog._arriving(spark, arrivals, "r"), catalog._arriving(spark, arrivals, "s"))
    sample = metrics.latency(progressive.sampled_emissions(pairs, 100, shared_path(spark))).collect()
    true, weight = sorted(x.latency_ms for x in got), sum(1 / x.rate for x in sample)
    assert abs(weight - len(true)) < 1e-6
    for share in range(5, 100, 5):
        at = true[len(true) * share // 100]
        assert abs(sum(1 / x.rate for x in sample if x.latency_ms <= at) / weight - share / 100) < 0.07


def test_late_rows_are_dropped_and_counted(spark):
    """Some rows are an hour late, most are not: with the delay of 80 percent some are lost, with that of all, none."""
    made = [(i, AT + timedelta(minutes=i), AT + timedelta(minutes=i - (60 if i % 10 == 9 else i % 3))) for i in range(400)]
    df = spark.createDataFrame(made, "id long, ts timestamp, at timestamp")
    top, late = AT - timedelta(days=1), []
    for _, _, at in made:
        top = max(top, at)
        late.append((top - at) / timedelta(milliseconds=1))
    some, every = progressive.disorder_delays(df, "at", "id", [0.8, 1.0])
    assert every == max(late) and sorted(late)[int(0.8 * 399)] <= some <= sorted(late)[int(0.8 * 399) + 1]
    lost = {}
    for delay in (some, every):
        kept, rates = progressive.in_time(replay.replay(spark, replay.laid_out(df, "ts", 20 * MINUTE), df.schema), "at", "id", delay, shared_path(spark))
        one = rates.agg(F.sum("rows").alias("rows"), F.sum("dropped").alias("dropped")).first()
        assert one.rows == 400 and one.dropped + kept.count() == 400
        lost[delay] = one.dropped
    assert 0 < lost[some] <= 40 and lost[every] == 0


# ---- partitions and layout


@pytest.mark.parametrize("z", [0.0, 1.2])
def test_sketched_bounds_are_near_the_exact_ranks(spark, z):
    df = relations.zipf_keys(spark, 60_000, 5_000, z).repartition(6)
    errors = partitions.rank_errors(df, "key", partitions.sketched_bounds(df, "key", 20), 20).collect()
    assert len(errors) == 19 and all(x.error <= partitions.SKETCH_ERROR for x in errors)
    bounds = [x.bound for x in sorted(errors)]
    assert bounds == sorted(bounds)
    assert partitions.sketched_bounds(df.limit(0), "key", 4).collect() == []


@pytest.mark.parametrize("z, spread", [(0.0, 1), (0.8, 1), (0.8, 10**9)])
def test_rows_are_dealt_evenly_by_splitters(spark, z, spread):
    """No part has more than 1.5 shares, unless one key alone has more than half of one."""
    df = relations.zipf_keys(spark, 40_000, 3_000, z).withColumn("key", F.col("key") * spread - 500)
    counts = df.groupBy("key").count().agg(F.max("count")).first()[0]
    parts = partitions.dealt(df, "key", 7).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("p").collect()
    assert sum(p.n for p in parts) == 40_000 and all(a.hi < b.lo for a, b in zip(parts, parts[1:], strict=False))
    assert max(p.n for p in parts) <= 1.5 * 40_000 / 7 + counts


def test_bisection(spark):
    df = spark.createDataFrame([(k,) for k in [None, -5, 0, 1, 2, 3, 9, 10, 11]], "key long")
    for bounds in ([], [1], [1, 3], [0, 1, 2, 3, 10], [3, 3, 9]):
        got = {r.key: r.part for r in partitions.part_of(df, "key", bounds).collect()}
        assert got == {r.key: sum(b <= r.key for b in bounds) if r.key is not None else 0 for r in df.collect()}


@pytest.mark.parametrize("write", [layout.clustered, layout.spread])
def test_clustered_tables_are_joined_where_they_lie(spark, write):
    rng = random.Random(2)
    r = spark.createDataFrame([(rng.choice([*range(50), None]), i) for i in range(300)], "key long, a long").repartition(3)
    s = spark.createDataFrame([(rng.choice([7, 7, *range(60), None]), i) for i in range(900)], "key long, b long").repartition(4)
    joined = layout.clustered_join(write(r, "key", 8), write(s, "key", 8), "key")
    per = layout.per_key(joined, "key", "b")
    for df in (joined, per):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert rows(joined.toPandas()) == rows(s.join(r, "key").toPandas())
    assert per.agg(F.sum("n")).first()[0] == joined.count()


def test_rows_of_one_place_come_together(spark):
    rows = [(1, AT_), (1, AT_.replace(minute=5)), (2, AT_.replace(minute=1))]
    df = spark.createDataFrame(rows, "id long, at timestamp")
    assert progressive.disorder_delays(df, "at", "id", [0.0, 0.5, 1.0]) == [0, 240_000, 300_000]


@pytest.mark.parametrize("year", [1960, 2024])
def test_late_rows_are_those_of_the_sql(spark, tmp_path, year):
    """Microseconds, repeated ids, rows repeated as a whole, and rows that are late by half a millisecond more or less than the watermark allows."""
    from oracle import same

    rng = random.Random(year)
    made = [(rng.randrange(400), datetime(year, 1, 1) + timedelta(days=i // 60, microseconds=rng.randrange(10**6)), rng.choice([0.0, rng.random() / 1e4, 30.0])) for i in range(360)]
    spark.createDataFrame([*made, *made[::3]], "event_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    same(catalog.QUERIES["stream_in_time"](spark, str(tmp_path)), catalog.SQL["stream_in_time"], str(tmp_path))


AT_ = __import__("datetime").datetime(2024, 1, 1)
