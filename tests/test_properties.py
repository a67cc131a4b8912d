"""Sources and metrics on rows with null, repeated and sparse ids and times."""

from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.operators import estimates, metrics
from weirflow.operators.strategies import window_join
from weirflow.sources import relations
from weirflow.spec import JoinSpec

AT = datetime(2024, 1, 1)
some = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
IDS = st.one_of(st.none(), st.integers(-3, 5), st.integers(10**17, 10**17 + 3))
TIMES = st.one_of(st.none(), st.integers(0, 5), st.integers(0, 10**6))


def nulls_first(x):
    return (x is not None, x if x is not None else 0)


@some
@given(st.lists(st.tuples(IDS, TIMES), max_size=40))
def test_smooth(spark, made):
    got = relations.smooth(spark.createDataFrame(made, "rid long, ts long")).collect()
    times = sorted({t for _, t in made if t is not None})
    expected = [(i, None) for i, t in made if t is None]
    for t, after in zip(times, [*times[1:], None], strict=False):
        run = sorted((i for i, x in made if x == t), key=nulls_first)
        expected += [(i, t if after is None else int(t + j * ((after - t) / len(run)))) for j, i in enumerate(run)]
    key = lambda r: str(tuple(r))
    # rows of equal ids and times may change places
    assert Counter(r.rid for r in got) == Counter(i for i, _ in made)
    assert sorted((r.ts for r in got), key=nulls_first) == sorted((t for _, t in expected), key=nulls_first)
    if len({(i, t) for i, t in made}) == len(made):
        assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@some
@given(st.lists(IDS, max_size=40), st.integers(1, 50), st.sampled_from([0.0, 1.1]))
def test_rows_keep_their_ids_whatever_they_are(spark, ids, size, z):
    df = spark.createDataFrame([(i, "x") for i in ids], "rid long, other string")
    for made, column, low, high in (
        (relations.zipf_ts(df, size, z), "ts", 1, size),
        (relations.zipf_keys_of(df, size, z, "rid"), "key", 1, size),
        (relations.nonunique_keys_of(df, size, "rid"), "key", 0, size - 1),
        (relations.uniform_ts_of(df, 3, 5, "rid"), "ts", 5, 5 * (len(ids) // 3 + 1)),
        (relations.round_robin(df, size, "rid"), "part", 0, size - 1),
        (relations.unique_keys_of(df, "rid"), "key", 1, max(len(ids), 1)),
    ):
        got = made.collect()
        assert Counter(r.rid for r in got) == Counter(ids) and {r.other for r in got} <= {"x"}
        assert all(low <= r[column] <= high for r in got)
    assert len({r.key for r in relations.unique_keys_of(df, "rid").collect()}) == len(ids)


def test_draws_are_those_of_dense_rids(spark):
    dense = spark.range(500).select(F.col("id").alias("rid"))
    sparse = dense.select((F.col("rid") * 1000 + 7).alias("rid"))
    a, b = ({r.rid: r.ts for r in relations.zipf_ts(x, 40, 0.8).collect()} for x in (dense, sparse))
    assert {i * 1000 + 7: t for i, t in a.items()} == b
    assert a == {r.rid: r.key for r in relations.zipf_keys(spark, 500, 40, 0.8, 54321, "incremental").collect()}


@some
@given(st.lists(st.tuples(st.integers(0, 2), IDS, TIMES), max_size=14), st.lists(st.tuples(st.integers(0, 2), IDS, TIMES), max_size=14), st.integers(1, 4))
def test_metrics(spark, r, s, every):
    at = lambda t: None if t is None else AT + timedelta(seconds=t)
    left = spark.createDataFrame([(k, i, at(t)) for k, i, t in r], "key long, r_id long, r_ts timestamp_ntz")
    right = spark.createDataFrame([(k, i, at(t)) for k, i, t in s], "key long, s_id long, s_ts timestamp_ntz")
    placed = estimates.arrivals(right, "s_id", "s_ts").withColumnRenamed("i", "s_place")
    pairs = window_join(left, placed, JoinSpec("PRH"))
    timed = [(rt, ri, st_, si) for k, ri, rt in r for q, si, st_ in s if k == q and rt is not None and st_ is not None]
    assert sum(x.n for x in metrics.disorder(pairs, every).collect()) == -(-sum(a <= b for a, _, b, _ in timed) // every)
    if len({x for x in s}) == len(s) and len({x for x in r}) == len(r):
        order = sorted(s, key=lambda x: (nulls_first(x[2]), nulls_first(x[1]), x[0]))
        full = [(b, si, ri, place) for k, ri, a in r for place, (q, si, b) in enumerate(order) if k == q and a is not None and b is not None and a <= b]
        full.sort(key=lambda x: (x[0], nulls_first(x[1]), nulls_first(x[2]), x[3]))
        assert {x.gap: x.n for x in metrics.disorder(pairs, every).collect()} == Counter(place - m // every for m, (*_, place) in enumerate(full) if m % every == 0)
    known = [x for x in metrics.emission_counts(pairs).collect()]
    assert sum(x.n for x in known) == sum(k == q for k, *_ in r for q, *_ in s)
    ranked = metrics.ranked(pairs).collect()
    assert sorted(x.i for x in ranked) == list(range(len(ranked)))
    assert len(metrics.latency(pairs).where("latency_ms IS NOT NULL").collect()) >= len(timed)


def test_relations_have_as_many_rows_as_asked_for(spark):
    for rows, copies in ((10, 3), (9, 3), (1, 4), (0, 2), (7, 1)):
        made = relations.make_relation(spark, relations.RelationSpec(rows, duplicates=copies)).collect()
        assert sorted(r.rid for r in made) == list(range(rows)) and max(Counter(r.key for r in made).values(), default=0) <= copies


def test_what_is_small_counts_bytes_too(spark):
    from weirflow.operators.strategies import is_small

    df = spark.createDataFrame([(i, "x" * 100, [1, 2]) for i in range(10)], "key long, r_id string, r_ts array<int>")
    assert is_small(df, 10, 2000) and not is_small(df, 9, 2000) and not is_small(df, 10, 1000) and is_small(df.limit(0), 0, 0)


@some
@given(st.lists(st.tuples(st.integers(0, 1), TIMES), max_size=12), st.lists(st.tuples(st.integers(0, 1), TIMES), max_size=12))
def test_places_in_order_of_emission(spark, r, s):
    at = lambda t: None if t is None else AT + timedelta(seconds=t)
    left = spark.createDataFrame([(k, 1, at(t)) for k, t in r], "key long, r_id long, r_ts timestamp_ntz")
    right = spark.createDataFrame([(k, 1, at(t)) for k, t in s], "key long, s_id long, s_ts timestamp_ntz")
    pairs = window_join(left, right, JoinSpec("PRH"))
    ranked = {x.i: x.emit for x in metrics.ranked(pairs).collect()}
    n = len(ranked)
    assert {(x.i, x.emit) for x in metrics.at_share(pairs, 0.5).collect()} == ({(n // 2, ranked[n // 2])} if n else set())
    assert {(x.share, x.i, x.emit) for x in metrics.time_to(pairs, [0.0, 1.0]).collect()} == ({(0.0, 0, ranked[0]), (1.0, n - 1, ranked[n - 1])} if n else set())


def test_smooth_before_1970_is_its_sql(spark, tmp_path):
    from datetime import datetime, timedelta

    from oracle import same

    from weirflow.plans import catalog

    rows = [(i, datetime(1969, 12, 1) + timedelta(minutes=37 * i * (1 + i % 3))) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    same(catalog.QUERIES["smooth"](spark, str(tmp_path)), catalog.SQL["smooth"], str(tmp_path))


def test_smooth_takes_the_nearest_millisecond_as_its_sql(spark, tmp_path):
    """Times half a millisecond or less before an hour, on both sides of 1970, are of that hour."""
    from oracle import same

    from weirflow.plans import catalog

    at = lambda hour, us: datetime(1970, 1, 1) + timedelta(hours=hour, microseconds=us)
    times = [at(h, us) for h in (-9, -1, 0, 1, 7, 12) for us in (-1001, -1000, -501, -500, -499, -1, 0, 1, 499, 500, 501)] + [None]
    spark.createDataFrame(list(enumerate(times)), "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    same(catalog.QUERIES["smooth"](spark, str(tmp_path)), catalog.SQL["smooth"], str(tmp_path))
