"""All strategies give the same pairs, whatever the input; hints make the plans that they name."""

import random
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.operators import strategies
from weirflow.operators.strategies import STRATEGIES, window_join
from weirflow.sources import relations
from weirflow.spec import JoinSpec

R = "key long, r_id long, r_ts timestamp_ntz"
S = "key long, s_id long, s_ts timestamp_ntz"


def sides(spark, r_keys, s_keys):
    from datetime import datetime, timedelta

    at = lambda i: datetime(2024, 1, 1) + timedelta(minutes=7 * i)
    r = spark.createDataFrame([(k, i, at(i)) for i, k in enumerate(r_keys)], R)
    s = spark.createDataFrame([(k, i, at(i)) for i, k in enumerate(s_keys)], S)
    return r, s


def expected(r_keys, s_keys):
    return sorted((a, i, j) for i, a in enumerate(r_keys) for j, b in enumerate(s_keys) if a is not None and a == b)


CASES = {
    "empty side": ([], [1, 2, 3]),
    "disjoint": ([1, 2, 3], [4, 5]),
    "null keys": ([None, 1, None], [None, 1, 1]),
    "one hot key": ([7] * 12 + [1], [7] * 15 + [2]),
    "unique": (list(range(1, 30)), list(range(29, 0, -1))),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", ["NPO", "PRO", "PRH", "m-way", "m-pass", "m-way+skew", "SHJ_JB_NP", "SHJ_JBCR_NP", "SHJ_HS_NP", "PMJ_JB_NP", "PMJ_JBCR_NP"])
def test_same_pairs(spark, name, case):
    r_keys, s_keys = CASES[case]
    got = window_join(*sides(spark, r_keys, s_keys), JoinSpec(name, workers=3)).select("key", "r_id", "s_id").collect()
    assert sorted(map(tuple, got)) == expected(r_keys, s_keys)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25), st.sampled_from(sorted(STRATEGIES)))
def test_any_keys(spark, r_keys, s_keys, name):
    got = window_join(*sides(spark, r_keys, s_keys), JoinSpec(name, workers=2, group_size=3)).select("key", "r_id", "s_id").collect()
    assert sorted(map(tuple, got)) == expected(r_keys, s_keys)


@pytest.mark.parametrize("name, node", [("NPO", "BroadcastHashJoin"), ("PRH", "ShuffledHashJoin"), ("m-way", "SortMergeJoin"), ("PRO", "ShuffledHashJoin")])
def test_plan(spark, name, node):
    r, s = sides(spark, [1, 2], [2, 3])
    plan = STRATEGIES[name](r, s, JoinSpec(name))._jdf.queryExecution().executedPlan().toString()
    assert node in plan and "Cartesian" not in plan


def test_large_side_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(strategies, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(strategies, "is_small", lambda df, rows=3: df.limit(rows + 1).count() <= rows)
    r, s = sides(spark, [1, 2, 3, 4, 5], [1, 2])
    plan = strategies.broadcast_hash(r, s)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_window_boundaries(spark):
    r, s = sides(spark, [1] * 10, [1] * 10)
    got = window_join(r, s, JoinSpec("PRH", window_ms=3_600_000)).select("r_id", "s_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i in range(10) for j in range(10) if i * 7 // 60 == j * 7 // 60)


def test_unique_keys_and_files(spark, tmp_path):
    keys = relations.unique_keys(spark, 1280).collect()
    assert sorted(k.key for k in keys) == list(range(1, 1281)) and [k.key for k in keys] != sorted(k.key for k in keys)
    rng = random.Random(3)
    data = [(rng.randrange(100), i * 3) for i in range(50)]
    (tmp_path / "a.csv").write_text("".join(f"{k}|x|{t}\n" for k, t in data))
    got = relations.read_delimited(spark, str(tmp_path / "a.csv"), 0, 2).select("key", "ts").collect()
    assert sorted(map(tuple, got)) == sorted(data)
    (tmp_path / "b.csv").write_text("".join(f"{t},{k}\n" for k, t in data))
    got = relations.read_delimited(spark, str(tmp_path / "b.csv"), 1).collect()
    assert sorted(x.key for x in got) == sorted(k for k, _ in data) and {x.ts for x in got} == {None}


def test_sinks(spark, tmp_path):
    df = relations.uniform_ts(relations.foreign_keys(spark, 100, 7), 10, 5)
    relations.write_relation(df.coalesce(1), str(tmp_path / "rel"))
    lines = "".join(p.read_text() for p in Path(tmp_path / "rel").glob("part*")).splitlines()
    assert lines[0] == "#KEY VAL" and len(lines) == 101 and "1 0" in lines
    relations.write_times(df, str(tmp_path / "ts"))
    assert spark.read.text(str(tmp_path / "ts")).count() == 100


def test_generators(spark):
    from weirflow.sources.relations import RelationSpec, make_relation

    for spec in (RelationSpec(200, "zipf", 50, 1.2), RelationSpec(200, "nonunique", 40), RelationSpec(200, "unique", times="zipf", window=100, ts_skew=0.8), RelationSpec(200, duplicates=4, times="uniform")):
        df = make_relation(spark, spec)
        assert df.count() == 200 and df.select("rid").distinct().count() == 200
    z = relations.zipf_keys(spark, 5000, 100, 1.2, kind="incremental").groupBy("key").count().orderBy(F.desc("count")).first()
    assert z["key"] == 1
    assert relations.foreign_keys_of(relations.unique_keys(spark, 10).limit(0), 5).count() == 0


@pytest.mark.parametrize("name", sorted(STRATEGIES))
def test_repeated_and_null_ids(spark, name):
    """Pairs as often as their rows are there, whatever the ids and times: repeated, equal in all columns, or null."""
    from datetime import datetime

    at = datetime(2024, 1, 1)
    r = [(1, 7, at), (1, 7, at), (1, None, None), (2, 7, at), (2, 9, None), (None, 7, at)]
    s = [(1, 5, at), (1, None, at), (1, None, None), (2, 5, at), (2, 5, at), (3, None, at), (None, None, None)]
    got = window_join(spark.createDataFrame(r, R), spark.createDataFrame(s, S), JoinSpec(name, group_size=3)).select("key", "r_id", "s_id").collect()
    assert Counter(map(tuple, got)) == Counter((a, i, j) for a, i, _ in r for b, j, _ in s if a is not None and a == b)


@pytest.mark.parametrize("name", ["SHJ_JBCR_NP", "SHJ_HS_NP", "m-way+skew", "SHJ_JM_NP"])
def test_ids_may_be_text(spark, name):
    r = spark.createDataFrame([(1, "a", None), (2, "b", None)], R.replace("r_id long", "r_id string"))
    s = spark.createDataFrame([(1, "x", None), (1, None, None)], S.replace("s_id long", "s_id string"))
    got = window_join(r, s, JoinSpec(name)).select("key", "r_id", "s_id").collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 'a', 'x')", "(1, 'a', None)"]


@pytest.mark.parametrize("name", ["SHJ_JM_NP", "SHJ_JB_NP", "m-pass", "RPJ_JB_NP"])
def test_partitions_are_left_to_spark(spark, name):
    """No shuffle into a number of partitions of its own, and none of the pairs."""
    r, s = sides(spark, range(50), range(50))
    plan = STRATEGIES[name](r, s, JoinSpec(name))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan and "RoundRobin" not in plan and "rangepartitioning" not in plan


def heights(laid):
    return [r["n"] for r in laid.groupBy("_b").agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("ts", ["null", "equal", "second", "spread"])
def test_positions_follow_the_data(spark, ts):
    """However times are spread, no range holds much more than its share."""
    from weirflow.operators.order import in_ranges, position

    time = {"null": "CAST(NULL AS TIMESTAMP)", "equal": "TIMESTAMP '2024-01-01'", "second": "timestamp_micros(1704067200000000 + id * 37 % 1000000)", "spread": "timestamp_micros(id * id * 1000)"}[ts]
    df = spark.range(20000).selectExpr("id", f"{time} AS ts").repartition(5)
    got = position(df, "ts", "id", total="n").collect()
    assert [r.i for r in sorted(got, key=lambda r: (str(r.ts), r.id))] == list(range(20000)) and {r.n for r in got} == {20000}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        assert max(heights(in_ranges(df, "ts", "id"))) <= 2 * 20000 / 4
        assert [r.i for r in sorted(position(df, "ts", "id").collect(), key=lambda r: (str(r.ts), r.id))] == list(range(20000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_and_following(spark):
    from weirflow.operators.order import following, position, running_sum

    df = spark.range(1, 1001).selectExpr("id * 7 % 1009 AS k", "id AS v")
    rows = sorted((r.k, r.v) for r in df.collect())
    got = {r.k: (r.upto, r.whole) for r in running_sum(df, "v", "k", name="upto", total="whole").collect()}
    assert got == {k: (sum(v for j, v in rows if j < k), 500500) for k, _ in rows}
    nexts = {r.k: r.nxt for r in following(df, "k", "nxt").collect()}
    assert nexts == {k: n for (k, _), n in zip(rows, [*(k for k, _ in rows[1:]), None], strict=True)}
    none = df.limit(0)
    assert not position(none, "k").count() and not running_sum(none, "v", "k", name="x").count() and not following(none, "k", "x").count()


def test_ripple_pairs_have_the_estimate_of_their_time(spark):
    r, s = sides(spark, [1, 2, 1, None], [1, 1, 3, 2])
    got = {(x.r_id, x.s_id): x.estimate for x in window_join(r, s, JoinSpec("RPJ_JBCR_NP")).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 3), (2, 0), (2, 1)}
    arrivals = sorted([(i, 0, k) for i, k in enumerate([1, 2, 1, None])] + [(i, 1, k) for i, k in enumerate([1, 1, 3, 2])])
    for (a, b), estimate in got.items():
        last = max((a, 0), (b, 1))
        seen = [x for x in arrivals if x[:2] <= last]
        rs, ss = [k for _, side, k in seen if side == 0], [k for _, side, k in seen if side == 1]
        matches = sum(x == y and x is not None for x in rs for y in ss)
        assert estimate == pytest.approx(16 / (len(rs) * len(ss)) * matches)


@pytest.mark.parametrize("name", [n for n in STRATEGIES if n.endswith("_st")])
def test_no_strategy_puts_whole_inputs_in_one_task(spark, name):
    r, s = sides(spark, range(50), range(50))
    plan = STRATEGIES[name](r.repartition(4), s.repartition(4), JoinSpec(name))._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan
