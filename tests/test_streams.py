"""Triggers, gating, state in slices; values of generators and sinks; used folders."""

import json
import time
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from weirflow.operators import metrics
from weirflow.sources import relations, staging
from weirflow.streaming import joins as streams
from weirflow.streaming import progressive, replay

AT = datetime(2024, 1, 1)


@pytest.fixture
def stored(spark, tmp_path):
    """R and S of 60 rows each in six files."""
    for side, seed in (("r", 3), ("s", 5)):
        for part in range(6):
            rows = [((i * seed) % 7 or None, i, AT + timedelta(minutes=i)) for i in range(part * 10, part * 10 + 10)]
            df = spark.createDataFrame(rows, f"key long, {side}_id long, {side}_ts timestamp").coalesce(1)
            df.write.mode("append").parquet(str(tmp_path / side))
    r, s = (spark.read.parquet(str(tmp_path / x)).collect() for x in "rs")
    return tmp_path, Counter((a.key, a.r_id, b.s_id) for a in r for b in s if a.key is not None and a.key == b.key)


def streamed(spark, path, side, files):
    schema = spark.read.parquet(f"{path}/{side}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/{side}")


def found(df):
    return Counter(map(tuple, df.select("key", "r_id", "s_id").collect()))


@pytest.mark.parametrize("files, every", [(1, None), (100, None), (2, "100 milliseconds")])
def test_eager_and_deferred_triggers_give_the_same_pairs(spark, stored, files, every):
    path, expected = stored
    joined = streams.symmetric_hash(streamed(spark, path, "r", files), streamed(spark, path, "s", files))
    assert found(streams.drain(joined, every=every)) == expected


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("size", [1, 4, 256])
def test_join_without_acknowledgements_in_slices(spark, stored, rocksdb, monkeypatch, size):
    path, expected = stored
    monkeypatch.setattr(streams, "SLICE", size)
    monkeypatch.setattr(streams, "PAIRS", size)
    got = streams.drain(streams.acknowledged(streamed(spark, path, "r", 3), streamed(spark, path, "s", 2), salts=3))
    assert found(got) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_acknowledged_rows_are_met_no_more(spark, tmp_path, rocksdb, seed):
    """Against a list kept by hand: repeated and null ids, acknowledgements of one id, of a side, of all, and of nothing; three micro-batches."""
    import random

    rng = random.Random(seed)
    arrivals = [(rng.choice("rrssa"), rng.choice([1, 2, None]), rng.choice([None, "r", "s"]), rng.choice([None, 1, 2, 2**60 + 1, 2**60 + 2]), AT + timedelta(minutes=i)) for i in range(90)]
    live, expected = [], Counter()
    for kind, key, side, i, _ in arrivals:
        if key is None:
            continue
        if kind == "a":
            live = [x for x in live if not (x[1] == key and side in (None, x[0]) and i in (None, x[2]))]
            continue
        for other, k, j in live:
            if k == key and other != kind:
                expected[(key, i, j) if kind == "r" else (key, j, i)] += 1
        live.append((kind, key, i))
    for n in range(3):
        df = spark.createDataFrame(arrivals[30 * n : 30 * n + 30], "kind string, key long, side string, id long, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
        time.sleep(0.01)
    files = lambda: spark.readStream.schema("kind string, key long, side string, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    of = lambda k: files().where(f"kind = '{k}'").select("key", F.col("id").alias(f"{k}_id"), F.col("ts").alias(f"{k}_ts"))
    joined = streams.acknowledged(of("r"), of("s"), files().where("kind = 'a'").select("key", "side", "id", "ts"), salts=2)
    assert found(streams.drain(joined)) == expected and expected


def test_state_falls_as_rows_are_acknowledged(spark, rocksdb):
    """Every tick is acknowledged by the next: state holds two ticks' rows at most, where without acknowledgements it grows."""
    rows = [(kind, 1, i, AT + timedelta(minutes=10 * tick + n)) for tick in range(5) for n, (kind, i) in enumerate([*(("r", 100 * tick + x) for x in range(6)), ("a", None)])]
    df = spark.createDataFrame(rows, "kind string, key long, id long, ts timestamp")
    folder = replay.laid_out(df, "ts", 600_000)
    of = lambda k: replay.replay(spark, folder, df.schema).where(f"kind = '{k}'")
    r = of("r").select("key", F.col("id").alias("r_id"), F.col("ts").alias("r_ts"))
    s = of("s").select("key", F.col("id").alias("s_id"), F.col("ts").alias("s_ts"))
    none = F.lit(None).cast("string")
    held = {}
    for name, acks in (("with", of("a").select("key", none.alias("side"), none.alias("id"), "ts")), ("without", None)):
        reports = progressive.run(streams.acknowledged(r, s, acks, salts=1), lambda df, n: df.count())
        held[name] = [x.state_rows for x in progressive.batch_rates(reports, spark).orderBy("batch").collect()]
    assert max(held["with"]) < max(held["without"]) and held["without"] == sorted(held["without"])
    assert held["with"][-1] <= held["with"][0]


def test_state_of_many_keys_is_a_few_entries(spark, rocksdb):
    """Keys share the entries of a bucket, and groups of one key never do: as many entries as buckets at most, however many keys and rows there are."""
    rows = [(kind, key, i, AT + timedelta(minutes=i)) for i in range(6) for kind in "rs" for key in range(100)]
    df = spark.createDataFrame(rows, "kind string, key long, id long, ts timestamp")
    folder = replay.laid_out(df, "ts", 180_000)
    of = lambda k: replay.replay(spark, folder, df.schema).where(f"kind = '{k}'").select("key", F.col("id").alias(f"{k}_id"), F.col("ts").alias(f"{k}_ts"))
    pairs = []
    reports = progressive.run(streams.acknowledged(of("r"), of("s"), salts=3, buckets=4), lambda df, n: pairs.extend(map(tuple, df.select("key", "r_id", "s_id").collect())))
    assert Counter(pairs) == Counter((key, a, b) for key in range(100) for a in range(6) for b in range(6))
    assert max(x.state_rows for x in progressive.batch_rates(reports, spark).collect()) <= 2 * 4


def test_the_stateful_operator_is_given_few_rows(spark, rocksdb):
    """It takes rows to Python one by one, so they come as bundles: as many as buckets and tasks ask for, not as there are rows, and as many rows come out of them."""
    rows = [(key, i, AT + timedelta(minutes=i)) for i in range(100) for key in range(8)]
    df = spark.createDataFrame(rows, "key long, id long, ts timestamp")
    folder = replay.laid_out(df, "ts", 86_400_000)
    of = lambda k: replay.replay(spark, folder, df.schema).select("key", F.col("id").alias(f"{k}_id"), F.col("ts").alias(f"{k}_ts"))
    joined = streams.acknowledged(of("r"), of("s"), salts=2, buckets=2)
    query = joined.writeStream.format("memory").queryName("few").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("few").count() == 8 * 100 * 100
    plan = query._jsq.streamingQuery().lastExecution().executedPlan()
    todo, read = [plan], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("TransformWithState"):
            below = node.children().apply(0)
            while below.nodeName() != "Exchange":
                below = below.children().apply(0)
            read.append(below.metrics().apply("shuffleRecordsWritten").value())
    assert len(read) == 1 and 0 < read[0] <= 240 < 8 * 100 * 3


def test_bundles_hold_every_row_once():
    n = 100_000
    whole = pa.table({"bucket": [i * 7 % 5 for i in range(n)], "id": [None if i % 11 == 0 else str(i) for i in range(n)]})
    out = list(streams.bundled(iter([pa.RecordBatch.from_pylist([], schema=whole.schema), *whole.to_batches(max_chunksize=999)]), 128))
    got = [(b, pa.ipc.open_stream(x).read_all()) for batch in out for b, x in zip(batch["bucket"].to_pylist(), batch["bundle"].to_pylist(), strict=True)]
    assert max(len(t) for _, t in got) <= 128 and len(got) < n / 100
    assert Counter((b, i) for b, t in got for i in t["id"].to_pylist()) == Counter(zip(whole["bucket"].to_pylist(), whole["id"].to_pylist(), strict=True))
    wide = pa.table({"bucket": [1] * 50, "id": ["x" * 5000] * 50})
    assert max(len(t) for t in (pa.ipc.open_stream(x).read_all() for batch in streams.bundled(iter(wide.to_batches()), 128) for x in batch["bundle"].to_pylist())) == 1


def test_order_of_arrival_does_not_depend_on_the_time_zone(spark, tmp_path, rocksdb):
    """In the hour that comes twice: R at 1:30, its acknowledgement at 1:45, then S at 1:10 by the clock that was put back."""
    rows = [(kind, key, 1, datetime(2024, 11, 3, hour, minute)) for key in (1, 2) for kind, hour, minute in (("r", 5, 30), ("a", 5, 45), ("s", 6, 10)) if (kind, key) != ("a", 2)]
    df = spark.createDataFrame(rows, "kind string, key long, id long, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))  # the session is in UTC
    df.coalesce(1).write.parquet(str(tmp_path / "all"))
    files = lambda k: spark.readStream.schema(df.schema).parquet(str(tmp_path / "all")).where(f"kind = '{k}'")
    of = lambda k: files(k).select("key", F.col("id").alias(f"{k}_id"), F.col("ts").alias(f"{k}_ts"))
    none = F.lit(None).cast("string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = streams.drain(streams.acknowledged(of("r"), of("s"), files("a").select("key", none.alias("side"), none.alias("id"), "ts"), salts=1))
        assert [tuple(x) for x in got.select("key", F.unix_micros("r_ts"), F.unix_micros("s_ts")).collect()] == [(2, 1730611800000000, 1730614200000000)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_gating_shows_rows_when_they_have_arrived(spark):
    rows = [(1, AT), (2, AT + timedelta(milliseconds=999)), (3, AT + timedelta(seconds=1)), (4, AT + timedelta(seconds=3)), (5, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    for batches, ids in ((1, {1, 2, 5}), (3, {1, 2, 3, 5}), (4, {1, 2, 3, 4, 5})):
        got = streams.drain(streams.gated(df, "ts", 1000), batches=batches).collect()
        assert ids <= {r.id for r in got} <= {1, 2, 3, 4, 5} and len(got) == len({r.id for r in got})


def test_generated_values(spark):
    n = 20000
    keys = relations.nonunique_keys(spark, n, 50).groupBy("key").count().collect()
    assert {r.key for r in keys} == set(range(50)) and all(abs(r["count"] - n / 50) < 5 * (n / 50) ** 0.5 for r in keys)
    assert sorted(map(tuple, relations.nonunique_keys(spark, 100, 9).collect())) == sorted(map(tuple, relations.nonunique_keys(spark, 100, 9).repartition(3).collect()))
    for z in (0.0, 0.8, 1.6):
        times = relations.zipf_ts(spark.range(n).select(F.col("id").alias("rid")), 100, z).groupBy("ts").count().collect()
        weight = [j**-z for j in range(1, 101)]
        share = {j + 1: w / sum(weight) * n for j, w in enumerate(weight)}
        assert sum(r["count"] for r in times) == n and all(abs(r["count"] - share[r.ts]) < 5 * share[r.ts] ** 0.5 + 1 for r in times)
    spec = relations.RelationSpec(1000, "zipf", 20, 1.0, times="uniform", step=10, interval=3)
    made = relations.make_relation(spark, spec).collect()
    assert all(r.ts == 3 * (r.rid // 10 + 1) and 1 <= r.key <= 20 for r in made)
    assert relations.early_share(spark.range(100).select(F.col("id").alias("ts")), 100).first().share == 0.25


def test_pairs_and_metrics_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(2, 1, 7), (1, 3, 9), (1, 2, 8)], "key long, r_id long, s_id long").coalesce(1)
    relations.write_pairs(pairs, str(tmp_path / "pairs"), by_key=True)
    assert "".join(p.read_text() for p in Path(tmp_path / "pairs").glob("part*")).splitlines() == ["1 8", "1 9", "2 7"]
    relations.write_metrics(spark.createDataFrame([(0.5, 3)], "share double, i long"), str(tmp_path / "metrics"))
    assert [json.loads(x) for p in Path(tmp_path / "metrics").glob("part*") for x in p.read_text().splitlines()] == [{"share": 0.5, "i": 3}]


def test_scale_up():
    assert metrics.scale_up({1: 8.0, 2: 4.0, 4: 2.5}) == {1: 1.0, 2: 2.0, 4: 3.2}


def test_folders_are_shared_or_refused(spark, monkeypatch):
    df = staging.staged(spark.range(3))
    assert df.count() == 3
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert Path(folder).exists()
    staging.discard(df)
    assert not Path(folder).exists()

    class Session:
        """A session on a cluster without the setting."""

        class sparkContext:
            master = "spark://host:7077"
            applicationId = "app-1"

            @staticmethod
            def getConf():
                return {}

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_path(Session)
