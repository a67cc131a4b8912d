"""Eager joins: pairs come out as soon as both members have arrived.

Each function starts a query over streams of R and S (key, r_id, r_ts / key, s_id, s_ts) that writes
pairs to Parquet. `drain` runs it over all that is there, at once or by intervals, and returns the pairs. Without a watermark
state is kept for ever, as within one window; `late` bounds it for windowed joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from weirflow.sources.staging import remove, shared_path
from weirflow.streaming.replay import laid_out, replay

SIDES = ("r", "s")
#: Rows that are stored in state as one entry and read at once, pairs that are given out at once, groups that a key's rows are dealt to, and buckets of these groups.
SLICE, PAIRS, SALTS, BUCKETS = 1 << 14, 1 << 16, 4, 256
#: Rows and bytes of a bucket that go to its work as one bundle, about, and rows that a task makes bundles of at a time.
BUNDLE, BUNDLE_BYTES, HELD = 128, 1 << 13, 1 << 16
#: A place after all others, and the time (in microseconds) of rows without one.
NEVER, UNTIMED = 1 << 62, -(1 << 62)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet file or folder as a stream of its files. The source takes a single file only as a pattern, so the path is made one."""
    schema: StructType = spark.read.parquet(path).schema
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def gated(df: DataFrame, ts: str, tick_ms: int) -> DataFrame:
    """Arrival gating: df's rows as a stream in which a micro-batch holds what arrived in the next `tick_ms` in which anything did; rows without a time are there
    from the start. Each row is read once, see `replay`."""
    return replay(df.sparkSession, laid_out(df, ts, tick_ms), df.schema)


def drain(pairs: DataFrame, schema: str | StructType | None = None, every: str | None = None, batches: int | None = None) -> DataFrame:
    """Runs the streaming DataFrame until all input is used, then reads what came out.

    every: None takes what is there in as many micro-batches as the source makes of it, one after the other (eager if a batch is a
    file, see `stream_of`); an interval ("10 seconds") waits so long between them, so what arrives meanwhile is joined at once
    (deferred). batches: stops after so many, for sources that never end.
    """
    spark = pairs.sparkSession
    out, mark = shared_path(spark), shared_path(spark)
    writer = pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
    if every is None and batches is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime=every or "0 seconds").start()
        try:
            if batches is None:
                query.processAllAvailable()
            else:
                while query.isActive and not (query.lastProgress and query.lastProgress["batchId"] + 1 >= batches):
                    query.awaitTermination(0.1)
        finally:
            query.stop()
        if query.exception():
            raise query.exception()
    remove(spark, mark)
    return spark.read.schema(schema or pairs.schema).parquet(out)


def symmetric_hash(r: DataFrame, s: DataFrame) -> DataFrame:
    """Stream-stream: both sides are kept by key, and each arrival meets what is there of the other side."""
    return r.join(s, "key").select("key", "r_id", "s_id", "r_ts", "s_ts")


def windowed(r: DataFrame, s: DataFrame, size: str, late: str = "0 seconds") -> DataFrame:
    """Stream-stream within tumbling windows; state goes once the watermark has passed its window."""
    side = lambda df, ts: df.withWatermark(ts, late).withColumn("window", F.window(ts, size)).drop(ts)
    return side(r, "r_ts").join(side(s, "s_ts"), ["key", "window"]).select("key", F.col("window.start").alias("window"), "r_id", "s_id")


def within(r: DataFrame, s: DataFrame, before: str, after: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: S from `before` earlier to `after` later than R; state is bounded by the interval."""
    a, b = r.withWatermark("r_ts", late).alias("r"), s.withWatermark("s_ts", late).alias("s")
    on = F.expr(f"r.key = s.key AND s_ts >= r_ts - INTERVAL {before} AND s_ts <= r_ts + INTERVAL {after}")
    return a.join(b, on).select("r.key", "r_id", "s_id", "r_ts", "s_ts")


def with_table(r: DataFrame, s: DataFrame) -> DataFrame:
    """Batch-stream: R is a table, S a stream; no state."""
    return s.join(r, "key").select("key", "r_id", "s_id", "r_ts", "s_ts")


class AcknowledgedHash(StatefulProcessor):
    """The rows of a bucket of keys, of both sides, each kept until it is acknowledged (or for `ttl_ms` of processing time), so that what comes later no longer meets it.

    A micro-batch's rows of a bucket are put in order of key and time and held together, and all of its keys are worked on at once. What is kept from before is stored and read in
    chunks of `SLICE` rows, and pairs are given out in slices, so a key may have any number of rows in state."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = {side: handle.getMapState(f"kept_{side}", "chunk long", "rows binary", self.ttl_ms) for side in SIDES}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        batch = pa.concat_tables(pa.ipc.open_stream(b).read_all() for some in rows for b in some["bundle"]).to_pandas()
        batch["of"], keys = pd.factorize(batch["key"], use_na_sentinel=False)
        batch = batch.iloc[np.lexsort((batch["kind"], batch["ts"], batch["of"]))].reset_index(drop=True)
        batch["born"] = now
        start, stop = (np.searchsorted(batch["of"].to_numpy(), np.arange(len(keys)), at) for at in ("left", "right"))
        acks = batch[batch["kind"] == 2]
        for side, other in (SIDES, SIDES[::-1]):
            own = acks[acks["side"].isna() | (acks["side"] == side)]
            later = batch.index[batch["kind"] == SIDES.index(other)].to_numpy()
            moved: list[pd.DataFrame] = []  # of chunks that have become small, and in the end what is new: written as chunks again
            chunks = [k[0] for k in self.kept[side].keys()]
            next_ = max(chunks, default=-1) + 1
            for chunk in chunks:
                part = unpacked(self.kept[side].getValue((chunk,))[0])
                end = np.full(len(part), NEVER)
                if self.ttl_ms:  # a chunk lives as long as the last of its rows
                    end[part["born"].to_numpy() + self.ttl_ms <= now] = -1
                of = pd.Index(keys).get_indexer(part["key"])
                at = np.flatnonzero((of >= 0) & (end > 0))
                some, of = part.iloc[at], of[at]
                end[at] = ends(some["id"], of, start[of] - 1, own, stop, len(batch))
                yield from meet(side, some, start[of] - 1, np.minimum(end[at], stop[of]), later, batch)
                left = part[end == NEVER]
                if len(left) < SLICE // 2:
                    self.kept[side].removeKey((chunk,))
                    moved.append(left)
                elif len(left) < len(part):
                    self.kept[side].updateValue((chunk,), (packed(left),))
                if sum(map(len, moved)) >= SLICE:
                    next_, moved = self._keep(side, next_, moved), []
            new = batch[batch["kind"] == SIDES.index(side)]
            of, begin = new["of"].to_numpy(), new.index.to_numpy()
            end = ends(new["id"], of, begin, own, stop, len(batch))
            yield from meet(side, new, begin, np.minimum(end, stop[of]), later, batch)
            self._keep(side, next_, [*moved, new[end == NEVER]])

    def _keep(self, side: str, chunk: int, parts: list[pd.DataFrame]) -> int:
        """Writes the rows as new chunks from that number on; returns the next one."""
        rows = pd.concat([p[KEPT] for p in parts if len(p)], ignore_index=True) if any(map(len, parts)) else ()
        for at in range(0, len(rows), SLICE):
            self.kept[side].updateValue((chunk,), (packed(rows.iloc[at : at + SLICE]),))
            chunk += 1
        return chunk

    def close(self) -> None:
        pass


def bundled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows as bundles of one bucket, each an Arrow stream of `most` rows at most, fewer if rows are large: the stateful operator takes its input to Python row by row, so it is given few."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        held += [] if batch is None else [batch]
        if not sum(b.num_rows for b in held) or batch is not None and sum(b.num_rows for b in held) < HELD:
            continue
        rows = pa.Table.from_batches(held)
        held = []
        rows = rows.take(pc.sort_indices(rows["bucket"])).combine_chunks()
        size = max(1, min(most, BUNDLE_BYTES * len(rows) // rows.nbytes))
        of, rows = rows["bucket"].to_numpy(), rows.drop_columns(["bucket"])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        cuts = [(a, min(a + size, end)) for begin, end in zip(first, [*first[1:], len(of)], strict=True) for a in range(begin, end, size)]
        yield pa.RecordBatch.from_arrays([pa.array(of[[a for a, _ in cuts]]), pa.array([streamed(rows.slice(a, b - a)) for a, b in cuts], pa.binary())], ["bucket", "bundle"])


#: What is stored of a row; `born` is the processing time of its arrival.
KEPT = ["key", "id", "ts", "born"]


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow stream."""
    return streamed(pa.Table.from_pandas(rows[KEPT], preserve_index=False))


def streamed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def ends(ids: pd.Series, of: np.ndarray, begin: np.ndarray, acks: pd.DataFrame, stop: np.ndarray, size: int) -> np.ndarray:
    """The place of the first acknowledgement after `begin` of each id of a key, or of all of the key (null); NEVER without one. of: the key's number, whose rows end at `stop`, as
    in acks; size: places in all."""
    places = acks.index[acks["id"].isna()].to_numpy()
    out = np.append(places, NEVER)[np.searchsorted(places, begin, "right")]
    out = np.where(out < stop[of], out, NEVER)
    named = acks[acks["id"].notna()]
    if len(named):
        code, known = pd.factorize(named["id"])
        mine = pd.Index(known).get_indexer(ids)
        both = named["of"].to_numpy() * len(known) + code
        pairs = np.unique(both)  # of key and id
        marks = np.sort(np.searchsorted(pairs, both) * (size + 1) + named.index.to_numpy())
        wanted = of * len(known) + mine
        rank = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        next_ = np.append(marks, NEVER)[np.searchsorted(marks, rank * (size + 1) + begin, "right")]
        hit = (mine >= 0) & (pairs[rank] == wanted) & (next_ // (size + 1) == rank)
        out = np.where(hit, np.minimum(out, next_ % (size + 1)), out)
    return out


def meet(side: str, mine: pd.DataFrame, begin: np.ndarray, end: np.ndarray, later: np.ndarray, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Each of mine with the rows of the other side between its begin and its end, some at a time. later: their places in the batch."""
    lo, hi = np.searchsorted(later, begin, "right"), np.searchsorted(later, end)
    times = np.maximum(hi - lo, 0)
    cuts = np.searchsorted(np.cumsum(times), np.arange(PAIRS, int(times.sum()) + 1, PAIRS))
    for a, b in zip([0, *cuts], [*cuts, len(mine)], strict=True):
        n = times[a:b]
        if not n.sum():
            continue
        x = np.repeat(np.arange(a, b), n)
        y = later[np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        of = {side: (mine, x), SIDES[1 - SIDES.index(side)]: (batch, y)}
        yield pd.DataFrame({"key": mine["key"].to_numpy()[x], **{f"{k}_{c}": of[k][0][c].to_numpy()[of[k][1]] for c in ("id", "ts") for k in SIDES}})[["key", "r_id", "s_id", "r_ts", "s_ts"]]


def acknowledged(r: DataFrame, s: DataFrame, acks: DataFrame | None = None, salts: int = SALTS, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Stream-stream join in which a third stream says which rows are done with: acks (key, side, id, ts) takes the rows with that id out of the side's state, all of the key if id is
    null and of both sides if side is null. Pairs come out when their later member arrives, unless the earlier one was acknowledged before. Within a micro-batch rows
    count in order of time (null times first; at equal times R, then S, then acknowledgements).

    A key's S rows are dealt to `salts` groups; its R rows and acknowledgements are copied to each. Groups are dealt to `buckets`, each the work of one call per micro-batch, which
    holds the micro-batch's rows of its keys; they come in bundles. Times go as microseconds, whatever the session's time zone. Without acks and ttl_ms Spark's own join (`symmetric_hash`)
    gives the same pairs and is faster. Ids go as text. Needs the RocksDB state store (see ROCKSDB)."""
    buckets = max(buckets, salts)
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    one = F.pmod(F.xxhash64("s_id", "s_ts"), F.lit(salts)).cast("int")
    micros = lambda ts: F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(UNTIMED))
    row = lambda df, kind, salt, side, i, ts: df.select("key", salt.alias("salt"), F.lit(kind).cast("byte").alias("kind"), side.cast("string").alias("side"), F.col(i).cast("string").alias("id"), micros(ts).alias("ts"))
    both = row(r, 0, copies, F.lit(None), "r_id", "r_ts").unionByName(row(s, 1, one, F.lit(None), "s_id", "s_ts"))
    if acks is not None:  # they come after what arrives at the same time
        both = both.unionByName(row(acks, 2, copies, F.col("side"), "id", "ts"))
    mode = "processingTime" if ttl_ms else "none"
    kind = r.schema["key"].dataType.simpleString()
    both = both.where("key IS NOT NULL").withColumn("bucket", F.pmod(F.pmod(F.xxhash64("key"), F.lit(buckets)) + F.col("salt"), F.lit(buckets))).drop("salt")  # a key's groups are in buckets of their own
    bundles = both.mapInArrow(partial(bundled, most=BUNDLE), "bucket long, bundle binary")
    out = bundles.groupBy("bucket").transformWithStateInPandas(AcknowledgedHash(ttl_ms), f"key {kind}, r_id string, s_id string, r_ts long, s_ts long", "append", mode)
    out = out.withColumns({t: F.timestamp_micros(F.nullif(F.col(t), F.lit(UNTIMED))) for t in ("r_ts", "s_ts")})
    return out.withColumns({i: F.col(i).cast(df.schema[i].dataType) for i, df in (("r_id", r), ("s_id", s))})
