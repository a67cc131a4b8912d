"""Equi-joins of two relations, one function per way to bring equal keys together.

Every function takes R and S with the columns (key, rid, ts) and returns the pairs (key, r_id, s_id,
r_ts, s_ts), each as often as its rows are there; ids may repeat or be null. Which one runs fastest
depends on the sizes: R that fits every worker is broadcast, others are shuffled by key, and keys with
very many rows are cut into slices. How many partitions there are is left to Spark unless the spec asks
for a number of workers. Columns of CARRIED go along, whatever deals the rows out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.expressions import radix, tumbling, worker
from weirflow.operators.estimates import running_estimate
from weirflow.operators.order import position
from weirflow.sources.staging import staged
from weirflow.spec import JoinSpec

#: Rows of R that are sent to every worker at most, and the bytes of their values.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 1 << 26


def r_side(df: DataFrame, key: str, rid: str, ts: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(rid).alias("r_id"), (F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")).alias("r_ts"))


def s_side(df: DataFrame, key: str, rid: str, ts: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(rid).alias("s_id"), (F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")).alias("s_ts"))


#: What a strategy's rows may bring along to its pairs: a side's run, its place of arrival, the estimate of that time.
CARRIED = ("r_run", "s_run", "r_place", "s_place", "r_estimate", "s_estimate", "member")


def pairs(joined: DataFrame) -> DataFrame:
    return joined.select("key", "r_id", "s_id", "r_ts", "s_ts", *(c for c in CARRIED if c in joined.columns))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has `rows` rows and `most` bytes of values at most; reads no more rows than that. Text and binary values count as long as they are, others as 16 bytes or
    as their text."""
    kinds = {c: df.schema[c].dataType for c in df.columns}
    length = lambda c, t: F.octet_length(c) if t.typeName() in ("string", "binary") else F.lit(16) if not hasattr(t, "fields") and not hasattr(t, "elementType") and not hasattr(t, "keyType") else F.octet_length(F.to_json(F.struct(c)))
    sizes = [F.coalesce(length(c, t), F.lit(0)).cast("long") for c, t in kinds.items()]
    found = df.select(sum(sizes, F.lit(0).cast("long")).alias("size")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return found.n <= rows and (found["size"] or 0) <= most


def broadcast_hash(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """One hash table of R at every worker; S stays where it is. R of more than BROADCAST_ROWS rows or BROADCAST_BYTES bytes is shuffled instead."""
    return pairs(s.join(F.broadcast(r), "key")) if is_small(r) else shuffled_hash(r, s, spec)


def shuffled_hash(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Both sides hash-partitioned by key, a hash table of each of R's partitions."""
    return pairs(s.join(r.hint("shuffle_hash"), "key"))


def radix_partitioned(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """As shuffled_hash, and the partition's radix is part of the key, so that a count per radix needs no more shuffles."""
    with_radix = lambda df: df.withColumn("part", radix(F.col("key"), spec.radix_bits))
    return pairs(with_radix(s).join(with_radix(r).hint("shuffle_hash"), ["part", "key"]))


def sort_merge(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Both sides sorted by key within hash partitions and merged; Spark splits partitions that are too large."""
    return pairs(s.join(r.hint("merge"), "key"))


def multipass_merge(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Sort-merge whose result is sorted by key within partitions, as the merge leaves it; Spark merges spilled runs in as many passes as it takes."""
    return sort_merge(r, s, spec).sortWithinPartitions("key")


def heavy_keys(s: DataFrame, share: float = 0.01) -> DataFrame:
    """(key, n, slices) of keys with more than that share of S: fewer than 1 / share. A slice has that share of S at most."""
    counts = s.groupBy("key").agg(F.count("*").alias("n"))
    whole = s.agg(F.count("*").alias("whole"))  # a single row
    hot = counts.join(F.broadcast(whole), F.col("n") > share * F.col("whole"))
    return hot.select("key", "n", F.ceil(F.col("n") / (share * F.col("whole"))).alias("slices"))


def skew_merge(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec(), share: float = 0.01) -> DataFrame:
    """Sort-merge in which only the heavy keys of S are cut into slices; R's rows of those keys are copied to each."""
    hot = F.broadcast(staged(heavy_keys(s, share).select("key", "slices")))
    many = F.coalesce(F.col("slices"), F.lit(1).cast("long"))
    left = s.join(hot, "key", "left").withColumn("slice", F.pmod(F.xxhash64("s_id", "s_ts"), many)).drop("slices")
    right = r.join(hot, "key", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("slices")
    return pairs(left.join(right.hint("merge"), ["key", "slice"]))


def join_matrix(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Every worker sees all of R and a slice of S: S as it lies, or cut anew if the spec asks for a number of workers."""
    return broadcast_hash(r, s.repartition(spec.workers) if spec.workers else s, spec)


def join_biclique(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Both sides dealt to workers by key; the join uses that partitioning as it is."""
    deal = lambda df: df.repartition(spec.workers, "key") if spec.workers else df
    return pairs(deal(s).join(deal(r).hint("shuffle_hash"), "key"))


def in_groups(r: DataFrame, s: DataFrame, size: int, member: Column | None = None) -> DataFrame:
    """Workers in groups of `size`: R is copied to all members of its key's group, an S row goes to one of them, by the hash of its id
    and time unless `member` (0 to size - 1, never null) names it. The pairs and the member that finds them."""
    left = s.withColumn("member", F.pmod(F.xxhash64("s_id", "s_ts"), F.lit(size)) if member is None else member)
    right = r.withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return pairs(left.join(right, ["key", "member"]))


def content_random(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Join in groups of spec.group_size workers, see `in_groups`."""
    return in_groups(r, s, spec.group_size).drop("member")


def handshake(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """R and S flow past each other: every slice of R meets every slice of S. Slices meet in cells, by (cell, key), so
    each side is copied once per slice of the other (spec.workers of them, 4 unless given) and no pair of unequal keys is ever looked at."""
    n = spec.workers or 4
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = s.withColumn("sc", F.pmod(F.xxhash64("s_id", "s_ts"), F.lit(n))).withColumn("rc", each)
    right = r.withColumn("rc", F.pmod(F.xxhash64("r_id", "r_ts"), F.lit(n))).withColumn("sc", each)
    return pairs(left.join(right, ["key", "rc", "sc"]))


def copied(f: Callable) -> Callable:
    """Physical partitioning: both inputs are copied before they are joined."""

    def g(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
        return f(staged(r), staged(s), spec)

    g.__doc__ = f"{f.__doc__} Both inputs are copied first."
    return g


def runs(df: DataFrame, side: str, step: int) -> DataFrame:
    """Adds r_run or s_run: which of the 100 / step equal parts of the side, in order of arrival, the row came in."""
    n = -(-100 // step)
    df = position(df, f"{side}_ts", f"{side}_id", "key", name="_i", total="_n")
    return df.withColumn(f"{side}_run", F.least(F.floor(F.col("_i") * n / F.col("_n")), F.lit(n - 1)).cast("int")).drop("_i", "_n")


def progressive(deal: Callable) -> Callable:
    """Progressive merge join over a way to deal out the rows: runs are marked first and go along with the rows."""

    def g(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
        """Pairs of the same run come out while runs are sorted, all others as runs are merged. The pairs and their phase, from one join."""
        both = deal(runs(r, "r", spec.sort_step), runs(s, "s", spec.sort_step), spec)
        phase = F.when(F.col("r_run") == F.col("s_run"), F.lit("sort")).otherwise(F.lit("merge"))
        return both.select("key", "r_id", "s_id", "r_ts", "s_ts", phase.alias("phase"))

    return g


def ripple(deal: Callable) -> Callable:
    """Ripple join over a way to deal out the rows: every arrival has the running estimate of all matches with it."""

    def g(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
        """The pairs, each with the estimate of the number of all pairs at the time when its later member had arrived."""
        seen = running_estimate(r, s)
        side = lambda name: seen.where(F.col("side") == name).select("key", F.col("id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"), F.col("i").alias(f"{name}_place"), F.col("estimate").alias(f"{name}_estimate"))
        both = deal(side("r"), side("s"), spec)
        estimate = F.when(F.col("r_place") > F.col("s_place"), F.col("r_estimate")).otherwise(F.col("s_estimate"))
        return both.select("key", "r_id", "s_id", "r_ts", "s_ts", estimate.alias("estimate"))

    return g


#: Strategy by name. `_NP`: rows are used where they are; `_P`: copied first; `_st`: the same join, over as many workers as there are.
STRATEGIES: dict[str, Callable[[DataFrame, DataFrame, JoinSpec], DataFrame]] = {
    "NPO": broadcast_hash,
    "NPO_st": broadcast_hash,
    "PRO": radix_partitioned,
    "PRH": shuffled_hash,
    "PRHO": shuffled_hash,
    "RJ_st": radix_partitioned,
    "m-way": sort_merge,
    "m-pass": multipass_merge,
    "m-way+skew": skew_merge,
    "SHJ_st": shuffled_hash,
    "SHJ_JM_NP": join_matrix,
    "SHJ_JM_P": copied(join_matrix),
    "SHJ_JB_NP": join_biclique,
    "SHJ_JBCR_NP": content_random,
    "SHJ_JBCR_P": copied(content_random),
    "SHJ_HS_NP": handshake,
    "PMJ_st": progressive(sort_merge),
    "PMJ_JM_NP": progressive(join_matrix),
    "PMJ_JM_P": copied(progressive(join_matrix)),
    "PMJ_JB_NP": progressive(join_biclique),
    "PMJ_JB_P": copied(progressive(join_biclique)),
    "PMJ_JBCR_NP": progressive(content_random),
    "PMJ_JBCR_P": copied(progressive(content_random)),
    "PMJ_HS_NP": progressive(handshake),
    "RPJ_st": ripple(sort_merge),
    "RPJ_JM_NP": ripple(join_matrix),
    "RPJ_JB_NP": ripple(join_biclique),
    "RPJ_JBCR_NP": ripple(content_random),
    "RPJ_HS_NP": ripple(handshake),
}


def window_join(r: DataFrame, s: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Pairs of equal key by spec.strategy, within tumbling windows of spec.window_ms of both timestamps if that is set.
    The window is packed with the key, so every strategy deals rows out by both. Null keys match nothing."""
    f = STRATEGIES[spec.strategy]
    if spec.window_ms is None:
        return f(r, s, spec)
    packed = lambda df, ts: df.withColumn("key", F.struct(F.col("key").alias("k"), tumbling(F.col(ts), spec.window_ms).alias("w"))).where("key.k IS NOT NULL AND key.w IS NOT NULL")
    if spec.strategy in ("PRO", "RJ_st"):
        f = shuffled_hash
    out = f(packed(r, "r_ts"), packed(s, "s_ts"), spec)
    return out.select(F.col("key.k").alias("key"), F.col("key.w").alias("window_ms"), *[c for c in out.columns if c != "key"])


def match_count(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("n"))


def worker_counts(df: DataFrame, key: Column, n: int) -> DataFrame:
    """Rows that each worker gets."""
    return df.groupBy(worker(key, n).alias("worker")).agg(F.count("*").alias("n"))
