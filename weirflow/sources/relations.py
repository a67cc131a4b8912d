"""Relations of (key, rid, ts): delimited files, generators, timestamps, and text sinks.

ts is in milliseconds since the stream began; null means a batch side. Nothing is ever ordered by its
place in a file: whatever depends on an order says by which columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.order import following, position, running_sum
from weirflow.sources.staging import staged


def draw(i: Column, seed: int) -> Column:
    """A number of [0, 1) from the md5 of i and the seed: the same whatever the partitioning, and in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", i.cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**13))


def split_fields(line: Column, delimiter: str) -> Column:
    return F.split(line, "\\" + delimiter)


def read_delimited(spark: SparkSession, path: str, key_col: int, ts_col: int = 0) -> DataFrame:
    """Headerless text; the delimiter is the first "," or "|" of each line. ts_col 0: no timestamps.
    rid is unique and not dense. Lines whose key is no number fail, as a cast in ANSI mode does."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    mark = F.regexp_extract("value", "([,|])", 1)
    fields = F.when(mark == "|", split_fields(F.col("value"), "|")).otherwise(split_fields(F.col("value"), ","))
    ts = F.trim(F.get(fields, F.lit(ts_col))).cast("long") if ts_col else F.lit(None).cast("long")
    return lines.select(F.trim(F.get(fields, F.lit(key_col))).cast("long").alias("key"), F.monotonically_increasing_id().alias("rid"), ts.alias("ts"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order of the columns; a top-n, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def smooth(df: DataFrame, ts: str = "ts", order: str = "rid") -> DataFrame:
    """Spreads rows of equal ts evenly up to the next one: the j-th of c rows at t, before t', gets t + floor(j (t' - t) / c). The last run stays, and so do
    rows without a time. A row's place in its run is its place in the whole order less the run's first, so a run of any length is dealt out as well."""
    placed = position(df.where(F.col(ts).isNotNull()), ts, order, name="_i")
    runs = following(placed.groupBy(ts).agg(F.count("*").alias("_c"), F.min("_i").alias("_first_i")), ts, "_next")
    out = placed.join(runs, ts).withColumn("_j", F.col("_i") - F.col("_first_i"))
    moved = F.floor(F.col(ts) + F.col("_j") * ((F.col("_next") - F.col(ts)) / F.col("_c").cast("double"))).cast(df.schema[ts].dataType)
    out = out.withColumn(ts, F.coalesce(moved, F.col(ts))).select(df.columns)
    return out.unionByName(df.where(F.col(ts).isNull()))


def round_robin(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """Adds part: the row's position in the order, modulo parts."""
    return position(df, *order, name="_i").withColumn("part", F.pmod("_i", F.lit(parts)).cast("int")).drop("_i")


def alphabet(spark: SparkSession, size: int, kind: str = "incremental", seed: int = 12345) -> DataFrame:
    """(i, symbol): 1..size in rising, falling or shuffled order."""
    df = spark.range(1, size + 1).select(F.col("id").alias("i"))
    if kind == "incremental":
        return df.withColumn("symbol", F.col("i"))
    if kind == "decremental":
        return df.withColumn("symbol", size + 1 - F.col("i"))
    if kind != "permuted":
        raise ValueError(f"incremental, decremental or permuted, not {kind}")
    shuffled = position(df.withColumn("_h", draw(F.col("i"), seed)), "_h", "i", name="_p")
    return shuffled.select("i", (F.col("_p") + 1).alias("symbol"))


def unique_keys(spark: SparkSession, n: int, seed: int = 12345) -> DataFrame:
    """Keys 1..n, each once, placed by an affine walk over 1..n: rid i gets key (a i + b) mod n + 1, a coprime to n."""
    return spark.range(n).select(walked(F.col("id"), n, seed).alias("key"), F.col("id").alias("rid"))


def walked(i: Column, n: int, seed: int) -> Column:
    a = n * 618 // 1000 | 1
    while gcd(a, n) != 1:
        a += 2
    return F.pmod(i * a + seed, F.lit(max(n, 1))) + 1


def unique_keys_of(df: DataFrame, *order: str, seed: int = 12345) -> DataFrame:
    """df's rows, each with a key of 1..n of its own, n being the number of rows."""
    placed = position(df, *order, name="_place")
    return placed.withColumn("key", walked(F.col("_place"), placed.count(), seed)).drop("_place")


primary_keys = unique_keys


def duplicate(df: DataFrame, copies: int, key: str = "key", rid: str = "rid") -> DataFrame:
    """Each row `copies` times; rids stay unique."""
    return df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(rid, F.col(rid) * copies + F.col("_c")).drop("_c")


def nonunique_keys(spark: SparkSession, n: int, max_id: int, seed: int = 12345) -> DataFrame:
    """n uniform keys of 0..max_id - 1."""
    return spark.range(n).select(F.floor(draw(F.col("id"), seed) * max_id).alias("key"), F.col("id").alias("rid"))


def nonunique_keys_of(df: DataFrame, max_id: int, *order: str, seed: int = 12345) -> DataFrame:
    """df's rows, each with a uniform key of 0..max_id - 1 drawn by its place in the order."""
    placed = position(df, *order, name="_place")
    return placed.withColumn("key", F.floor(draw(F.col("_place"), seed) * max_id)).drop("_place")


def foreign_keys(spark: SparkSession, n: int, max_id: int) -> DataFrame:
    """Keys 1..max_id over and over."""
    return spark.range(n).select((F.col("id") % max_id + 1).alias("key"), F.col("id").alias("rid"))


def foreign_keys_of(pk: DataFrame, n: int, order: str = "rid") -> DataFrame:
    """The keys of pk over and over, n rows in all."""
    size = pk.count()
    if not size:
        return pk.select("key", "rid").limit(0)
    of = position(pk, order, name="_i").select("_i", "key")
    times = F.floor((F.lit(n) - 1 - F.col("_i")) / size)
    out = of.where(F.col("_i") < n).withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), times)))
    return out.select("key", (F.col("_t") * size + F.col("_i")).alias("rid"))


def zipf_cdf(spark: SparkSession, size: int, z: float) -> DataFrame:
    """(i, cdf): the share of symbols 1..i if symbol j has weight j^-z."""
    w = spark.range(1, size + 1).select(F.col("id").alias("i"), F.pow(F.col("id").cast("double"), F.lit(-z)).alias("p"))
    upto = running_sum(w, "p", "i", name="before", total="whole")
    return upto.select("i", F.when(F.col("i") == size, F.lit(1.0)).otherwise((F.col("before") + F.col("p")) / F.col("whole")).alias("cdf"))


def zipf_steps(spark: SparkSession, size: int, z: float, seed: int = 12345, kind: str = "permuted") -> DataFrame:
    """(symbol, lo, hi, bin): which draws of [0, 1) are which symbol; a step is in all bins that it touches. There are as many bins as symbols, so a bin
    holds two steps on average and the table twice as many rows as symbols at most."""
    cdf = staged(zipf_cdf(spark, size, z))
    below = cdf.select((F.col("i") + 1).alias("i"), F.col("cdf").alias("lo"))
    steps = cdf.join(below, "i", "left").fillna(0.0, ["lo"]).join(alphabet(spark, size, kind, seed), "i")
    return staged(steps.select("symbol", "lo", F.col("cdf").alias("hi"), F.explode(F.sequence(bin_of(F.col("lo"), size), bin_of(F.col("cdf"), size))).alias("bin")))


def bin_of(u: Column, bins: int) -> Column:
    return F.least(F.floor(u * bins), F.lit(bins - 1))


def drawn(df: DataFrame, index: str, steps: DataFrame, size: int, name: str, seed: int = 12345) -> DataFrame:
    """Adds `name`: the symbol that the row draws by its index. The draw meets its bin's steps; both are dealt out by bin, and Spark splits the bins that the draws of one
    task fill."""
    u = df.withColumn("_u", draw(F.col(index), seed)).withColumn("_bin", bin_of(F.col("_u"), size))
    own = steps.select(F.col("symbol").alias(name), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("bin").alias("_bin"))
    return u.join(own, "_bin").where("_u >= _lo AND _u < _hi").select(*df.columns, name)


def zipf_keys(spark: SparkSession, n: int, size: int, z: float, seed: int = 12345, kind: str = "permuted") -> DataFrame:
    """n keys, drawn by inverting the CDF."""
    return drawn(spark.range(n).select(F.col("id").alias("rid")), "rid", zipf_steps(spark, size, z, seed, kind), size, "key", seed).select("key", "rid")


def zipf_keys_of(df: DataFrame, size: int, z: float, *order: str, seed: int = 12345, kind: str = "permuted", name: str = "key") -> DataFrame:
    """df's rows, each with a skewed key drawn by its place in the order."""
    placed = position(df, *order, name="_place")
    return drawn(placed, "_place", zipf_steps(df.sparkSession, size, z, seed, kind), size, name, seed).drop("_place")


def uniform_ts(df: DataFrame, step: int, interval: int, rid: str = "rid") -> DataFrame:
    """ts grows by interval ms every step rows, and is interval at first; interval 0: all 0. rid is dense from 0 (`uniform_ts_of` takes any)."""
    return df.withColumn("ts", (interval * (F.floor(F.col(rid) / step) + 1)).cast("long"))


def uniform_ts_of(df: DataFrame, step: int, interval: int, *order: str) -> DataFrame:
    """`uniform_ts` by the row's place in the order."""
    return uniform_ts(position(df, *order, name="_place"), step, interval, "_place").drop("_place")


def zipf_ts(df: DataFrame, window: int, z: float, seed: int = 54321, rid: str = "rid") -> DataFrame:
    """Arrival in 1..window ms, denser at the start the larger z is, drawn by the row's place among the rids, which may be sparse, repeated or null."""
    return zipf_keys_of(df, window, z, rid, seed=seed, kind="incremental", name="ts")


def early_share(df: DataFrame, window: int, ts: str = "ts") -> DataFrame:
    """The share of rows that arrive in the first quarter of the window."""
    return df.agg(F.avg((F.col(ts) < 0.25 * window).cast("int")).alias("share"))


@dataclass(frozen=True)
class RelationSpec:
    """keys: unique, nonunique, zipf or foreign. times: none, uniform or zipf. duplicates: copies of each key."""

    rows: int
    keys: str = "unique"
    max_id: int = 0
    key_skew: float = 0.0
    duplicates: int = 1
    times: str = "none"
    window: int = 1000
    step: int = 40
    interval: int = 1
    ts_skew: float = 0.0
    seed: int = 12345


def make_relation(spark: SparkSession, spec: RelationSpec) -> DataFrame:
    """(key, rid, ts) of spec.rows rows; rids are dense from 0. If the copies don't divide the rows, the last key has fewer."""
    base = -(-spec.rows // spec.duplicates)
    top = spec.max_id or max(base, 1)
    makers = {
        "unique": lambda: unique_keys(spark, base, spec.seed),
        "nonunique": lambda: nonunique_keys(spark, base, top, spec.seed),
        "zipf": lambda: zipf_keys(spark, base, top, spec.key_skew, spec.seed),
        "foreign": lambda: foreign_keys(spark, base, top),
    }
    df = makers[spec.keys]()
    if spec.duplicates > 1:
        df = duplicate(df, spec.duplicates).where(F.col("rid") < spec.rows)
    if spec.times == "uniform":
        return uniform_ts(df, spec.step, spec.interval)
    if spec.times == "zipf":
        return zipf_ts(df, spec.window, spec.ts_skew)
    return df.withColumn("ts", F.lit(0).cast("long"))


def write_relation(df: DataFrame, path: str) -> None:
    """`key rid` lines, separated by a blank, under a header in every file."""
    df.select(F.col("key").alias("#KEY"), F.col("rid").alias("VAL")).write.option("header", True).option("sep", " ").option("comment", "~").csv(path)


def write_delimited(df: DataFrame, path: str, *columns: str, delimiter: str = ",") -> None:
    """Headerless lines of the columns as text, as `read_delimited` reads them."""
    df.select(F.concat_ws(delimiter, *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """(key, rid) of what `write_relation` wrote."""
    return spark.read.option("header", True).option("sep", " ").option("comment", "~").csv(path).select(F.col("#KEY").cast("long").alias("key"), F.col("VAL").cast("long").alias("rid"))


def write_pairs(pairs: DataFrame, path: str, by_key: bool = False) -> None:
    """`key rid` lines of matches; by_key: sorted within each file."""
    out = pairs.select("key", "s_id")
    (out.sortWithinPartitions("key", "s_id") if by_key else out).write.option("sep", " ").csv(path)


def write_times(df: DataFrame, path: str, ts: str = "ts") -> None:
    df.select(F.col(ts).cast("string")).write.text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.json(path)
