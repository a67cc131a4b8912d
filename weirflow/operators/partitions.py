"""How keys spread over partitions: histograms, heavy hitters, splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.expressions import radix
from weirflow.operators.order import position, running_sum
from weirflow.sources.staging import staged


def radix_histogram(df: DataFrame, key: Column, bits: int = 4) -> DataFrame:
    """(p1, p2, n): rows by the lowest bits and by the bits above, the two passes of a radix partitioning."""
    return df.groupBy(radix(key, bits).alias("p1"), radix(key, bits, bits).alias("p2")).agg(F.count("*").alias("n"))


def offsets(histogram: DataFrame, *by: str) -> DataFrame:
    """Adds start: where each partition of a histogram begins."""
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def merged_histogram(*parts: DataFrame) -> DataFrame:
    """(k, n) of several histograms (k, n)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("k").agg(F.sum("n").alias("n"))


def above_average(df: DataFrame, key: str, factor: float) -> DataFrame:
    """(k, n) of the keys with more than factor times the mean count of a key."""
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    mean = counts.agg((F.sum("n") / F.count("*")).alias("mean"))
    return counts.join(F.broadcast(mean), F.col("n") > factor * F.col("mean")).select("k", "n")


def heavy_hitters(df: DataFrame, key: str, runs: int, samples: int, *order: str, share: float = 0.5, most: int = 16) -> DataFrame:
    """(k, hits): keys that fill more than `share` of the samples of some run, `most` at most, those with most samples in a run first (ties: the smaller).

    The rows are cut into equal runs in their order. Of each run sorted by key, the rows at `samples` equally spaced places are
    its samples: how many of them a key has follows from its count in the run and the counts of smaller keys, so no run is
    sorted anywhere. Only keys that are frequent enough to be heavy, 1 / share of a run at most or so, are looked at twice.
    """
    if samples * share < 2:
        raise ValueError(f"too few samples to tell heavy keys: {samples}")
    placed = position(df.select(F.col(key).alias("k"), *(F.col(c) for c in order)), *order, name="_i", total="_n")
    run = F.floor(F.col("_i") * runs / F.col("_n"))
    counts = staged(placed.where("k IS NOT NULL").groupBy(run.alias("run"), "k").agg(F.count("*").alias("c")))
    sizes = counts.groupBy("run").agg(F.sum("c").alias("rows"))
    often = counts.join(F.broadcast(sizes), "run").where(F.col("c") > (share - 1.0 / samples) * F.col("rows"))  # one row per run; a few per run
    often = often.select("run", "rows", F.col("k").alias("hk"), F.col("c").alias("hc"))
    less = counts.join(F.broadcast(often), "run").groupBy("run", "rows", "hk", "hc").agg(F.coalesce(F.sum(F.when(F.col("k") < F.col("hk"), F.col("c"))), F.lit(0)).alias("a"))
    at = lambda x: F.ceil(x * samples / F.col("rows"))  # noqa: E731  samples that lie before place x
    found = less.withColumn("hits", at(F.col("a") + F.col("hc")) - at(F.col("a"))).where(F.col("hits") > share * samples)
    return found.groupBy(F.col("hk").alias("k")).agg(F.max("hits").alias("hits")).orderBy(F.desc("hits"), "k").limit(most)


def equi_depth(df: DataFrame, key: str, parts: int) -> DataFrame:
    """(part, lo, hi, n): `parts` ranges of about equally many rows. Works on one row per key, ranked by their counts' running sum."""
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    placed = running_sum(counts, "n", "k", name="before", total="whole")
    part = F.floor(F.col("before") * parts / F.col("whole"))
    return placed.groupBy(part.cast("int").alias("part")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("n").alias("n"))


def moments(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("stddev"), F.skewness(c).alias("skewness"))


#: Size of a quantile sketch, and the part of all rows by which a rank taken from it is off at most (more than four standard deviations).
SKETCH, SKETCH_ERROR = 1000, 0.005


def sketched_bounds(df: DataFrame, key: str, parts: int, run: Column | None = None, size: int = SKETCH) -> DataFrame:
    """(part, bound) for parts 1 to `parts` - 1: about part / parts of the rows have keys up to the bound, which is a key of df.

    One pass and no sort: each run (a partition unless given) makes a quantile sketch of a fixed size, and the sketches are merged. For the default size a
    bound's rank is off by SKETCH_ERROR of all rows at most. Null keys count for nothing; no keys, no bounds."""
    own = df.where(F.col(key).isNotNull()).groupBy((F.spark_partition_id() if run is None else run).alias("run")).agg(F.kll_sketch_agg_bigint(F.col(key).cast("long"), F.lit(size)).alias("sketch"))
    merged = own.agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.count("*").alias("runs")).where("runs > 0")
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    return merged.select(F.posexplode(F.kll_sketch_get_quantile_bigint("sketch", shares)).alias("part", "bound")).select((F.col("part") + 1).alias("part"), "bound")


def rank_errors(df: DataFrame, key: str, bounds: DataFrame, parts: int) -> DataFrame:
    """(part, bound, error): by which part of all rows the bound's rank is off; a bound stands for all ranks of the rows that equal it."""
    own = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.count("*").alias("n"))
    under = own.join(F.broadcast(bounds), F.col("k") <= F.col("bound")).groupBy("part", "bound").agg(F.sum("n").alias("upto"), F.sum(F.when(F.col("k") < F.col("bound"), F.col("n")).otherwise(0)).alias("before"))  # parts - 1 rows
    whole = own.agg(F.sum("n").alias("whole"))  # a single row
    target = F.col("part") * F.col("whole") / F.lit(parts)
    off = F.greatest(F.col("before") - target, target - F.col("upto"), F.lit(0.0)) / F.col("whole")
    return under.join(F.broadcast(whole), F.lit(True)).select("part", "bound", off.alias("error"))


def cell_histogram(df: DataFrame, key: str, parts: int, cells: int = 1024, fine: int = 256) -> DataFrame:
    """(lo, width, n): rows in cells of equally many keys, of which those with more than a fourth of a part's rows are cut into `fine` once more.
    Fewer than cells + 4 x parts x fine rows, whatever the size of df. Keys are whole numbers; nulls are left out."""
    own = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"))
    edge = own.agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("whole"))
    edge = edge.select("least", "whole", F.ceil((F.col("most") - F.col("least") + 1) / F.lit(cells)).alias("width"))
    first = lambda x: F.col("least") + F.floor((x - F.col("least")) / F.col("width")) * F.col("width")
    placed = own.join(F.broadcast(edge), F.lit(True)).withColumn("lo", first(F.col("k")))  # edge is a single row
    coarse = staged(placed.groupBy("lo", "width", "whole").agg(F.count("*").alias("n")))
    many = coarse.where((4 * parts * F.col("n") > F.col("whole")) & (F.col("width") > 1)).select("lo", F.ceil(F.col("width") / fine).alias("step"))
    again = placed.select("k", "lo").join(F.broadcast(many), "lo")  # fewer than 4 x parts rows
    small = again.groupBy((F.col("lo") + F.floor((F.col("k") - F.col("lo")) / F.col("step")) * F.col("step")).alias("lo"), F.col("step").alias("width")).agg(F.count("*").alias("n"))
    return coarse.join(F.broadcast(many), "lo", "left_anti").select("lo", "width", "n").unionByName(small)


def splitters(df: DataFrame, key: str, parts: int) -> DataFrame:
    """(part, bound) for parts 1 to `parts` - 1, by interpolation in the cell that holds the rank: keys of part i are those from bound i on, below bound i + 1.
    A part has at most its share of the rows, and those of the two cells in which it begins and ends: 1.5 shares unless some of these keys has more alone."""
    cells = cell_histogram(df, key, parts)
    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a bounded number of rows
    cells = cells.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "whole": F.sum("n").over(Window.partitionBy())})
    low, high = F.floor(F.col("before") * parts / F.col("whole")) + 1, F.least(F.floor((F.col("before") + F.col("n")) * parts / F.col("whole")), F.lit(parts - 1))
    at = cells.where(low <= high).withColumn("part", F.explode(F.sequence(low, high)))
    inside = F.ceil((F.col("part") * F.col("whole") - F.col("before") * parts) * F.col("width") / (F.col("n") * parts))
    return at.select(F.col("part").cast("int").alias("part"), (F.col("lo") + inside).alias("bound"))


def part_of(df: DataFrame, key: str, bounds: list[int], name: str = "part") -> DataFrame:
    """Adds `name`: how many of the sorted bounds aren't above the key, found by bisection in an array that goes along with the plan."""
    ends = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    out, step = df.withColumn(name, F.lit(0)), 1 << max(len(bounds).bit_length() - 1, 0)
    while step and bounds:
        here = F.col(name) + step
        out = out.withColumn(name, F.when((here <= len(bounds)) & (F.get(ends, here - 1) <= F.col(key)), here).otherwise(F.col(name)))
        step //= 2
    return out


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df in `parts` partitions by our own splitters: partition i has the keys of part i. Null keys go to the first."""
    bounds = sorted(r.bound for r in splitters(df, key, parts).collect())  # parts - 1 numbers
    return part_of(df, key, bounds, "_part").repartitionById(parts, "_part").drop("_part")
