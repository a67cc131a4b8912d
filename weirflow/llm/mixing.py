"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sources, their sizes and targets: weights share the whole size out; a source whose share would
   exceed `max_epochs` times its size stops there and the excess goes to the others by weight.
2. Every document gets a place on its source's line of words, in an order shuffled by the md5 of its
   id. The line's offsets come from two levels (sums of ranges of the order, which follow the data, then
   places in a range), so a source with a third of all documents is still many ranges, however many
   documents there are; only rows equal in source, id and size share one.
3. Slots k = 0, 1, ... of `block` words: the golden-ratio point of k, mapped through the cumulative
   target shares, names slot k's source. Ranks per source come from two levels as well (sums of runs
   of slots, then places in a run).
4. The r-th slot of a source takes words [r * block, (r + 1) * block) of its line, which starts again
   at its end; a source ends after `max_epochs` rounds. Slots and documents are both cut at cells of
   `block` words and joined by (source, cell), so no key has more rows than a cell has.

Only per-source sums (one row per source) are ever put in one task.

Defined results: a null text has size 0 and is never taken. Null is a source of its own, after all
others. Repeated rows are separate stretches of the line; rows with equal id and size are
interchangeable. Sources without words have target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import PLAIN_WORD, written
from weirflow.operators.order import running_sum

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 128
#: The points' range is cut into so many bins, by which slots find the sources that share a bin.
BINS = 4096
#: Slots in a run that is ranked in one task.
RUN = 1 << 14
#: The golden ratio's fraction of 2^31, odd: k * GOLDEN mod 2^31 runs through all points evenly.
GOLDEN, POINTS = 1327217885, 1 << 31


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """id, source, size and, if row_col names what tells rows apart, row."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(PLAIN_WORD)), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n.cast("long").alias("size"), *([F.col(row_col).alias("row")] if row_col else []))


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, weight, target, lo and hi (its part of [0, 1))."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    # Let all get lambda * weight. Sources reach their caps in the order of cap / weight; those before
    # the first that doesn't reach its cap stop, and the rest share what is left.
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(every),
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum(max_epochs * F.col("source_size")).over(before), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    cap = max_epochs * F.col("source_size")
    s = s.withColumn("stops", cap * F.col("open") <= F.col("left") * F.col("weight"))
    rate = F.max(F.when(~F.col("stops"), F.struct("left", "open"))).over(every)  # of the first that goes on: least is taken off before it
    s = s.withColumn("rate", rate)
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(F.col("rate.left").cast("double") * F.col("weight") / F.col("rate.open"))
    s = s.withColumn("target", target)
    upto = by_name.rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("target").over(upto) / F.nullif(F.sum("target").over(every), F.lit(0.0))
    s = s.withColumn("hi", F.coalesce(share, F.lit(0.0)))
    return s.select("source", "source_size", "weight", "total", "target", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)).alias("lo"), "hi")


def placed(sized: DataFrame) -> DataFrame:
    """Adds `start`, where the document begins on its source's shuffled line."""
    d = sized.withColumn("order", F.md5(F.col("id").cast("string")))
    last = ["row"] if "row" in sized.columns else []
    # one line of all sources, one after the other
    d = written(running_sum(d, "size", "source", "order", "id", "size", *last, name="place").drop("order"))
    first = d.groupBy("source").agg(F.min("place").alias("first")).alias("f")
    out = d.alias("d").join(F.broadcast(first), F.col("d.source").eqNullSafe(F.col("f.source")))  # one row per source
    return out.select(*(f"d.{c}" for c in sized.columns), (F.col("d.place") - F.col("f.first")).alias("start"))


def schedule(target: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """One row per slot: slot, source, rank among its source's slots, source_size."""
    spark = target.sparkSession
    point = ((F.col("id") % POINTS) * GOLDEN) % POINTS / F.lit(float(POINTS))
    k = spark.range(-(-total // block)).select(F.col("id").alias("slot"), point.alias("x")).withColumn("bin", F.floor(F.col("x") * BINS)).alias("k")
    bins = F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1))))
    t = target.where("hi > lo").withColumn("bin", bins).alias("t")
    slots = k.join(t, (F.col("k.bin") == F.col("t.bin")) & (F.col("x") >= F.col("t.lo")) & (F.col("x") < F.col("t.hi"))).select("k.slot", "t.source", "t.source_size", F.floor(F.col("slot") / RUN).alias("run"))
    sums = slots.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).alias("b")
    slots = slots.withColumn("inner", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1).alias("s")
    on = F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.run") == F.col("b.run"))
    return slots.join(sums, on).select("s.slot", "s.source", "s.source_size", (F.col("b.base") + F.col("s.inner")).alias("rank"))


def _cells(lo: Column, hi: Column, block: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / block), F.floor((hi - 1) / block)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, row_col: str | None = None):
    """Returns (placed, targets, pieces).

    placed: id, source, size, start, and row if row_col is given. pieces: slot, epoch, source, start (of the document on its line),
    from_word and n_words: the words of that document which the slot takes.
    """
    sized = written(sizes(docs, id_col, text_col, source_col, row_col))
    target = written(targets(sized, weights, max_epochs), 1)
    total = sized.agg(F.sum("size")).first()[0] or 0
    line = written(placed(sized))
    slots = schedule(target, total, block).withColumnRenamed("source_size", "whole")
    first, last = F.col("rank") * block, (F.col("rank") + 1) * block
    epochs = F.sequence(F.floor(first / F.col("whole")), F.least(F.floor((last - 1) / F.col("whole")), F.lit(max_epochs - 1)))
    slots = slots.where(F.col("rank") * block < max_epochs * F.col("whole")).withColumn("epoch", F.explode(epochs))
    at = F.col("epoch") * F.col("whole")
    slots = slots.select("slot", "source", "epoch", F.greatest(first - at, F.lit(0)).alias("lo"), F.least(last - at, F.col("whole")).alias("hi"))
    slots = slots.select("*", _cells(F.col("lo"), F.col("hi"), block).alias("cell")).alias("s")
    parts = line.where("size > 0").select("source", "start", "size", _cells(F.col("start"), F.col("start") + F.col("size"), block).alias("cell")).alias("d")
    # each common stretch is counted in the cell where it begins
    lo = F.greatest(F.col("s.lo"), F.col("d.start"), F.col("s.cell") * block)
    hi = F.least(F.col("s.hi"), F.col("d.start") + F.col("d.size"), (F.col("s.cell") + 1) * block)
    on = F.col("s.source").eqNullSafe(F.col("d.source")) & (F.col("s.cell") == F.col("d.cell")) & (lo < hi)
    pieces = slots.join(parts, on).select("s.slot", "s.epoch", "d.source", "d.start", (lo - F.col("d.start")).alias("from_word"), (hi - lo).alias("n_words"))
    return line, target, pieces


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, **how) -> DataFrame:
    """One row per document: id, source, size, source_size, target of the source, and taken: the words the mix takes.
    row_col: a column of keys that tell rows apart, which comes along as `row` and decides between rows of equal id and size."""
    line, target, pieces = mix(docs, id_col, text_col, source_col, row_col=row_col, **how)
    took = pieces.groupBy("source", "start").agg(F.sum("n_words").alias("taken")).alias("p")
    d, t = line.alias("d"), target.alias("t")
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.start") == F.col("p.start")) & (F.col("d.size") > 0)
    out = d.join(took, same, "left").join(t, F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    return out.select(*(["d.row"] if row_col else []), F.col("d.id").alias(id_col), F.col("d.source").alias(source_col), "d.size", "t.source_size", "t.target", F.coalesce("p.taken", F.lit(0)).cast("long").alias("taken"))
