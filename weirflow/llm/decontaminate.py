"""Benchmark decontamination: a hash set of normalised test n-grams against training token windows.

Every window of `n` consecutive words of a benchmark item (an item of fewer words is one window) goes
into a table of distinct windows. A document's words become one row per position that holds the next
`n` words; the hash of a position's words is looked up in the table and a hit is verified by comparing
the words themselves. The table is broadcast while it has at most `broadcast_windows` windows, a bound
that is counted first. Beyond it a bitmap of the windows' hashes (2^27 bits, 16 MB whatever their number)
is broadcast instead: positions whose bit isn't set have no window, and only the others are shuffled by
their hash and meet the table, which Spark's skew join can split at a frequent passage.

Words and windows are made by built-in functions inside one stage. Only hits, and one row per
document, leave it: they are gathered by document, where overlapping hits count once.

Defined results: null or blank texts have no words and no hits; items without words are no windows.
Rows are judged one by one, so repeated rows and null ids come out as often as they went in. Empty
tables of documents give no rows; without benchmark items no document is contaminated. Other columns
of either table are not read (`clean_documents` hands them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import ALNUM_WORD, ascii_lower, fresh, written

WINDOW = 10
BROADCAST_WINDOWS = 200_000
#: Bits of the bitmap, as a power of two.
BITMAP_BITS = 27


def words(text: Column) -> Column:
    """Null for null; cut first, as lower-casing A-Z changes no boundary."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0))


def windows(benchmark: DataFrame, id_col: str, text_col: str, n: int = WINDOW) -> DataFrame:
    """item, length, window: each item's windows once, words joined by a blank."""
    w = F.col("w")
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size(w) > 0)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n))),
    )
    return items.select("item", F.least(F.size(w), F.lit(n)).alias("length"), F.explode(F.array_distinct(grams)).alias("window"))


def _window_hash(window: Column, length: Column, n: int) -> Column:
    w = F.split(window, " ")
    return F.coalesce(*(F.when(length == k, F.xxhash64(*(F.get(w, F.lit(i)) for i in range(k)))) for k in range(1, n + 1)))


def marked(positions: DataFrame, table: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """positions with `maybe`: false where no window of the table has the row's hash."""
    cell = lambda: F.pmod(F.col("hash"), F.lit(1 << bits))
    bitmap = table.groupBy(F.bitmap_bucket_number(cell()).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell())).alias("bits"))
    place = F.bitmap_bit_position(cell())
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, CAST(place % 8 AS INT)) & 1")
    found = positions.withColumn("part", F.bitmap_bucket_number(cell())).join(F.broadcast(bitmap), "part", "left")  # 2^bits bits at most
    found = found.withColumns({"place": place, "byte": byte})
    return found.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("part", "bits", "place", "byte")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: the id, n_words, hits (sorted distinct [first word, past the last word)) and items (sorted)."""
    found = written(windows(benchmark, item_id, item_text, n))
    table = found.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    table = written(table.withColumn("hash", _window_hash(F.col("window"), F.col("length"), n)))
    stated = table.groupBy("length").agg(F.count("*").alias("n")).collect()  # n rows at most
    lengths = sorted(r["length"] for r in stated)
    small = sum(r["n"] for r in stated) <= broadcast_windows

    d = docs.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("w"))
    # the k-th array starts k words later; zipped, each position holds its next n words, null past the end
    ahead = [F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias(f"w{k}") for k in range(n)]
    d = d.select("doc", "row", F.size("w").alias("size"), F.posexplode_outer(F.arrays_zip(*ahead)).alias("at", "x"))
    d = d.select("doc", "row", "size", "at", *(F.col(f"x.w{k}").alias(f"w{k}") for k in range(n)))
    keys = {k: F.xxhash64(*(F.col(f"w{i}") for i in range(k))) for k in lengths}
    if len(lengths) == 1:
        d = d.withColumns({"length": F.lit(lengths[0]), "hash": keys[lengths[0]]})
    elif lengths:
        pairs = F.array(*(F.struct(F.lit(k).alias("length"), h.alias("hash")) for k, h in keys.items()))
        d = d.select("*", F.inline(pairs))
    else:
        d = d.withColumns({"length": F.lit(0), "hash": F.lit(None).cast("long")})
    if lengths and not small:
        # a document's first position stays in any case, for its number of words; without a window it is dealt out by itself
        d = marked(d, table).where("maybe OR coalesce(at, 0) = 0")
        d = d.withColumns({"hash": F.when(F.col("maybe"), F.col("hash")).otherwise(F.xxhash64("row")), "length": F.when(F.col("maybe"), F.col("length")).otherwise(-1)})
    d, t = d.alias("d"), (F.broadcast(table) if small else table).alias("t")
    same = F.lit(False)
    for k in lengths:
        text = F.concat_ws(" ", *(F.col(f"d.w{i}") for i in range(k)))
        same = same | ((F.col("t.length") == k) & (F.col("t.window") == text))
    joined = d.join(t, (F.col("d.hash") == F.col("t.hash")) & (F.col("d.length") == F.col("t.length")) & same, "left")
    hit = F.col("t.window").isNotNull()
    rows = joined.where(hit | F.coalesce(F.col("at") == 0, F.lit(True))).select(
        "d.doc", "d.row", "d.size", F.when(hit, F.struct("d.at", (F.col("d.at") + F.col("d.length")).alias("end"))).alias("hit"), "t.items"
    )
    per = rows.groupBy("row", "doc").agg(
        F.max("size").alias("size"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    return per.select(F.col("doc").alias(id_col), F.greatest("size", F.lit(0)).cast("long").alias("n_words"), "hits", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, n_hit, items, spans (maximal runs of hit words, as start and past the end), contaminated."""
    df = find_hits(docs, benchmark, id_col, text_col, **how)
    at = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["end"] - 1)))
    df = df.withColumn("_at", F.array_sort(F.array_distinct(at)))
    p = F.col("_at")
    first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
    last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) > x + 1, F.lit(True)))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    df = df.withColumns({"n_hit": F.size("_at").cast("long"), "spans": spans}).withColumn("contaminated", F.col("n_hit") > 0)
    return df.select(id_col, "n_words", "n_hit", "items", "spans", "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "document", **how) -> DataFrame:
    """docs without its contaminated documents, or (mode "span") with the hit words taken out of their texts; all columns stay.

    Rows meet their findings by id and text, so rows that share an id are told apart.
    """
    key, bad_id, bad_key, bad_spans = fresh(docs, "text_key"), fresh(docs, "bad_id"), fresh(docs, "bad_key"), fresh(docs, "bad_spans")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    text_id = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(key).alias("key")).alias("doc_key"), F.col(text_col).alias("body"))
    found = contamination(text_id, benchmark, "doc_key", "body", **how).where("contaminated")
    bad = found.select(F.col("doc_key.id").alias(bad_id), F.col("doc_key.key").alias(bad_key), F.col("spans").alias(bad_spans)).dropDuplicates([bad_id, bad_key])
    same = keyed[id_col].eqNullSafe(bad[bad_id]) & (keyed[key] == bad[bad_key])
    if mode == "document":
        return keyed.join(bad, same, "left_anti").drop(key)
    if mode != "span":
        raise ValueError(f"mode is document or span, not {mode}")
    joined = keyed.join(bad, same, "left")
    raw = F.regexp_extract_all(F.col(text_col), F.lit(ALNUM_WORD), F.lit(0))
    gaps = F.split(F.col(text_col), ALNUM_WORD, -1)
    kept = F.transform(raw, lambda w, i: F.concat(F.when(F.exists(bad_spans, lambda s: (i >= s["start"]) & (i < s["end"])), F.lit("")).otherwise(w), F.get(gaps, i + 1)))
    text = F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    return joined.withColumn(text_col, F.when(F.col(bad_spans).isNotNull(), text).otherwise(F.col(text_col))).select(docs.columns)
