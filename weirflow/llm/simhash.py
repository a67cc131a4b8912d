"""SimHash near-duplicates by multi-index hashing.

1. A fingerprint per text: bit b is 1 if it is set in over half the XXH64 values of the text's word
   shingles, repeats included. Hashing runs in Arrow batches; the few bytes per document that come out
   are written to the shared folder.
2. Equal fingerprints are one node. A 64-bit fingerprint is cut into segments; two that differ in 4
   bits or fewer differ in at most one bit of some one of three segments, and in at most two bits of
   some one of two. So each fingerprint enters the table of each segment under its own value ("home")
   and looks up the values of the Hamming ball around it (the larger ones; the smaller find it from
   their side). Two segments of 32 bits cost sixteen times the lookups, but their buckets are a
   two-thousandth as full: `layout` takes three segments up to `FEW` fingerprints and two beyond.
   Both find all links.
3. What meets in a bucket is compared over all 64 bits. A bucket is dealt out in tiles: its homes and
   its lookups are cut into runs of about `TILE`, one tile per pair of runs, so a large bucket is many
   tasks' work. A tile emits a spanning forest of its links instead of all pairs: components keep
   every link's effect, and a tile of n rows emits fewer than n rows.
4. Components of the forest, then one join back to the documents.

Defined results: a text without words, or null, has fingerprint 0, which links like any other. A text of any length takes its own
bytes and the words of a megabyte.
Repeated rows get equal results, one each. A null id is never the smallest of a component unless it
has no other. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import fresh, written
from weirflow.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (lowest bit, width) of each segment, and the radius of the balls that are looked up.
THREE, TWO = (((0, 21), (21, 21), (42, 22)), 1), (((0, 32), (32, 32)), 2)
#: Fingerprints for which three segments cost least, at most: a bucket then has eight of them or so.
FEW = 1 << 24
#: Rows of a bucket that a tile holds of each side, about.
TILE = 1024
#: A megabyte of text, and the rest of a word that is cut.
CUT = re.compile(rb"(?s).{1,1000000}[^\x20\x09-\x0d]*")


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Signed, as Spark's long has it. A long text is taken a megabyte at a time, with the last words of the one before."""
    import xxhash

    data = text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes: only A-Z, only ASCII blanks
    hash_of, held, total, many = xxhash.xxh64_intdigest, [], np.zeros(64, np.int64), 0
    for piece in CUT.finditer(data):
        held += piece.group().split()
        grams = zip(*(held[k:] for k in range(size)), strict=False)
        h = np.fromiter((hash_of(b" ".join(g), seed) for g in grams), np.uint64, max(len(held) - size + 1, 0))
        many += len(h)
        for part in np.array_split(h, -(-len(h) // 65536)) if len(h) else []:
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if len(h):
            held = held[len(h) :]  # the last size - 1 words
    if many:
        return int(np.packbits(2 * total > many, bitorder="little").view(np.int64)[0])
    value = hash_of(b" ".join(held), seed) if held else 0
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size, seed) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def forest(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint reached) that connect what the pairs of left x right within `most` bits connect."""
    nodes = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= most
    label = np.arange(len(nodes))
    none = len(nodes)
    while True:
        new = label.copy()
        np.minimum.at(new, a, np.where(near, label[b][None, :], none).min(1, initial=none))
        np.minimum.at(new, b, np.where(near, label[a][:, None], none).min(0, initial=none))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def layout(fingerprints: int, distance: int) -> tuple[tuple[tuple[int, int], ...], int]:
    """The segments and the radius for so many fingerprints."""
    segments, radius = THREE if fingerprints <= FEW and distance // len(THREE[0]) <= THREE[1] else TWO
    if distance // len(segments) > radius:
        raise ValueError("balls of radius 1 or 2 find distances up to 5")
    return segments, radius


def _ball(own: str, width: int, radius: int) -> str:
    """SQL of the values above `own` that differ from it in 1 to radius bits."""
    flips = f"transform(sequence(0, {width - 1}), b -> shiftleft(1L, b))"
    if radius == 2:
        flips = f"flatten(transform(sequence(0, {width - 1}), b -> transform(sequence(b, {width - 1}), c -> shiftleft(1L, b) | shiftleft(1L, c))))"
    return f"filter(transform({flips}, x -> {own} ^ x), v -> v > {own})"


def near_links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE, fingerprints: int | None = None) -> DataFrame:
    """fps: one column fp, distinct; fingerprints: how many (counted if not given). Returns links (a, b) with the components of all pairs within `distance` bits."""
    segments, radius = layout(fps.count() if fingerprints is None else fingerprints, distance)
    spots = []
    for s, (low, width) in enumerate(segments):
        own = f"(shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L)"
        spots.append(F.expr(f"array(struct({s} AS seg, {own} AS value, true AS home))"))
        spots.append(F.expr(f"transform({_ball(own, width, radius)}, v -> struct({s} AS seg, v AS value, false AS home))"))
    spots = fps.select("fp", F.inline(F.concat(*spots)))
    # how many tiles each side of a large bucket is cut into; all others are one tile
    load = spots.groupBy("seg", "value").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("calls"))
    load = load.where(f"homes > {tile} OR calls > {tile}").select("seg", "value", F.ceil(F.col("homes") / tile).cast("int").alias("rows"), F.ceil(F.col("calls") / tile).cast("int").alias("cols"))
    spots = spots.join(load, ["seg", "value"], "left").fillna(1, ["rows", "cols"])
    place = F.pmod(F.xxhash64("fp", F.lit(7)), F.when(F.col("home"), F.col("rows")).otherwise(F.greatest("cols", F.lit(1)))).cast("int")
    spots = spots.withColumn("at", place)
    # a home meets all lookups and all later runs of homes, a lookup all homes; a bucket of one tile has both meetings in it
    all_of = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tiles = F.when((F.col("rows") == 1) & (F.col("cols") == 1), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("among")))).otherwise(
        F.when(
            F.col("home"),
            F.concat(
                F.transform(all_of(F.col("cols")), lambda c: F.struct(F.col("at").alias("x"), c.alias("y"), F.lit(False).alias("among"))),
                F.transform(all_of(F.col("rows")), lambda r: F.struct(F.least(r, F.col("at")).alias("x"), F.greatest(r, F.col("at")).alias("y"), F.lit(True).alias("among"))),
            ),
        ).otherwise(F.transform(all_of(F.col("rows")), lambda r: F.struct(r.alias("x"), F.col("at").alias("y"), F.lit(False).alias("among"))))
    )
    dealt = spots.select("fp", "seg", "value", "home", F.inline(tiles))
    key = ["seg", "value", "x", "y", "among"]
    dealt = dealt.select(F.xxhash64(*key).alias("tile"), *key, "home", "fp")
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", *key)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles come whole and in order; a tile may go on in the next batch."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = (pdf[key].ne(pdf[key].shift())).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            rest = pdf.iloc[starts[-1] :]
            yield links_of(pdf, starts)
        if rest is not None:
            yield links_of(rest.reset_index(drop=True), np.array([0, len(rest)]))

    def links_of(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        among = pdf["among"].to_numpy(bool)
        size = np.diff(starts)
        out_a, out_b = [], []
        # small tiles together: each row with the rows that follow it at distance 1, 2, ...; lookups meet no lookups
        small = size <= 8
        tile_of = np.repeat(np.arange(len(size)), size)
        n = len(tile_of)
        fp_s, home_s, among_s = fp[starts[0] : starts[0] + n], home[starts[0] : starts[0] + n], among[starts[0] : starts[0] + n]
        keep = small[tile_of]
        t, f, h, g = tile_of[keep], fp_s[keep], home_s[keep], among_s[keep]
        for step in range(1, int(size[small].max(initial=0))):
            near = (t[step:] == t[:-step]) & (h[step:] | h[:-step]) & (g[step:] | (h[step:] != h[:-step])) & (np.bitwise_count(f[step:] ^ f[:-step]) <= distance)
            out_a.append(f[step:][near])
            out_b.append(f[:-step][near])
        for i in np.flatnonzero(~small):
            lo, hi = starts[i], starts[i + 1]
            f, h = fp[lo:hi], home[lo:hi]
            a, b = forest(f[h], f, distance) if among[lo] else forest(f[h], f[~h], distance)
            out_a.append(a)
            out_b.append(b)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pd.DataFrame({"a": join(out_a), "b": join(out_b)})

    return dealt.mapInPandas(meet, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links."""
    fps = written(fingerprints(docs, id_col, text_col, size, seed))
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(nodes.select("fp"), distance), "a", "b")
    grouped = nodes.join(roots, nodes["fp"] == roots["node"])
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = grouped.join(least, "root").select("fp", "component_id")
    whole = nodes.join(grouped, "fp", "left").select(F.col("fp").alias("node"), F.coalesce("component_id", "least").alias("component_id"))
    whole = written(whole)  # a table of its own, so that Spark can split a fingerprint with very many documents
    out = fps.join(whole, fps["fp"] == whole["node"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Callable[[DataFrame, str, str], DataFrame] | None = None, **how) -> DataFrame:
    """docs with one document of each group: the one of least id (null after all others). All columns stay.

    also: another way to find groups, (docs, id_col, text_col) -> id and component_id; what either of them links is one group.

    Documents meet their verdict by id and text, so rows that share an id are told apart; of rows equal
    in both, one stays.
    """
    key, own_id, own_key = fresh(docs, "text_key"), fresh(docs, "own_id"), fresh(docs, "own_key")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    ranked = keyed.select(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("who"), F.col(text_col).alias("body"))
    groups = written(simhash_groups(ranked, "who", "body", **how).select("who", "component_id"))
    stay = groups.where("who = component_id").select("who")
    if also:
        links = groups.unionByName(also(ranked, "who", "body").select("who", "component_id")).where("who <> component_id")
        gone = written(components(links, "who", "component_id").where("node <> root").select(F.col("node").alias("who")))
        stay = groups.select("who").join(gone, "who", "left_anti")
    stay = written(stay.select(F.col("who.id").alias(own_id), F.col("who.key").alias(own_key)))
    once = stay.distinct()
    kept = keyed.join(once, keyed[id_col].eqNullSafe(once[own_id]) & (keyed[key] == once[own_key]), "left_semi")
    if stay.count() > once.count():  # rows that are equal in id and text
        kept = kept.dropDuplicates([key, id_col])
    return kept.drop(key)
