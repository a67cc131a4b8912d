"""Removing repeated byte strings by refining buckets of anchored strings.

A byte goes if a string of `least` bytes (200) that covers it starts anywhere else as well. Bucket-pointer
refinement sorts all suffixes into buckets by their first q bytes and refines a bucket by the identifiers
of the buckets at later offsets. That takes a pointer of 8 bytes for every suffix, so each round moves
more than eight times the text; it was built and measured (README), and only the buckets' part of it is
kept here. Refined are buckets of a few anchored strings instead of suffixes, by identifiers of content:

* Anchors. Of the q-grams in each string of `least` bytes the least by hash (leftmost among equals) is
  its anchor; equal strings have theirs at the same offset, so every string is looked at once, from its
  anchor, and about one position in 80 is an anchor. An anchor stands for a range of strings: those
  that start `lo` to `hi` bytes before it.
* Round 0. The initial buckets are the anchors' q-grams; a bucket of one is done. Anchors of one text
  with equal bucket and identifier are put together before anything is shuffled, so a text that repeats
  itself adds one row to a bucket, however often it does. Within a bucket, the identifier of an anchor's
  whole range (the fingerprint of all bytes its strings cover) refines it: anchors of equal identifiers
  are all repeated, and one of them stands for all from there on. A bucket goes on only if it still
  holds different identifiers, one of them alone.
* Round 1 does the same with the parts of the ranges that lie in the same `STEP` offsets: the bucket is
  given by the bytes that all strings of the part share, the identifier by all bytes they cover.
* Round 2 takes the single strings of the parts that are left.

Identifiers are 128 bits of the BLAKE2b digest of the bytes and their place, instead of ranks, so no round
needs a global sort. Only equal identifiers make bytes equal: buckets are 64-bit fingerprints that unequal
bytes may share (modulo 2^64, Thue-Morse patterns do), which sends them on to the next round and no
more. Buckets are only ever counted (map-side first) and joined to their counts, which Spark's skew join
can split; no task ever holds a whole bucket, and a group of copies counts once after the first round
that sees it whole. Nothing is sampled or capped.

Defined results: null is the empty text; texts shorter than `least` stay whole. Repeated rows are
copies of each other. Rows with equal id and text share one result, one row each; null ids are
ordinary. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import discard, written

LEAST, GRAM, STEP = 200, 40, 16
#: Bytes that are fingerprinted at once; a position among them takes so many bits.
CHUNK, BITS = 1 << 19, 20
#: Characters of texts whose anchors are held in a task at once, about; a longer text is alone.
SLICE = 1 << 22
BASE = 0x9E3779B97F4A7C1B | 1
#: What tells apart what is in a bucket; equal buckets alone mean nothing.
CLASS = ("bucket", "ident", "ident2")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and the powers of BASE and of its inverse modulo 2^64."""
    of_byte = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
    power = [np.ones(CHUNK + 1, np.uint64), np.ones(CHUNK + 1, np.uint64)]
    for x, b in zip(power, (BASE, pow(BASE, -1, 1 << 64)), strict=True):
        x[1:] = np.uint64(b)
        np.multiply.accumulate(x, out=x)
    return of_byte, *power


class Prints:
    """Fingerprints of any stretch of the bytes given."""

    def __init__(self, data: np.ndarray):
        of_byte, power, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(of_byte[data] * power[: len(data)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


def _chunks(texts: list[bytes], least: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts in stretches of CHUNK bytes at most: their bytes, and of each piece its text, its place in that, and its end here.
    Pieces of a text overlap so that each string is in one of them."""
    room: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - least + 1), CHUNK - least + 1):
            piece = text[at : at + CHUNK]
            if size + len(piece) > CHUNK and room:
                yield _laid(room)
                room, size = [], 0
            room.append((i, at, piece))
            size += len(piece)
    if room:
        yield _laid(room)


def _laid(room: list[tuple[int, int, bytes]]):
    of, at, pieces = zip(*room, strict=True)
    return b"".join(pieces), np.array(of), np.array(at), np.cumsum([len(p) for p in pieces])


def _identifiers(raw: bytes, lo: np.ndarray, hi: np.ndarray, tag: np.ndarray) -> dict[str, np.ndarray]:
    """ident and ident2, 128 bits of the BLAKE2b digest of each stretch lo..hi of the bytes and its tag."""
    tags = tag.astype("<u4").tobytes()
    each = (hashlib.blake2b(raw[a:b] + tags[4 * i : 4 * i + 4], digest_size=16).digest() for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)))
    both = np.frombuffer(b"".join(each), "<i8").reshape(-1, 2)
    return {"ident": both[:, 0], "ident2": both[:, 1]}


def anchors(texts: list[bytes], least: int, gram: int) -> pd.DataFrame:
    """text, pos, lo, hi, bucket, ident, ident2 of all anchors."""
    out = []
    span = least - gram + 1  # q-grams in a string
    for raw, of, at, end in _chunks(texts, least):
        n = len(raw)
        prints = Prints(np.frombuffer(raw, np.uint8))
        i = np.arange(n - gram + 1)
        bucket = prints.of(i, i + gram)
        order = (bucket >> np.uint64(BITS) << np.uint64(BITS)) | i.astype(np.uint64)
        padded = np.full(-(-len(order) // span) * span, ~np.uint64(0))
        padded[: len(order)] = order
        block = padded.reshape(-1, span)
        before = np.minimum.accumulate(block, axis=1).ravel()
        after = np.ascontiguousarray(np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1]).ravel()
        count = n - least + 1
        low = np.minimum(after[:count], before[span - 1 : span - 1 + count])
        piece = np.repeat(np.arange(len(end)), np.diff(end, prepend=0))[:count]
        s = np.flatnonzero(np.arange(count) + least <= end[piece])
        p = (low[s] & np.uint64((1 << BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(s) != 1)]))
        last = np.append(first[1:], len(s)) - 1
        a, b, p = s[first], s[last], p[first]
        lo, hi = p - b, p - a
        ident = _identifiers(raw, a, b + least, lo * least + hi)
        own = piece[a]
        pos = p - (end[own] - np.diff(end, prepend=0)[own]) + at[own]
        out.append(pd.DataFrame({"text": of[own], "pos": pos, "lo": lo, "hi": hi, "bucket": bucket[p].view(np.int64), **ident}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: np.empty(0, np.int64) for k in ("text", "pos", "lo", "hi", *CLASS)})


def collapsed(found: pd.DataFrame) -> pd.DataFrame:
    """Anchors with the first of those that equal each other in text, bucket and identifier; more: where the others are, null if none."""
    text, bucket, ident, ident2 = (found[c].to_numpy(np.int64) for c in ("text", *CLASS))
    order = np.argsort(_mix(bucket.view(np.uint64) ^ _mix(ident.view(np.uint64) + text.view(np.uint64))), kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (text, bucket, ident, ident2)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    pos = found["pos"].to_numpy(np.int32)[order]
    out = found.iloc[order[first]].reset_index(drop=True)
    more = np.full(len(first), None, object)
    for i in np.flatnonzero(count > 1):
        more[i] = pos[first[i] + 1 : first[i] + count[i]]
    out["more"] = more
    return out


def parts(context: list[bytes], lo: np.ndarray, hi: np.ndarray, step: int, least: int, gram: int) -> pd.DataFrame:
    """The ranges lo..hi cut at multiples of step. context: the bytes that a range's strings cover, so its anchor is at hi.
    of (the range), lo, hi, bucket, ident, ident2."""
    size = np.array([len(c) for c in context])
    out = []
    first = 0
    while first < len(context):
        stop = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), CHUNK, "right")))
        raw = b"".join(context[first:stop])
        prints = Prints(np.frombuffer(raw, np.uint8))
        zero = np.cumsum(size[first:stop]) - size[first:stop] + hi[first:stop]
        count = hi[first:stop] // step - lo[first:stop] // step + 1
        of = np.repeat(np.arange(first, stop), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + lo[of] // step
        p = zero[of - first]
        most = np.minimum(k * step + step - 1, least - gram)
        a, b = np.maximum(lo[of], k * step), np.minimum(hi[of], most)
        bucket = _mix(prints.of(p - k * step, p - most + least) ^ _mix((k * 1024 + step).astype(np.uint64)))
        ident = _identifiers(raw, p - b, p - a + least, a * least + b)
        out.append(pd.DataFrame({"of": of, "lo": a, "hi": b, "bucket": bucket.view(np.int64), **ident}))
        first = stop
    return pd.concat(out, ignore_index=True)


def _each(df: DataFrame, f, schema: str) -> DataFrame:
    """f gives frames for each frame of rows."""
    return df.mapInPandas(lambda batches: (out for pdf in batches if len(pdf) for out in f(pdf)), schema)


def _bytes(x) -> Iterator[bytes]:
    return (t.encode("utf-8", "surrogatepass") for t in x)


def _slices(pdf: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The rows in runs of `most` characters of t at most, or of one row."""
    ends = np.cumsum(pdf["t"].str.len().to_numpy(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")))
        yield pdf.iloc[lo:hi]
        lo = hi


def _refined(rows: DataFrame, key: list[str], times: Column | None = None) -> DataFrame:
    """rows: a class, done and what `key` names; times: how many anchors a row stands for (1). Returns the classes of the buckets that hold more than one anchor:
    bucket, ident, ident2, n, done, one member's key, and goes_on: whether its bucket has other classes and one that is alone."""
    member = F.min(F.struct(*key)).alias("member")
    count = F.count("*") if times is None else F.sum(times)
    classes = rows.groupBy(*CLASS).agg(count.alias("n"), F.max("done").alias("seen"), member)
    # tables of their own, so that Spark can split a bucket with very many classes
    classes = written(classes.withColumn("done", F.col("seen") | (F.col("n") > 1)).drop("seen"))
    whole = classes.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum((~F.col("done")).cast("int")).alias("alone"))
    whole = written(whole.where("classes > 1 OR alone = 0").select("bucket", ((F.col("classes") > 1) & (F.col("alone") > 0)).alias("goes_on")))
    out = written(classes.join(whole, "bucket"))
    discard(classes)
    discard(whole)
    return out


def _repeated(rows: DataFrame, classes: DataFrame, pos: Column | None = None) -> DataFrame:
    """The places of rows whose class has other members: id, th, a, b (where the first and the last repeated string start).
    pos: a row's place or places, if not its column pos."""
    many = classes.where("n > 1").select(*CLASS)
    rows = rows.where("NOT done").join(many, list(CLASS))
    rows = rows if pos is None else rows.select("id", "th", "lo", "hi", pos.alias("pos"))
    return rows.select("id", "th", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo")).alias("b"))


def _round(rows: DataFrame, classes: DataFrame, pos: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The repeated places of a round, and the representatives of classes that go on; both are tables, and those that the round read go."""
    found = written(_repeated(rows, classes, pos))
    left = written(classes.where("goes_on").select("member.*", "done"))
    discard(rows)
    discard(classes)
    return found, left


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """id, th (the text's xxhash64), a, b: strings of `least` bytes that start at bytes a..b of that text are in the corpus more than once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    key = ["id", "th", "pos", "lo", "hi"]

    def find(pdf: pd.DataFrame):
        for some in _slices(pdf, SLICE):
            got = collapsed(anchors(list(_bytes(some["t"])), least, gram))
            own = some.iloc[got.pop("text").to_numpy(np.int64)]
            yield pd.DataFrame({"id": own["id"].to_numpy(), "th": own["th"].to_numpy(), **got})

    seen = written(_each(d.where(F.octet_length("t") >= least), find, f"id {kind}, th long, pos int, lo int, hi int, bucket long, ident long, ident2 long, more array<int>"))
    times = 1 + F.coalesce(F.array_size("more"), F.lit(0))
    # a table of its own, so that Spark can split a bucket with very many anchors
    shared = written(seen.groupBy("bucket").agg(F.sum(times).alias("n")).where("n > 1").select("bucket"))
    rows = written(seen.join(shared, "bucket").withColumn("done", F.lit(False)))
    discard(seen)
    discard(shared)
    every = F.explode(F.concat(F.array("pos"), F.coalesce("more", F.array().cast("array<int>"))))
    first, left = _round(rows, _refined(rows, key, times), every)

    # the bytes around the anchors that go on
    per = left.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "lo", "hi", "done")).alias("anchors"))
    per = per.select(F.col("id").alias("own_id"), F.col("th").alias("own_th"), "anchors")
    texts = d.join(per, d["id"].eqNullSafe(per["own_id"]) & (d["th"] == per["own_th"])).select("id", "th", F.col("t").cast("binary").alias("t"), F.explode("anchors").alias("x"))
    around = F.substring(F.col("t"), F.col("x.pos") - F.col("x.hi") + 1, F.col("x.hi") - F.col("x.lo") + least)
    held = written(texts.select("id", "th", "x.*", around.alias("context")))
    discard(left)

    def cut(step: int):
        def f(pdf: pd.DataFrame):
            got = parts(pdf["context"].tolist(), pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64), step, least, gram)
            own = pdf.iloc[got.pop("of").to_numpy(np.int64)]
            if step > 1:  # the part's own bytes go along only if the next round asks for them
                got["whole_lo"] = own["lo"].to_numpy()
            yield pd.DataFrame({c: own[c].to_numpy() for c in ("id", "th", "pos", "done")} | dict(got))

        return f

    schema = f"id {kind}, th long, pos int, done boolean, lo int, hi int, bucket long, ident long, ident2 long"
    rows = written(_each(held, cut(STEP), schema + ", whole_lo int"))
    second, left = _round(rows, _refined(rows, [*key, "whole_lo"]))

    parts_left = left
    left = left.alias("l")
    h = held.select("id", "th", "pos", F.col("lo").alias("whole_lo"), F.col("hi").alias("whole_hi"), "context").dropDuplicates(["id", "th", "pos", "whole_lo"]).alias("h")
    same = F.col("l.id").eqNullSafe(F.col("h.id")) & (F.col("l.th") == F.col("h.th")) & (F.col("l.pos") == F.col("h.pos")) & (F.col("l.whole_lo") == F.col("h.whole_lo"))
    part = F.substring("h.context", F.col("h.whole_hi") - F.col("l.hi") + 1, F.col("l.hi") - F.col("l.lo") + least)
    last = left.join(h, same).select("l.id", "l.th", "l.pos", "l.lo", "l.hi", "l.done", part.alias("context"))
    rows = written(_each(last, cut(1), schema))
    discard(held)
    discard(parts_left)
    many = written(rows.groupBy(*CLASS).agg(F.count("*").alias("n")).where("n > 1"))
    third = written(_repeated(rows, many))
    discard(rows)
    discard(many)
    return first.unionByName(second).unionByName(third)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and spans (start, past the end, in bytes);
    with_text: kept as well, the bytes that stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    per = repeated_starts(docs, id_col, text_col, least, gram).groupBy("id", "th").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    per = per.select(F.col("id").alias("own_id"), F.col("th").alias("own_th"), "a", "b")
    d = d.join(per, d["id"].eqNullSafe(per["own_id"]) & (d["th"] == per["own_th"]), "left").select("id", "t", "a", "b")
    kind = docs.schema[id_col].dataType.simpleString()

    def take(pdf: pd.DataFrame):
        rows = []
        for one, t, a, b in zip(pdf["id"], _bytes(pdf["t"]), pdf["a"], pdf["b"], strict=True):
            spans, kept = [], t
            if a is not None and len(a):
                a, b = np.asarray(a), np.asarray(b) + least
                by = np.argsort(a, kind="stable")
                a, reach = a[by], np.maximum.accumulate(b[by])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
                spans = list(zip(a[new].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist(), strict=True))
                edges = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
            rows.append((one, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans], *([kept] if with_text else [])))
        out = pd.DataFrame(rows, columns=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if with_text else [])])
        out["_id"] = out["_id"].astype(object).where(out["_id"].notna(), None)
        yield out

    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_text
    return _each(d, take, schema).withColumnRenamed("_id", id_col)
