"""Spelling variants grouped under their frequent forms by a symmetric-delete join.

1. Every word emits the hashes of itself and of its distinct single deletions. The hashes come from sums
   over all characters before and after the deleted one, so a word of n characters costs n steps and n
   rows of three numbers, however long it is.
2. Words that share a hash meet in an equi-join. What the hash stands for is compared as text, and the
   distance must be exactly one. Two words at distance one share exactly one deletion: where a
   character is replaced, all deletions that agree are the same string, and where one is inserted, it
   is the shorter word. So a pair comes out once. A deletion of n characters is shared by fewer than
   (n + 1) x (characters of the alphabet) words, whatever the size of the corpus.
3. Of each word's near words the most frequent is its form, if it is frequent enough. A form has at
   least `ratio` times the occurrences of its word, so chains of forms end; they are followed by joining
   the table of links with itself, which doubles the steps each time.

Defined results: null texts have no words. Equal words are one row. No words give no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import ascii_lower, discard, written

#: Runs of ASCII letters and the Latin-1 range of accented ones.
LETTERS = "A-Za-zÀ-ÿ"
LEAST, RATIO = 7, 10
#: Odd multipliers of the hashes, and what BASE times it is 1 modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, run): maximal runs of `least` letters or more, A-Z lower-cased, as often as they are there."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))


def word_counts(words: DataFrame, least: int = LEAST, twice: int = 2) -> DataFrame:
    """(word, n) of a column `word`: those of `least` characters or more that are there `twice` times at least."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, deleted place, hash): place -1 is the word itself; equal deletions come once, at the first place."""
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - (ends - sizes)[word]
    powers = np.multiply.accumulate(np.full(max(int(sizes.max(initial=0)), 1), BASE, np.uint64))
    part = _mixed(chars + np.uint64(1)) * powers[place]
    upto = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(part, dtype=np.uint64)])
    whole = upto[ends] - upto[ends - sizes]
    before = upto[:-1] - upto[(ends - sizes)[word]]
    without = before + (whole[word] - before - part) * np.uint64(INVERSE)
    first = np.ones(len(chars), bool)
    first[1:] = (chars[1:] != chars[:-1]) | (place[1:] == 0)
    size = sizes.astype(np.uint64)
    own, less = _mixed(whole + size * np.uint64(0x94D049BB133111EB)), _mixed(without + (size[word] - np.uint64(1)) * np.uint64(0x94D049BB133111EB))
    return np.concatenate([np.arange(len(words)), word[first]]), np.concatenate([np.full(len(words), -1), place[first]]), np.concatenate([own, less[first]]).view(np.int64)


def keys(words: DataFrame) -> DataFrame:
    """(id, word) -> (key, id, at)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                if part.num_rows:
                    word, at, key = deletions(part.column("word").to_pylist())
                    ids = part.column("id").to_numpy()[word]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(at.astype(np.int32))], ["key", "id", "at"])

    return words.select("id", "word").mapInArrow(emit, "key long, id long, at int")


def _without(word: Column, at: Column) -> Column:
    return F.when(at < 0, word).otherwise(F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word))))


def near_pairs(words: DataFrame) -> DataFrame:
    """words: a written table (id, word, n). Pairs (a, b) of ids at distance exactly one, each once, with word and n of both."""
    own = keys(words)
    met = own.alias("x").join(own.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    met = met.select(F.col("x.id").alias("a"), F.col("x.at").alias("a_at"), F.col("y.id").alias("b"), F.col("y.at").alias("b_at"))
    for side in "ab":
        met = met.join(words.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"), F.col("n").alias(f"{side}_n")), side)
    same = _without(F.col("a_word"), F.col("a_at")) == _without(F.col("b_word"), F.col("b_at"))
    return met.where(same & (F.levenshtein("a_word", "b_word", 1) == 1)).drop("a_at", "b_at")


def roots(links: DataFrame) -> DataFrame:
    """(id, form) without cycles -> (id, root): the last that can be reached."""
    now = written(links.select("id", F.col("form").alias("root")))
    while True:
        after = now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.id"), "left")
        after = written(after.select("x.id", F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")))
        discard(now)
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n), each word once -> word, n, form, form_n, n_near, root. form is the near word of largest n (ties: the least in order of
    code points) if that is at least `ratio` times the word's own, else null; root is where the forms lead to, or the word."""
    table = written(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(table)
    side = lambda a, b: F.struct(F.col(a).alias("id"), F.col(f"{a}_n").alias("n"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(f"{b}_word").alias("word"), F.col(b).alias("id")).alias("near"))
    each = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a"))))
    best = each.groupBy("id", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    enough = -F.col("near.less") >= ratio * F.col("n")
    best = written(best.select("id", "n_near", *(F.when(enough, c).alias(k) for k, c in (("form_id", F.col("near.id")), ("form", F.col("near.word")), ("form_n", -F.col("near.less"))))))
    last = roots(best.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    ends = last.join(table.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = table.join(best, "id", "left").join(ends, "id", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("root_word", "word").alias("root"))
