"""Language ID by language-bitmask n-gram filters.

Training. Of each language, documents are taken by the hash of their id until about `train_docs` of
them (the documented bound; all, if there are fewer, or if it is None, as in the pipeline). Their n-grams (bytes of the lower-cased text,
`GRAMS` long) are counted by language, and a language contains an n-gram if that makes up at least
`min_share` of its n-grams. So a language has at most 1 / min_share n-grams, however large the corpus,
and only those reach the driver.

Filter. A bit-sliced Bloom filter: cell c holds a bitmask with a bit for each language, and an n-gram
is put in `HASHES` cells. ANDing an n-gram's cells gives all languages that contain it at once. The filter
is broadcast; its size follows from the languages and min_share, and beyond `MOST_BYTES`, or with more than
`MOST_LANGUAGES` labels, training refuses instead of sending more.

Prediction. For every n-gram of a whole text, the languages' bits are counted. With N n-grams and a
false-positive rate f of the language's slice (its share of set cells to the power of HASHES), the
number corrected for false positives is (count - f N) / (1 - f). The largest decides; its part of the
sum of all languages' numbers is the score. Only the text is looked at.

Known share. The score compares languages with each other, so it is high even where one n-gram in a
thousand is known. The largest number over N says how much of the text the language knows; `least_share`
takes from all labelled rows what texts of the learned languages have at least.

Defined results: null, or no letter at all: `und`, score 0; so is everything if nothing can be learned.
Languages with equal numbers: the first by code point. Repeated rows are judged one by one, null ids
stay null (and are not learned from), an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import fresh, written
from weirflow.operators.order import running_sum

GRAMS = (3, 4)
HASHES = 3
TRAIN_DOCS = 2000
MIN_SHARE = 1 / 20_000
#: Cells of the filter for each n-gram that it holds, about.
CELLS_PER_GRAM = 12
#: Bounds of what is broadcast and of the labels that reach the driver.
MOST_BYTES, MOST_LANGUAGES = 512 << 20, 1000
#: Characters whose n-grams are looked up at once. Longer texts are cut there, and all pieces count.
CHUNK = 1 << 18
#: Labelled rows below this quantile of known shares may be wrongly labelled; texts are in no learned language below this part of it.
QUANTILE, MARGIN = 0.001, 0.5


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the lower-cased texts as numbers of n bytes, and where in `texts` each is from. None crosses texts."""
    raw = [f" {t.lower()} ".encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    blank = (data == 9) | (data == 10) | (data == 13)
    data = np.where(blank, 32, data).astype(np.uint64)
    count = len(data) - n + 1
    value = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | data[k : k + count]
    of = np.repeat(np.arange(len(raw)), size)
    own = of[:count] == of[n - 1 :]
    return value[own], of[:count][own]


def _cells(gram: np.ndarray, n: int, cells: int) -> Iterator[np.ndarray]:
    """The HASHES cells of each n-gram: two halves of a mixed number, stepped."""
    with np.errstate(over="ignore"):
        x = (gram + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((a + np.uint64(k) * b) % np.uint64(cells)).astype(np.int64)


class Filter:
    """languages, the cells' bitmasks and the false-positive rate of each language's slice."""

    def __init__(self, languages: list[str], grams: dict[str, list[tuple[int, int]]]):
        self.languages = languages
        total = len({g for x in grams.values() for g in x})
        self.cells = max(1024, 1 << int(np.ceil(np.log2(max(1, total * CELLS_PER_GRAM)))))
        # one bit per language, in as many words of 64 as it takes
        if self.cells * 8 * (-(-len(languages) // 64) or 1) > MOST_BYTES:
            raise ValueError(f"a filter of {self.cells} cells for {len(languages)} languages is too large to broadcast; a larger min_share makes it smaller")
        self.masks = np.zeros((-(-len(languages) // 64) or 1, self.cells), np.uint64)
        for i, language in enumerate(languages):
            for n in GRAMS:
                own = np.array([g for k, g in grams.get(language, []) if k == n], np.uint64)
                for at in _cells(own, n, self.cells):
                    self.masks[i // 64, at] |= np.uint64(1 << (i % 64))
        filled = [((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.false = np.array(filled) ** HASHES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, how many n-grams each language contains, and the number of n-grams."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for n in GRAMS:
            gram, of = _grams(texts, n)
            total += np.bincount(of, minlength=len(texts))
            cells = list(_cells(gram, n, self.cells))
            for word, masks in enumerate(self.masks):
                found = masks[cells[0]]
                for at in cells[1:]:
                    found = found & masks[at]
                for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                    bit = (found >> np.uint64(i % 64)) & np.uint64(1)
                    hits[:, i] += np.bincount(of, weights=bit, minlength=len(texts))
        return hits, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, its score, and the share of the text's n-grams that it contains."""
        label, score, share = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return label, score, share
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        pieces = [(i, texts[i][at : at + CHUNK]) for i in known for at in range(0, len(texts[i]), CHUNK)]
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (size == 0 or size + len(pieces[hi][1]) <= CHUNK):
                size += len(pieces[hi][1])
                hi += 1
            found, of = self.counts([p for _, p in pieces[lo:hi]]), [i for i, _ in pieces[lo:hi]]
            np.add.at(hits, of, found[0])
            np.add.at(total, of, found[1])
            lo = hi
        real = np.maximum((hits - self.false * total[:, None]) / (1 - np.minimum(self.false, 0.999)), 0)
        best, whole = real.argmax(1), real.sum(1)
        for i in known:
            label[i] = self.languages[best[i]]
            score[i] = float(min(1.0, real[i, best[i]] / whole[i])) if whole[i] > 0 else 0.0
            share[i] = float(min(1.0, real[i, best[i]] / total[i])) if total[i] > 0 else 0.0
        return label, score, share


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int | None) -> tuple[dict[str, int], DataFrame | None]:
    """Labelled rows of each language, and those taken to learn from (id, t, lang), all of them if train_docs is None; none without labels."""
    seen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("id IS NOT NULL AND t IS NOT NULL AND lang IS NOT NULL")
    per = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(per) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels; they are hardly languages")
    if not per:
        return per, None
    if train_docs is None:
        return per, seen
    rank = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    part = F.coalesce(*(F.when(F.col("lang") == k, F.lit(int(min(1.0, train_docs / n) * (1 << 20)))) for k, n in per.items()))
    return per, seen.where(rank < part)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int | None = TRAIN_DOCS, min_share: float = MIN_SHARE) -> Filter:
    """docs: labelled rows only to learn from. At most about `train_docs` of a language are read whole; None: all of them, which costs time in proportion and no more memory."""
    per, sample = training_rows(docs, id_col, text_col, lang_col, train_docs)
    if sample is None:
        return Filter([], {})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                for n in GRAMS:
                    gram, times = np.unique(_grams(own["t"].tolist(), n)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": gram.astype(np.int64), "times": times})

    grams = sample.select("t", "lang").mapInPandas(count, "lang string, n int, gram long, times long")
    grams = grams.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    grams = written(grams)
    whole = grams.groupBy("lang", "n").agg(F.sum("times").alias("whole"))
    kept = grams.join(whole, ["lang", "n"]).where(F.col("times") >= F.greatest(F.lit(2), F.col("whole") * min_share))
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in per}
    for r in kept.select("lang", "n", "gram").toPandas().itertuples(index=False):  # 1 / min_share each at most
        found[r.lang].append((r.n, r.gram))
    return Filter(sorted(per), found)


def least_share(judged: DataFrame, pred_col: str = "lang_pred", share_col: str = "share", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The known share below which a text is in no learned language: MARGIN of the QUANTILE of all labelled rows that are judged as labelled, exactly. judged: the rows with
    what `detect` found. Rows are counted by share first, so no task has all of them."""
    own = judged.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(pred_col) == F.col(lang_col)))
    counts = own.groupBy(F.col(share_col).alias("share")).agg(F.count("*").alias("n"))
    upto = running_sum(counts, "n", "share", name="before", total="whole")
    # the least share that at least QUANTILE of the rows don't exceed
    return MARGIN * (upto.where(F.col("before") + F.col("n") >= F.ceil(F.col("whole") * F.lit(QUANTILE))).agg(F.min("share")).first()[0] or 0.0)


def detect(docs: DataFrame, model: Filter, text_col: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language, its score and, if `into` has a third name, the known share in the columns `into` (in place of its own, if it has any); all else stays."""

    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label string, score double, share double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        label, score, share = sent.value.judge([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"label": label, "score": score, "share": share})

    found = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() not in into]
    return docs.withColumn(found, judge(F.col(text_col))).select(*kept, *(F.col(found)[field].alias(name) for field, name in zip(("label", "score", "share"), into)))
