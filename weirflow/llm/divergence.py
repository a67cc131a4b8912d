"""How far the sources of a language differ in their words: inclusion-exclusion over what each of them uses.

A group is the documents of one language and source. Of each kept term a group has a smoothed share p
(in billionths, at least 1), and two groups differ by f(p, q) = floor((p - q)^2 / (p + q)) summed over
all kept terms. Most terms are missing from most groups, so no group is ever written out over all terms:

* a term that neither has costs f(p0, q0), the same for all, times the number of kept terms;
* a term that one side has is priced from that side's histogram of counts: how many terms it has so
  often. Terms of both sides are priced so twice, once from each;
* terms of both sides meet in a join of postings (language, term), counted by the two counts, and
  correct what the histograms took for one-sided: + f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

Terms are counted in Arrow batches, whose tasks put a group's equal terms together before they are
shuffled; texts are taken a million characters at a time. A term's postings are one row per source, so
what it adds to the join is at most the number of pairs of sources, which is also the result's size.

All arithmetic is on whole numbers; shares are worked out in decimals, so counts of a trillion words fit.

Defined results: null text, language or source is read as ''. Every group that occurs is compared, with
or without terms; if a language keeps no term, all values are 0. Repeated rows count as documents of
their own. Ties in value are ranked by the item's bytes. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import written

NO_TERM = r"\x00-\x40\x5B-\x60\x7B-\x7F"
TERM = re.compile(f"[^{NO_TERM}]+")
#: A million characters, and the rest of a term that is cut.
PIECE = re.compile(f"(?s).{{1,1000000}}[^{NO_TERM}]*")
MIN_DOCS, TOP = 10, 10
#: Terms that a task holds before it gives them out.
HELD = 500_000


def counted(text: str | None) -> Counter:
    """A text's terms, A-Z lower-cased."""
    own: Counter = Counter()
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: only A-Z
    for piece in PIECE.finditer(lowered):
        own.update(TERM.findall(piece.group()))
    return own


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, docs_of, held = defaultdict(Counter), defaultdict(Counter), 0
        for pdf in batches:
            for lang, source, text in pdf.itertuples(index=False, name=None):
                own = counted(text)
                group = times[lang, source]
                held -= len(group)
                group.update(own)
                docs_of[lang, source].update(own.keys())
                held += len(group)
                if held > HELD:
                    yield from frames(times, docs_of)
                    times, docs_of, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from frames(times, docs_of)

    def frames(times: dict, docs_of: dict) -> Iterator[pd.DataFrame]:
        for (lang, source), own in times.items():
            if own:
                yield pd.DataFrame({"lang": [lang] * len(own), "source": [source] * len(own), "term": list(own), "n": list(own.values()), "docs": [docs_of[lang, source][t] for t in own]})

    columns = [F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    parts = docs.select(columns).mapInPandas(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """Billionths of `total` words that n of them are, smoothed over the kept terms; null if there are none."""
    return F.expr(f"CAST(1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * 1000000000) DIV NULLIF(CAST({total} + 2 * {terms} AS DECIMAL(20, 0)), 0) AS BIGINT)")


def difference(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q})))"


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). part `pair`: how far the group is from each other source of its language. part `term`: the
    `top` terms that it uses more than its language as a whole."""
    counts = written(term_counts(docs, lang_col, source_col, text_col))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    whole = written(whole.drop("docs"))
    kept = written(counts.join(whole, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))

    langs = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = written(groups.withColumn("none", share("0", "total", "terms")))

    def of(side: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(side), F.col("total").alias(f"{side}_total"), F.col("none").alias(f"{side}_none"), F.col("terms").alias(f"{side}_terms"))

    # what neither has, for every pair of sources
    pairs = of("a").join(of("b"), "lang").where("a < b")
    neither = pairs.select("lang", "a", "b", F.expr(f"coalesce(a_terms * {difference('a_none', 'b_none')}, 0)").alias("value"))
    # what one has
    times = kept.groupBy("lang", F.col("source").alias("a"), "n").agg(F.count("*").alias("k")).join(of("a"), ["lang", "a"]).withColumn("p", share("n", "a_total", "a_terms"))
    one = times.join(of("b"), "lang").where("a <> b")
    one = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr(f"k * ({difference('p', 'b_none')} - {difference('a_none', 'b_none')})").alias("value"))
    # what both have
    posting = lambda x: kept.select("lang", "term", F.col("source").alias(x), F.col("n").alias(f"{x}_n"))
    both = posting("a").join(posting("b"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "a_n", "b_n").agg(F.count("*").alias("k"))
    both = both.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"]).withColumns({"p": share("a_n", "a_total", "a_terms"), "q": share("b_n", "b_total", "b_terms")})
    correction = f"k * ({difference('p', 'q')} - {difference('p', 'b_none')} - {difference('a_none', 'q')} + {difference('a_none', 'b_none')})"
    both = both.select("lang", "a", "b", F.expr(correction).alias("value"))
    total = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    each = total.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = each.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")}).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return far.unionByName(own)
