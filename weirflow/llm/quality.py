"""Quality rules: a threshold table compiled into one projection, without user functions.

`MEASURES` holds one expression per measure over a text's words and lines, `RULES` the allowed range
of each. `quality_rules` compiles both into columns of one Select; the plan is a scan and a
projection, so it moves no rows at all and grows with the input only.

Defined results: a null or blank text has no words, fails the base rule and isn't kept. Repeated rows
are judged one by one, null ids stay null, an empty table gives no rows, and columns of the input
other than the id and the text are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import PLAIN_WORD

# Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with in is it for as on this by from are was not or an at "
    "der die das und ist von zu mit den im ein eine nicht auf sich des dem für als auch "
    "le la les de des et un une est en que qui dans pour sur pas par du au avec "
    "el los las y del se con una su al lo como más por es"
).split()

#: Least words, and the most percent of words in repeated three-word windows: the base rule.
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50

#: measure -> (least, most); None leaves a side open. Ratios are of words or of lines with a word.
RULES: dict[str, tuple[float | None, float | None]] = {
    "mean_word_length": (2.0, 15.0),
    "symbol_ratio": (None, 0.1),
    "stop_word_ratio": (0.05, None),
    "dup_line_ratio": (None, 0.5),
    "bullet_line_ratio": (None, 0.9),
    "ellipsis_line_ratio": (None, 0.3),
}

BULLET, ELLIPSIS = r"^[ \t]*[-*•‣]", r"(\.\.\.|…)[ \t\r]*$"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"



def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


#: measure -> its expression over the counts of `counts`.
MEASURES = {
    "mean_word_length": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "bullet_line_ratio": lambda: _ratio("n_bullets", "n_lines"),
    "ellipsis_line_ratio": lambda: _ratio("n_ellipses", "n_lines"),
}


def counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its id as `_id` and whole numbers over the words and lines of its whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0)).alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    df = df.select("*", lines.alias("_l"), F.sort_array(grams).alias("_g"))

    # equal three-word windows are neighbours once sorted by their hash; these are where repeated ones start
    g = F.col("_g")
    again = F.filter(g, lambda x, i: (F.get(g, i + 1)["h"] == x["h"]) | (F.get(g, i - 1)["h"] == x["h"]))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), p + 3) - p))

    size = lambda x: F.size(x).cast("long")
    made = {
        "_id": F.col("_id"),
        "n_words": size("_w"),
        "word_chars": F.length(F.regexp_replace("_t", BLANK, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_lines": size("_l"),
        "n_dup_lines": size("_l") - size(F.array_distinct("_l")),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"),
        "n_stop": size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:"))).isin(*STOP_WORDS))),
        "n_bullets": size(F.filter("_l", lambda x: x.rlike(BULLET))),
        "n_ellipses": size(F.filter("_l", lambda x: x.rlike(ELLIPSIS))),
    }
    # as a generator of one row, so that no condition on a verdict is pushed below and counts everything again for each of its terms
    return df.select(F.inline(F.array(F.struct(*(v.alias(k) for k, v in made.items())))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict | None = None) -> DataFrame:
    """One row per document: the counts, every measure, the names of the rules it breaks, and the verdict.

    Columns: the id under its own name, the counts, one column per measure, failed_rules (sorted as in
    the table), base_failed, kept.
    """
    rules = RULES if rules is None else rules
    df = counts(docs, id_col, text_col)
    df = df.select("*", *(MEASURES[m]().alias(m) for m in rules))
    broken = []
    for m, (least, most) in rules.items():
        outside = F.lit(False)
        if least is not None:
            outside = outside | (F.col(m) < least)
        if most is not None:
            outside = outside | (F.col(m) > most)
        broken.append(F.when(outside, F.lit(m)))
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    df = df.select("*", failed.alias("failed_rules"), base.alias("base_failed"))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return df.withColumnRenamed("_id", id_col)
