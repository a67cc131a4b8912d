"""Source divergence and spelling variants against plain versions, on rows made to be awkward."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from weirflow.llm import divergence, queries, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, id long, word string, key string, total string, terms string, a string, b string, p string, root string"


def table(spark, rows):
    """(id, text, lang, source), and columns whose names the operators might use themselves."""
    return spark.createDataFrame([(*r, "?", 0, 0, *["?"] * 8) for r in rows], SCHEMA)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


RNG = random.Random(7)
STEMS = ["alphabet", "Béta", "GAMMA", "δέλτα", "theory", "of", "x", "license", "ÀÉÎÕÜàé", "日本", "letters", "lettters", "letter's", "don't"]
TEXTS = [None, "", " \n ", "!! 12 34", *(" ".join(RNG.choices(STEMS, k=RNG.randrange(1, 60))) for _ in range(60))]
ROWS = [(RNG.choice([1, 2, 3, None]), t, RNG.choice(["en", "de", "", None]), RNG.choice(["a", "b", "é", "", None])) for t in TEXTS]
ROWS += ROWS[:9] + [(9, "onlyhere " * 30, "fr", "a"), (9, None, "fr", "b"), (8, None, "xx", None)]


@pytest.mark.parametrize("least", [1, 4, 10, 1000])
def test_divergence(spark, least):
    got = divergence.divergence(table(spark, ROWS).repartition(3), min_docs=least, top=3).collect()
    assert ordered(got) == ordered(brute.divergence([r[1:] for r in ROWS], least, 3))


def test_divergence_in_small_parts(spark, monkeypatch):
    """Tasks that give out terms early, texts cut within a term."""
    monkeypatch.setattr(divergence, "HELD", 5)
    expected = ordered(brute.divergence([r[1:] for r in ROWS], 4, 10))
    assert ordered(divergence.divergence(table(spark, ROWS), min_docs=4).collect()) == expected
    text = "".join(RNG.choice(["abc", "Dé", " ", "x" * 50, "."]) for _ in range(3000))
    whole = divergence.counted(text)
    monkeypatch.setattr(divergence, "PIECE", divergence.re.compile(f"(?s).{{1,7}}[^{divergence.NO_TERM}]*"))
    assert divergence.counted(text) == whole == brute.Counter(brute.TERM.findall(text.translate(brute.LOWER)))


def test_shares_of_very_many_words_are_exact(spark):
    n, total, terms = 9_000_000_000_123, 9_000_000_000_999_999, 7
    got = spark.range(1).select(divergence.share(f"{n}L", f"{total}L", f"{terms}L").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_empty(spark):
    none = table(spark, ROWS).limit(0)
    assert divergence.divergence(none).collect() == []
    assert spelling.variant_groups(spelling.word_counts(queries.with_slips(spelling.runs(none)))).collect() == []


def variants(spark, counts, ratio=10):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return ordered(spelling.variant_groups(words, ratio).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants(spark):
    """Chains, ties, runs of equal letters, transpositions, letters beyond ASCII, one long word and its variants."""
    rng = random.Random(3)
    words = {}
    for stem, n in (("aaaaaaaa", 1000), ("abababab", 5000), ("ÀÉÎÕÜàéx", 300), ("spelling", 100_000)):
        for _ in range(25):
            w = list(stem)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [w[i], rng.choice("abxé")], [rng.choice("abxé")], w[i : i + 1][::-1]])
            words["".join(w)] = max(1, n // 10 ** rng.randrange(6))
    long = "".join(rng.choices("abc", k=3000))
    words |= {long: 100, long[:1500] + long[1501:]: 10, long[:700] + "z" + long[701:]: 9, long + "c": 3, "y" * 3000: 1, "y" * 3001: 30, "": 5, "a": 60, "b": 60, "\U0001f600": 700}
    for ratio in (10, 2):
        got = variants(spark, words, ratio)
        assert got == ordered(brute.variants(words, ratio))
    assert any(form is not None and form != root for _, form, root, *_ in got)


def test_pairs_come_out_once_whatever_the_hashes(spark, monkeypatch):
    """All deletions share one hash: what meets is told apart by the strings themselves."""
    monkeypatch.setattr(spelling, "keys", lambda words, own=spelling.keys: own(words).withColumn("key", F.lit(1)))
    words = {"aab": 100, "ab": 5, "abb": 7, "aabb": 1, "ba": 50, "baab": 2, "xyz": 9}
    assert variants(spark, words) == ordered(brute.variants(words))


def test_slips_and_variants_of_documents(spark):
    texts = [(i % 40, " ".join(RNG.choices(["spelling", "speling", "Spellings", "ÀÉÎÕÜàé", "short", "différence", "diference"], k=200))) for i in range(60)] + [(None, "spelling " * 20), (None, None), (3, "")]
    docs = table(spark, [(i, t, None, None) for i, t in texts])
    words = spelling.word_counts(queries.with_slips(spelling.runs(docs)))
    expected = brute.slipped(texts)
    assert {r.word: r.n for r in words.collect()} == expected and len(expected) > 5
    assert ordered(spelling.variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n").collect()) == ordered(brute.variants(expected))


def test_texts_of_megabytes(spark):
    text = " ".join(RNG.choices(["spelling", "différence", "of", "Of"], k=400_000)) + " " + "q" * 1_000_000
    docs = table(spark, [(1, text, "en", "a"), (2, text, "en", "b")])
    got = divergence.divergence(docs, min_docs=2).where("part = 'pair'").collect()
    assert [(r.source, r.item, r.value) for r in sorted(got)] == [("a", "b", 0), ("b", "a", 0)]
    words = spelling.word_counts(spelling.runs(docs).select(F.col("run").alias("word")))
    assert {r.word[:9]: r.n_near for r in spelling.variant_groups(words).collect()} == {"spelling": 0, "différenc": 0, "q" * 9: 0}
