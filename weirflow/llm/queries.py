"""The operators over their whole tables, under their production parameters, and the SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import shared_path, written
from weirflow.llm.decontaminate import WINDOW, contamination
from weirflow.llm.divergence import MIN_DOCS, TOP, divergence
from weirflow.llm.jaccard import jaccard_groups
from weirflow.llm.langid import detect, held_out, train
from weirflow.llm.licenses import license_scan
from weirflow.llm.mixing import BLOCK, GOLDEN, POINTS, mix_counts
from weirflow.llm.quality import BULLET, ELLIPSIS, RULES, STOP_WORDS, quality_rules
from weirflow.llm.secrets import found_in, labelled_findings, secret_scan
from weirflow.llm.secrets import train as train_secrets
from weirflow.llm.simhash import simhash_groups
from weirflow.llm.spelling import LEAST, runs, variant_groups, word_counts
from weirflow.llm.suffixdedup import dedup_spans
from weirflow.llm.urlfilter import DEFAULT, HOST_RULES, PATTERN_RULES, url_filter
from weirflow.llm.warc import read_warc, transactions, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, {_ALNUM}), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' ') AS gram
      FROM (SELECT *, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, i, n, item_id FROM p JOIN g USING (n, gram)),
x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT b.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains({list(STOP_WORDS)}, lower(rtrim(x, '.,;:'))))) AS n_stop,
             len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) AS n_bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS n_ellipses
      FROM b LEFT JOIN c ON b.doc_id = c.doc_id),
q AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN {RULES["mean_word_length"][0]} AND {RULES["mean_word_length"][1]}
       AND n_symbols / n_words <= {RULES["symbol_ratio"][1]} AND n_stop / n_words >= {RULES["stop_word_ratio"][0]}
       AND n_dup_lines / n_lines <= {RULES["dup_line_ratio"][1]} AND n_bullets / n_lines <= {RULES["bullet_line_ratio"][1]}
       AND n_ellipses / n_lines <= {RULES["ellipsis_line_ratio"][1]} AS kept
FROM q
"""

# base 32 of a digest: its 160 bits in runs of five
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + list_sum(list_transform(range(5), lambda k: bits[5 * i + k + 1]::BIGINT * (16 >> k::INT)))::BIGINT]), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM h
"""

_PATTERNS = "".join(f" WHEN regexp_matches(url, '{pattern}') THEN '{verdict}'" for _, verdict, pattern, _ in PATTERN_RULES)

OP6_SQL = f"""
WITH u AS (SELECT page_id, url, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES {", ".join(map(str, HOST_RULES))}),
x AS (SELECT u.*, (SELECT max_by((h || p, verdict), length(h || p)) FROM r
                   WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS best FROM u)
SELECT page_id, host, path, best[1] AS rule,
       coalesce(best[2], CASE WHEN url IS NULL THEN '{DEFAULT}'{_PATTERNS} ELSE '{DEFAULT}' END) AS verdict
FROM x
"""

OP8_SQL = f"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM z GROUP BY source),
a AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(3 * source_size) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0) AS gone FROM s
      WINDOW o AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, 3 * source_size * (weights - gone) <= (total - capped) * weight AS stops FROM a),
f AS (SELECT *, first(CASE WHEN NOT stops THEN total - capped END ORDER BY stops, source_size / weight, encode(source) NULLS LAST) OVER () AS rest,
             first(CASE WHEN NOT stops THEN weights - gone END ORDER BY stops, source_size / weight, encode(source) NULLS LAST) OVER () AS open FROM e),
t AS (SELECT source, source_size, total, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE rest::DOUBLE * weight / open END AS target FROM f),
h AS (SELECT *, coalesce(sum(target) OVER (ORDER BY encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) / nullif(sum(target) OVER (), 0), 0) AS hi FROM t),
i AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY encode(source) NULLS LAST), 0) AS lo FROM h),
k AS (SELECT slot, (slot % {POINTS} * {GOLDEN}) % {POINTS} / {POINTS}.0::DOUBLE AS x
      FROM (SELECT unnest(range((SELECT ((sum(size) + {BLOCK - 1}) // {BLOCK})::BIGINT FROM z))) AS slot)),
n AS (SELECT i.source, least(count(*) * {BLOCK}, 3 * any_value(source_size)) AS words FROM k JOIN i ON x >= lo AND x < hi GROUP BY i.source),
p AS (SELECT z.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z)
SELECT p.doc_id, p.size, t.source_size::BIGINT AS source_size, t.target,
       (coalesce(n.words // nullif(t.source_size, 0), 0) * p.size
        + greatest(least(start + p.size, coalesce(n.words % nullif(t.source_size, 0), 0)) - start, 0))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON p.source IS NOT DISTINCT FROM n.source
"""

OP11_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN t USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)
      UNION ALL SELECT lang, NULL, term, sum(n) FROM c GROUP BY lang, term),
p AS (SELECT *, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM a),
x AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
      UNION ALL SELECT x.lang, x.source, 'term', x.term, ((x.p - y.p) * (x.p - y.p)) // (x.p + y.p) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND y.source IS NULL WHERE x.source IS NOT NULL AND x.n > 0 AND x.p > y.p)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM f
QUALIFY part = 'pair' OR rank <= {TOP}
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_warc", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = shared_path(spark)
    write_warc(table(spark, sf_dir, "pages"), archive, min_bytes=0)
    seen = transactions(written(read_warc(spark, archive, payloads=False)))
    page = F.element_at("metadata", 1)["fields"]["page_id"].cast("long")
    seen = seen.select("record_id", page.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").alias("first_id"))
    seen = written(seen)
    firsts = seen.where("record_type = 'response'").select(F.col("record_id").alias("first_id"), F.col("page_id").alias("refers_to")).distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = seen.where("first_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))  # refers to nothing, so is joined to nothing
    again = seen.where("first_id IS NOT NULL").join(firsts, "first_id", "left")
    return own.select(columns).unionByName(again.select(columns))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    seen = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return detect(seen, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan(docs, train_secrets(labelled_findings(spark).unionByName(found_in(docs))))
    first = F.expr("get(findings, 0).start").cast("long")
    digest = F.sha2(F.expr("array_join(transform(findings, x -> x.sha256), ',')"), 256)
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_findings"), first.alias("first_start"), digest.alias("secrets_sha256"), "score")


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query("op11_divergence", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def with_slips(found: DataFrame) -> DataFrame:
    """(id, run) -> word: of every 31st run by its hash, one letter is left out."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    left_out = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % 31 == 0, left_out).otherwise(F.col("run")).alias("word"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(with_slips(runs(table(spark, sf_dir, "documents"), least=LEAST)))
    return variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_jaccard_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
