"""URL filters: pattern rules, each indexed by its rarest literal token.

A rule is a regular expression over the whole URL and comes with literal tokens that any URL it
matches has whole (runs of ASCII letters, digits and non-ASCII). Tokens of rules and of URLs are
lower-cased in A-Z alike. How many URLs have each of those tokens is counted over all URLs, and a rule is
filed under its rarest one. URLs fetch their tokens' rules by a join on the token and run only those rules'
regular expressions; rules without a literal, of which `BROADCAST_RULES` are allowed, are run for each.
The table of rules is broadcast while it has at most `BROADCAST_RULES` rows; beyond, both sides are
shuffled by token, a row per rule, which Spark can split at a frequent token. Of a URL's matching rules
the one of the highest rank decides.

Only matches and one row per URL are aggregated; all of it is built-in functions.

Defined results: null, or no "://": host and path are empty and no host rule fits; the verdict is the
default. Repeated rows are judged one by one, null ids stay null, an empty table gives no rows, other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import ALNUM_WORD, ascii_lower, written

BROADCAST_RULES = 100_000

# Fixed values: (verdict, host, path); a rule fits its host and all subdomains if the path starts with its path.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Name, verdict, pattern over the URL, literal tokens that a match has whole. First match wins.
PATTERN_RULES = [
    ("ip-host", "block", r"^[^:]*://(?:[^/?#@]*@)?[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:[/?#]|$)", []),
    ("login", "block", r"(?i)[/?&](?:login|signin|logout)(?:[/?&=.#]|$)", []),
    ("bets", "block", r"(?i)^[^:]*://(?:[^/?#]*[.\-])?bets(?:[.\-][^/?#]*)?(?:[/?#]|$)", ["bets"]),
    ("casino", "block", r"(?i)^[^:]*://(?:[^/?#]*[.\-])?casino(?:[.\-][^/?#]*)?(?:[/?#]|$)", ["casino"]),
    ("poker", "block", r"(?i)^[^:]*://(?:[^/?#]*[.\-])?poker(?:[.\-][^/?#]*)?(?:[/?#]|$)", ["poker"]),
    ("porn", "block", r"(?i)^[^:]*://(?:[^/?#]*[.\-])?porn(?:[.\-][^/?#]*)?(?:[/?#]|$)", ["porn"]),
    ("xxx", "block", r"(?i)^[^:]*://(?:[^/?#]*[.\-])?xxx(?:[.\-][^/?#]*)?(?:[/?#]|$)", ["xxx"]),
    ("pills", "block", r"(?i)^[^:]*://(?:[^/?#]*[.\-])?pills(?:[.\-][^/?#]*)?(?:[/?#]|$)", ["pills"]),
    ("doubleclick", "block", r"(?i)^[^:]*://(?:[^/?#]*\.)?doubleclick\.net(?:[/:?#]|$)", ["doubleclick", "net"]),
    ("wp-admin", "block", r"(?i)^[^:]*://[^/?#]*/(?:[^?#]*/)?wp-admin(?:[/?#]|$)", ["wp", "admin"]),
    ("cgi-bin", "block", r"(?i)^[^:]*://[^/?#]*/(?:[^?#]*/)?cgi-bin(?:[/?#]|$)", ["cgi", "bin"]),
]
DEFAULT = "allow"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(found), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_table(rules: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) as the table of `url_filter`: rank, name, verdict, pattern, tokens, by_host. Longer ones rank higher.
    Hosts are lower-cased in A-Z, as those of URLs are; paths stay as they are, and only their tokens are lower-cased."""
    quoted = lambda c: F.regexp_replace(c, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")
    words = lambda c: F.regexp_extract_all(ascii_lower(c), F.lit(ALNUM_WORD), F.lit(0))
    where, start = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce(F.col("path"), F.lit(""))
    # the last word of the path may go on in the URL
    of_path = F.when(start.rlike(r"(^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])\z"), words(start)).otherwise(F.slice(words(start), 1, F.greatest(F.size(words(start)) - 1, F.lit(0))))
    # only the first "://" counts, so what comes before it has none
    pattern = F.concat(F.lit(r"(?s)^(?:(?!://).)*://(?:[^/?#]*\.)?(?i:"), quoted(where), F.lit(r")(?=[/?#]|\z)"), quoted(start))
    rank = (F.length(where) + F.length(start)).cast("int")
    return rules.select(rank.alias("rank"), F.concat(where, start).alias("name"), "verdict", pattern.alias("pattern"), F.concat(words(where), of_path).alias("tokens"), F.lit(True).alias("by_host"))


def pattern_table(rules: DataFrame) -> DataFrame:
    """Rules (place, name, verdict, pattern, tokens) as the table of `url_filter`. They rank below host rules, the least place first."""
    tokens = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), ascii_lower)
    return rules.select((-1 - F.col("place")).cast("int").alias("rank"), "name", "verdict", "pattern", tokens.alias("tokens"), F.lit(False).alias("by_host"))


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list as a table of literals."""
    made = [F.struct(*(F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x) for x in row)) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made).cast(f"array<struct<{schema}>>")))


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: DataFrame | list = HOST_RULES, pattern_rules: DataFrame | list = PATTERN_RULES, default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """One row per URL: the id, host, path, rule (the host rule that decides, else null), pattern (the pattern rule that does, else null), verdict.

    Rules come as lists or, in any number, as tables: (verdict, host, path) and (place, name, verdict, pattern, tokens).
    Of equally ranked host rules the first by name, verdict and pattern decides.
    """
    spark = pages.sparkSession
    if not isinstance(host_rules, DataFrame):
        host_rules = _literal(spark, host_rules, "verdict:string,host:string,path:string")
    if not isinstance(pattern_rules, DataFrame):
        pattern_rules = _literal(spark, [(i, *r) for i, r in enumerate(pattern_rules)], "place:int,name:string,verdict:string,pattern:string,tokens:array<string>")
    table = written(host_table(host_rules).unionByName(pattern_table(pattern_rules)).withColumn("no", F.monotonically_increasing_id()))
    literal = F.filter("tokens", lambda t: t != "")
    stated = table.agg(F.count("*"), F.sum((F.size(literal) == 0).cast("long"))).first()
    few = stated[0] <= broadcast_rules
    if (stated[1] or 0) > broadcast_rules:
        raise ValueError(f"{stated[1]} rules have no literal token, so every URL would have to run them all; at most {broadcast_rules} may")
    small = F.broadcast if few else lambda df: df

    tokens = F.array_distinct(F.coalesce(F.regexp_extract_all(ascii_lower(F.col("url")), F.lit(ALNUM_WORD), F.lit(0)), F.array().cast("array<string>")))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"))
    if not few:
        urls = written(urls)  # read more than once, so a row must keep its number

    # a rule goes under the token that fewest URLs have
    own = table.select("no", F.explode(literal).alias("token"))
    seen = urls.select(F.explode(tokens).alias("token")).join(small(own.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("no").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    rule = F.struct("rank", "name", "verdict", "pattern", "by_host").alias("rule")
    index = table.join(rarest, "no").select("token", rule)
    bare = table.where(F.size(literal) == 0).agg(F.collect_list(rule).alias("bare"))  # as many as may be broadcast, in one row
    best_of = lambda rules: F.array_max(F.filter(rules, lambda r: F.rlike(F.col("url"), r["pattern"])))
    if few:
        # a URL's tokens fetch arrays of rules; the token "" stands for the URL itself and for the rules without a literal
        index = written(index.groupBy("token").agg(F.collect_list("rule").alias("rules")).unionByName(bare.select(F.lit("").alias("token"), F.col("bare").alias("rules"))), 1)
        each = urls.select("id", "url", "row", F.explode(F.concat(F.array(F.lit("")), tokens)).alias("token"))
        met = each.join(F.broadcast(index), "token", "left").withColumn("best", best_of("rules")).where("best IS NOT NULL OR token = ''")
        met = met.select("row", "id", "url", "best")
    else:
        # only tokens that have rules are dealt out, a row per rule, so neither a rule's nor a token's rows must be together
        index = written(index)
        each = urls.select("id", "url", "row", F.explode(tokens).alias("token"))
        fetched = each.join(index, "token").where(F.rlike(F.col("url"), F.col("rule.pattern"))).select("row", "id", "url", F.col("rule").alias("best"))
        alone = urls.join(F.broadcast(bare), F.lit(True)).select("row", "id", "url", best_of("bare").alias("best"))  # a single row
        met = fetched.unionByName(alone)
    per = met.groupBy("row", "id", "url").agg(F.max("best").alias("best"))
    best = F.col("best")
    return per.select(
        F.col("id").alias(id_col), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        F.when(best["by_host"], best["name"]).alias("rule"), F.when(~best["by_host"], best["name"]).alias("pattern"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )
