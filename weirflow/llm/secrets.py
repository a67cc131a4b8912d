"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a private key's block, or a run of at least 16 characters of those that keys are made of, with a digit
in it. A sign of equality ends a run, so a name and the value assigned to it are two; only base64 padding belongs to one.
Secrets of fewer characters, and those without a digit, are no candidates and are not found.
Splitting a text at its candidates gives what stands before and after each, hence places and
neighbours. Each candidate becomes a row of numbers: its length, the shares of kinds of characters,
changes between letters and digits, frequent letter pairs, the part covered by dictionary words,
marks of a path or address, and words of either kind next to it.

The forest is trained from labelled findings: a table with the columns before, candidate, after and
label. Two sources of them are put together. `found_in` takes candidates from about `n_docs` documents (its
documented bound), chosen by the hash of their id and never from the held-out part, and labels them by
`TRUE_BEFORE` and `TRUE_SHAPE`: a digest that is assigned to a token is a secret, all else (card numbers,
mail hosts, hashes of commits) is not. `labelled_findings` makes about `n` (its bound) out of hashes and
templates of kinds that documents may lack, cut out of whole sentences by the same pattern as texts are. Pass
another table to train on your own. Training, scoring and features are built-in functions and Spark ML,
with no user functions.

One row per candidate and one per document leave the scan of the texts and are gathered by document, where
places are summed up in order. All steps are linear in the candidates of a text.

Defined results: null and empty texts have no candidates. Rows are judged one by one, so repeated rows
and null ids come out as often as they went in; empty tables give no rows; other columns are not read
(`redact` hands them on).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import fresh

_PAD = r"(?![A-Za-z0-9_+/=])"
_RUN = r"[A-Za-z0-9_+/.\-]"
#: A block of a private key in PEM form, armour included.
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=:,\s]*+(?:-[A-Za-z0-9+/=:,\s]++)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
CANDIDATE = rf"(?:{KEY_BLOCK}|(?<!{_RUN})(?=[A-Za-z_+/.\-]*[0-9])(?:{_RUN}{{13,}}[A-Za-z0-9_+/\-]=={_PAD}|{_RUN}{{14,}}[A-Za-z0-9_+/\-]={_PAD}|{_RUN}{{15,}}[A-Za-z0-9]))"
# What stands before a labelled secret, and what it is made of.
TRUE_BEFORE, TRUE_SHAPE = r"(?i)\btoken\s?[:=]\s?[\"']?$", r"^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"
#: Documents whose candidates are learned from.
TRAIN_DOCS = 20_000
#: Characters that are looked at on either side.
NEAR = 40
TRAIN_ROWS, TREES, DEPTH, SEED = 4000, 20, 8, 42
THRESHOLD = 0.5

# Words before a true finding, and before a false one.
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret)"
PLAIN_WORDS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|revision|uuid|guid|version|build|https?:|www|mailto|path|file|integrity|etag|fingerprint|serial|isbn|phone|order)"
# Frequent letter pairs of running text, and words that names and placeholders are made of.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
WORDS = (
    "about account address admin after article asset author backup beta bucket build cache campaign change class client code color com config content count css data date default demo deploy "
    "dev document domain download dummy element email en error event example fake feature file final first font form group header here home html http icon image img index info insert "
    "item json key label lang last latest left lib line link list local login mail main manager master max media menu message min mock model module name net news node note number object "
    "offset option order org page param parent password path photo placeholder png post preview product profile project public query record release report request resource response result "
    "right root sample script search secret section server service session setting sha side size source src stage start state static status step style sub system table tag target temp "
    "template test text thumb time title token top total type update upload url user util value version video view web width window work www xml your zip"
).split()

FEATURES = ("length", "digits", "uppers", "lowers", "marks", "distinct", "changes", "pairs", "covered", "path", "address", "known", "secret_before", "plain_before", "assigned", "quoted")


def features(before: Column, c: Column, after: Column) -> dict[str, Column]:
    n = F.length(c).cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    flag = lambda x: x.cast("double")
    near = F.right(before, F.lit(24))
    return {
        "length": n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "lowers": count("[a-z]") / n,
        "marks": count(r"[_+/=.\-]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "changes": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / n,
        "pairs": count(f"(?i)(?={'|'.join(PAIRS)})") / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(WORDS, key=len, reverse=True)), "")) / n,
        "path": count("/") + flag(before.rlike(r"[/\\:]$")),
        "address": flag(before.rlike("@$") | c.rlike(r"\.(com|org|net|html?|php|js|css|png|jpg)$") | c.startswith("www.")),
        "known": flag(c.rlike(r"^-----BEGIN|^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^[sr]k_(live|test)_|^AIza[0-9A-Za-z_\-]{30}|^eyJ[A-Za-z0-9]")),
        "secret_before": flag(near.rlike(SECRET_WORDS)),
        "plain_before": flag(near.rlike(PLAIN_WORDS)),
        "assigned": flag(before.rlike(r"[:=]>?\s{0,3}[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
    }


def labelled_findings(spark: SparkSession, n: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """About n labelled findings: before, candidate, after, label. Half are true; about one in eight stands beside misleading words.
    `candidates` cuts them out of whole sentences (a few true ones have no digit and are none)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 512)
    draw = lambda k, of: F.conv(F.substring("h", 100 + 4 * k, 4), 16, 10).cast("int") % of
    pick = lambda k, items: F.element_at(F.array(*map(F.lit, items)), draw(k, len(items)) + 1)
    mixed = F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", "7")
    hexes = F.col("h")
    number = F.translate(hexes, "abcdef", "904172")
    word = lambda k: pick(k, WORDS)
    cut = lambda x, lo, hi: x.substr(F.lit(1), lo + draw(3, hi - lo + 1))
    case = lambda x: F.when(draw(4, 4) == 0, F.upper(x)).otherwise(x)
    true = F.element_at(F.array(
        case(cut(hexes, 32, 64)), cut(mixed, 20, 48), F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(F.lit("eyJ"), F.substring(mixed, 1, 60)), case(F.substring(hexes, 1, 40)),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n"), F.substring(mixed, 7, 30), F.lit("=\n-----END RSA PRIVATE KEY-----")),
    ), draw(0, 8) + 1)
    secret = F.concat(pick(1, ["token", "api_key", "secret", "password", "access_key", "client_secret", "auth", "Bearer", "TOKEN", "apikey", "API_KEY", "AWS_SECRET_ACCESS_KEY", "AWS_ACCESS_KEY_ID", "DB_PASSWORD", "?access_token", "&client_secret"]), pick(2, [' = "', ': "', "=", ": ", " = '", '="', ": "]))
    bare = F.concat(word(1), pick(2, [" ", "\n", " | "]))
    plain = F.concat(pick(1, ["commit ", "sha256:", "md5 = ", "checksum: ", "revision ", "uuid=", "https://", "file ", "build ", "etag: \"", "integrity=", "digest: ", "?page=", "&ref=", "BUILD_ID="]))
    dashed = F.concat_ws("-", *(F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    name = F.concat(word(5), pick(6, ["_", "-", ".", "/"]), word(4), pick(6, ["_", "-", ".", "/"]), word(0), F.substring(number, 1, 3))
    false = F.element_at(F.array(
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 64), dashed, cut(number, 16, 20), name, F.concat(word(5), F.lit(".example"), F.substring(number, 1, 2), F.lit(".com")),
        F.concat(F.lit("your_"), word(5), F.lit("_key_here_"), F.substring(number, 1, 2)), F.concat(word(5), F.lit("/"), word(4), F.lit("/"), F.substring(number, 1, 6), F.lit(".html")),
        F.concat(F.lit("mail"), F.substring(number, 1, 1), F.lit(".example.com")), F.concat(F.repeat(F.lit("x"), 14 + draw(3, 20)), F.lit("1")),
    ), draw(0, 10) + 1)
    false = F.when(F.length(false) < 16, F.rpad(false, 16, "28")).otherwise(false)  # shorter ones are no candidates
    kind = draw(0, 10)
    false_before = F.when(kind <= 2, plain).when(kind == 8, F.concat(word(1), F.lit(".26@"))).when((kind == 6) | (kind == 9), secret).when(draw(2, 2) == 0, plain).otherwise(bare)
    label = F.col("id") % 2 == 0
    known = draw(0, 8).between(2, 5) | (draw(0, 8) == 7)
    true_before = F.when(known & ((draw(2, 3) == 0) | (draw(0, 8) == 7)), bare).otherwise(secret)
    before = F.when(label, true_before).otherwise(false_before)
    quote = F.regexp_extract(before, "([\"'])$", 1)
    df = spark.range(n).withColumn("h", h)
    lead = F.concat(word(2), F.lit(" "), word(3), F.lit(" "), before)
    made = df.select(lead.alias("lead"), F.when(label, true).otherwise(false).alias("own"), F.concat(quote, pick(7, [" ", ".", "\n", " and "])).alias("rest"), label.cast("int").alias("label"))
    place = F.struct("label", F.length("lead").alias("lo"), (F.length("lead") + F.length("own")).alias("hi"))
    found = candidates(made.select(place.alias("place"), F.concat("lead", "own", "rest").alias("text")), "place")
    return found.where("start < id.hi AND start + length(candidate) > id.lo").select("before", "candidate", "after", "id.label")


def held_out(doc_id: Column) -> Column:
    """Documents that `found_in` leaves for tests."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_docs: int = TRAIN_DOCS) -> DataFrame:
    """Labelled findings (before, candidate, after, label) of about n_docs documents, by the hash of their id."""
    part = int(min(1.0, n_docs / max(1, docs.count())) * (1 << 20))
    some = docs.where(~held_out(F.col(id_col)) & (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < part))
    found = candidates(some, id_col, text_col).where("candidate IS NOT NULL")
    label = F.col("before").rlike(TRUE_BEFORE) & F.col("candidate").rlike(TRUE_SHAPE)
    return found.select("before", "candidate", "after", label.cast("int").alias("label"))


def vectors(df: DataFrame) -> DataFrame:
    """df (before, candidate, after) with the column `features`; no candidate: all zero."""
    made = features(F.col("before"), F.col("candidate"), F.col("after"))
    df = df.withColumns({f"f_{k}": F.coalesce(made[k], F.lit(0.0)) for k in FEATURES})
    df = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(df)
    return df.drop(*(f"f_{k}" for k in FEATURES))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    rows = labelled.coalesce(1).sortWithinPartitions("before", "candidate", "after", "label")  # bounded; one order of rows, one forest
    rows = vectors(rows).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate, and one without for a document that has none: row, id, i (the candidate's number in its text), start
    (characters before it), candidate, before, after.
    What stands before goes back over one other candidate, which may be the name that this one is assigned to."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), t.alias("t"))
    df = df.select("row", "id", F.when(F.col("t").rlike(CANDIDATE), F.struct(*_cut(F.col("t")))).alias("x"))
    gap, found = F.col("x.gaps"), F.col("x.found")
    part = F.transform(found, lambda c, i: F.struct(
        c.alias("candidate"), F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gap, i)), F.lit(NEAR)).alias("before"), F.left(F.get(gap, i + 1), F.lit(NEAR)).alias("after"), (F.length(F.get(gap, i)) + F.length(c)).alias("step"),
    ))
    df = df.select("row", "id", F.posexplode_outer(part).alias("i", "p"))
    end = F.sum("p.step").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return df.select("row", "id", "i", (end - F.length("p.candidate")).alias("start"), F.col("p.candidate").alias("candidate"), F.col("p.before").alias("before"), F.col("p.after").alias("after"))


def _cut(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and what stands between them."""
    return F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found")


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """candidates() with score: the forest's probability of a true finding (null where there is no candidate)."""
    df = model.transform(vectors(candidates(docs, id_col, text_col)))
    score = F.when(F.col("candidate").isNotNull(), F.element_at(vector_to_array("probability"), 2))
    return df.select("row", "id", "i", "start", "candidate", score.alias("score"))


def secret_scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the id, n_candidates, score (the highest, 0 without candidates), findings (sorted: start, length, SHA-256 of the secret, score)."""
    finding = F.struct("start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("sha256"), "score")
    df = scan(docs, model, id_col, text_col)
    per = df.groupBy("row", "id").agg(
        F.count("candidate").alias("n_candidates"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, finding))).alias("findings")
    )
    return per.select(F.col("id").alias(id_col), "n_candidates", "score", "findings")


def redact(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in its texts replaced by `mark`; all rows and columns stay. Rows meet their findings by id and text."""
    key, bad_id, bad_key, flags = fresh(docs, "text_key"), fresh(docs, "bad_id"), fresh(docs, "bad_key"), fresh(docs, "bad_flags")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    text_id = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(key).alias("key")).alias("doc_key"), F.col(text_col).alias("body"))
    # of each candidate of a text, in order, whether it is a finding
    every = scan(text_id, model, "doc_key", "body").where("candidate IS NOT NULL").groupBy("row", "id").agg(
        F.max("score").alias("most"), F.array_sort(F.collect_list(F.struct("i", (F.col("score") >= threshold).alias("bad")))).alias("each")
    )
    bad = every.where(F.col("most") >= threshold).select(F.col("id.id").alias(bad_id), F.col("id.key").alias(bad_key), F.col("each.bad").alias(flags)).dropDuplicates([bad_id, bad_key])
    joined = keyed.join(bad, keyed[id_col].eqNullSafe(bad[bad_id]) & (keyed[key] == bad[bad_key]), "left")
    text = F.col(text_col)
    gaps, found = _cut(text)
    masked = F.transform(F.arrays_zip(found.alias("found"), F.col(flags).alias("bad")), lambda x: F.when(x["bad"], F.lit(mark)).otherwise(x["found"]))
    whole = F.array_join(F.zip_with(gaps, masked, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")
    return joined.withColumn(text_col, F.when(F.col(flags).isNotNull(), whole).otherwise(text)).select(docs.columns)
