"""WARC archives: writing captures, reading records, and assembling transactions.

`write_warc` turns each page into a request, a response (or revisit) and a metadata record, made of
built-in functions, and writes them with Spark's text sink: the separator of WARC records, two line
ends, is the sink's line separator. Files hold `records_per_file` records at most, and pages of more than
`LARGE` bytes go to files of their own with as few records as keep them under `FILE_BYTES` (or one page
alone). They are gzipped as a whole, not by record.

Of pages with equal payloads (SHA-1 and length) of at least `min_bytes` bytes, the one with the least
page id is written as response and the others as revisit records that name it and hold no payload.

Which page a revisit names is worked out from ids and digests alone, payloads of more than a hundredth of all pages
(fewer than a hundred) by broadcast, and joined back by the page's own id. So bodies are dealt out by page, and the
pages of one payload are many tasks' work.

`read_warc` parses archives, with gzip of either kind, record by record inside tasks; a file is one
task's work, as gzip can't be split, and archives of other writers must be under Spark's 2 GB for a binary value.

`transactions` joins request and metadata records to the response, revisit or resource record through
WARC-Concurrent-To, in either direction and over one record between, and returns one nested row per
capture. Other records (warcinfo, conversion, ...) belong to no capture.

Defined results: a null payload is empty; null ids are always responses, without an id in the
metadata; a null URL leaves its field out, and line ends in one are escaped. Pages that share id and
payload share the record id, and each is still a capture of its own; captures without request or
metadata have empty arrays. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import discard, written

RECORDS_PER_FILE = 6000
#: Bytes of payload beyond which a page is large, and bytes of payloads in a file; 2,000 pages that aren't large are as many.
LARGE, FILE_BYTES = 1 << 16, 1 << 27
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32(hex_digest: Column) -> Column:
    """A digest of 40 hex digits in base 32: five hex digits are four of base 32."""
    five = lambda i: F.conv(F.substring(hex_digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    digit = lambda i: F.floor(five(i) / F.pow(F.lit(32.0), 3 - i % 4)).cast("int") % 32
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(BASE32), digit(i) + 1, F.lit(1))), "")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, url: Column, date: str, content_type: str, block: Column, **fields: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url)]
    lines += [F.concat(F.lit(f"WARC-{name.replace('_', '-')}: "), value) for name, value in fields.items()]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)  # concat_ws leaves nulls out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    body = F.coalesce(F.col(payload_col), F.lit(""))
    # a digest is worked out twice instead of moving the payloads once more
    p = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("bytes"))
    most = p.agg(F.max("bytes")).first()[0] or 0
    same = p.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = written(same)
    often = F.col("n") > 0.01 * pages.count()
    hot = F.broadcast(same.where(often).drop("n"))  # fewer than a hundred rows
    ids = p.where(F.col("id").isNotNull()).select("id", "sha", "bytes")
    tags = ids.join(hot, ["sha", "bytes"]).unionByName(ids.join(hot, ["sha", "bytes"], "left_anti").join(same.where(~often).drop("n"), ["sha", "bytes"]))
    tags = written(tags.distinct())
    p = p.join(tags, ["id", "sha", "bytes"], "left").withColumn("digest", base32(F.col("sha")))
    revisit = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    response = _urn(F.lit("response"), F.col("id"), F.col("sha"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    target = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{END}Host: "), F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.lit(END + END))
    note = F.coalesce(F.concat(F.lit("page_id: "), F.col("id").cast("string"), F.lit(END)), F.lit(""))
    url = F.col("url")
    records = F.array(
        _record(F.lit("request"), _urn(F.lit("request"), F.col("id"), F.col("sha"), url), url, date, "application/http; msgtype=request", F.coalesce(get, F.lit("")), Concurrent_To=response),
        _record(
            kind, response, url, date, "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, "body")),
            Payload_Digest=F.concat(F.lit("sha1:"), "digest"),
            Profile=F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            Refers_To=F.when(revisit, _urn(F.lit("response"), F.col("first"), F.col("sha"))),
        ),
        _record(F.lit("metadata"), _urn(F.lit("metadata"), F.col("id"), F.col("sha"), url), url, date, "application/warc-fields", note, Concurrent_To=response),
    )
    sizes = [(F.col("bytes") <= LARGE, records_per_file)]
    if most > LARGE:
        sizes.append((F.col("bytes") > LARGE, min(records_per_file, max(3, 3 * (FILE_BYTES // most)))))
    for which, in_file in sizes:
        out = p.where(which).select(F.explode(records).alias("value"))
        out.write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", in_file).text(path)
    discard(same)
    discard(tags)


def _fields(data: bytes) -> list[tuple[str, str]]:
    """Lines `name: value`; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def records(stream: io.BufferedIOBase, path: str) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The fields and the block of each record of an archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no WARC record where one should begin: {line[:60]!r}")
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line.rstrip(b"\r\n"))
        fields = _fields(b"\r\n".join(head))
        size = int(dict(fields)["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{path}: ends within a record")
        yield fields, block


RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, status int, "
    "payload_bytes long, payload_digest string, stated_digest string, fields map<string,string>, payload binary"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives below path. payload_digest is that of the payload itself, where there is one."""

    def parse(fields: list[tuple[str, str]], block: bytes) -> dict:
        one = dict(reversed(fields))
        kind, http, payload, status = one.get("warc-type", ""), {}, block, None
        if one.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            first, _, rest = head.partition(b"\r\n")
            http = dict(_fields(rest))
            code = first.split(b" ")[1:2]
            status = int(code[0]) if kind != "request" and code and code[0].isdigit() else None
        whole = kind != "revisit"
        stated = one.get("warc-payload-digest", "").partition(":")[2] or None
        return {
            "record_id": one.get("warc-record-id"), "type": kind, "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"),
            "target_uri": one.get("warc-target-uri"), "date": one.get("warc-date"), "status": status,
            "payload_bytes": len(payload) if whole else int(http["content-length"]) if http.get("content-length", "").isdigit() else None,
            "payload_digest": b32encode(hashlib.sha1(payload).digest()).decode() if whole else stated, "stated_digest": stated,
            "fields": dict(_fields(block)) if one.get("content-type", "").startswith("application/warc-fields") else {},
            "payload": payload if payloads and whole else None,
        }

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = io.BytesIO(content)
                stream = gzip.open(raw) if content[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for fields, block in records(stream, name):
                    rows.append(parse(fields, block))
                    size += len(block)
                    if size > 1 << 23 or len(rows) >= 5000:
                        yield frame(rows)
                        rows, size = [], 0
                yield frame(rows)

    columns = [c.strip().split(" ")[0] for c in RECORD.replace("map<string,string>", "map").split(",")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        for c in ("status", "payload_bytes"):
            out[c] = out[c].astype("Int64" if c == "payload_bytes" else "Int32")
        return out

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(read, RECORD)


CAPTURES = ("response", "revisit", "resource")


def transactions(recs: DataFrame) -> DataFrame:
    """One row per capture: the capture's own fields, and requests and metadata as arrays of structs."""
    own = recs.where(F.col("type").isin(*CAPTURES))
    side = recs.where(F.col("type").isin("request", "metadata"))
    stated = recs.select("record_id", F.explode("concurrent_to").alias("to"))
    links = stated.unionByName(stated.select(F.col("to").alias("record_id"), F.col("record_id").alias("to"))).distinct()
    ids = own.select(F.col("record_id").alias("to")).distinct()
    direct = links.join(ids, "to").select("record_id", F.col("to").alias("capture"))
    # the rest goes over one record between
    over = links.join(direct.select(F.col("record_id").alias("to"), "capture"), "to").join(direct.select("record_id"), "record_id", "left_anti").select("record_id", "capture")
    belongs = direct.unionByName(over).distinct()
    part = F.struct("record_id", "target_uri", "date", "payload_bytes", "payload_digest", "fields")
    sides = side.select("record_id", "type", part.alias("part")).join(belongs, "record_id").groupBy("capture").agg(
        F.collect_list(F.when(F.col("type") == "request", F.col("part"))).alias("requests"), F.collect_list(F.when(F.col("type") == "metadata", F.col("part"))).alias("metadata")
    )
    none = F.array().cast(sides.schema["requests"].dataType)
    out = own.join(sides, own["record_id"] == sides["capture"], "left")
    return out.select(*own.columns, *(F.coalesce(c, none).alias(c) for c in ("requests", "metadata")))
