"""How archives are dealt to tasks and files: one payload in a third of all pages, large pages, no pages."""

import gzip
import re
from collections import Counter

from pyspark.sql import functions as F

from weirflow.llm import queries, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def files(path):
    return [p for p in path.rglob("*") if p.name.startswith("part-")]


def records(p):
    return len(re.findall(rb"^WARC/1.1", gzip.decompress(p.read_bytes()), re.MULTILINE))


def test_pages_of_one_payload_are_many_tasks_work(spark, tmp_path):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    n = 12_000
    body = F.when(F.col("id") % 3 == 0, F.lit("the same " * 30)).otherwise(F.concat(F.repeat(F.md5(F.col("id").cast("string")), 8)))
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), body.alias("html"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        warc.write_warc(df, str(tmp_path / "w"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    per = Counter()
    for p in files(tmp_path / "w"):
        per[p.name.split("-")[1]] += records(p)
    assert sum(per.values()) == 3 * n
    # a third of all, 12,000 records, would be one task's if they weren't split
    assert max(per.values()) <= 4_000
    seen = warc.read_warc(spark, str(tmp_path / "w"), payloads=False).where("type IN ('response', 'revisit')").groupBy("type").count().collect()
    assert {r.type: r["count"] for r in seen} == {"response": n - n // 3 + 1, "revisit": n // 3 - 1}


def test_large_pages_go_to_files_of_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://a/{i}", ("é" if i % 4 == 1 else "x") * (i * 37 % 900)) for i in range(60)] + [(100 + i, "http://b/", f"{i}" * 6000) for i in range(9)] + [(200, "http://c/", "y" * 50_000)]
    df = pages(spark, rows).coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"), records_per_file=30)
    for p in files(tmp_path / "w"):
        assert records(p) <= 30
        large = [int(x) for x in re.findall(rb"WARC-Type: response.*?\r\n\r\nHTTP/1.1 200 OK\r\n[^\r]*\r\nContent-Length: (\d+)", gzip.decompress(p.read_bytes()), re.DOTALL) if int(x) > 1000]
        assert len(large) <= 1 or sum(large) <= 20_000
    got = warc.transactions(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    assert sorted(bytes(r.payload).decode() for r in got if r.type == "response") == sorted({html for _, _, html in rows})
    assert len(got) == len(rows)


def test_no_pages(spark, tmp_path):
    pages(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.QUERIES["op4_warc"](spark, str(tmp_path)).collect() == []


def test_a_page_of_megabytes(spark, tmp_path):
    rows = [(1, "http://a/", "é\r\n\r\n" * 2_000_000), (2, "http://b/", "é\r\n\r\n" * 2_000_000), (3, None, "x")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.QUERIES["op4_warc"](spark, str(tmp_path)).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 12_000_000 and got[2].refers_to == 1 and got[3].record_type == "response"
