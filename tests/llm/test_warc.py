import hashlib

import pytest

from wardflow.llm import warc as R

ROWS = [(5, "http://a/\r\nX: y", "p" * 200), (3, "http://b", "p" * 200), (9, None, "p" * 200), (1, "http://c", None), (2, "http://d", ""), (4, "http://e", "short"), (6, "http://e", "short"), (7, "http://f", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n" * 50), (8, "é", "ü" * 60), (3, "http://b", "p" * 200)]


def test_round_trip(spark):
    at = spark.conf.get("spark.checkpoint.dir") + "/warc-in/pages.parquet"
    spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).write.mode("overwrite").parquet(at)
    got = sorted(tuple(r) for r in R.op6_warc(spark, at.rpartition("/")[0]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        again = h == "p" * 200 and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want)


def test_push_down_and_pruning(spark, tmp_path):
    R.register(spark)
    at = f"file://{tmp_path}/w"
    R.records(spark.createDataFrame(ROWS, "page_id long, url string, html string")).write.format("warc").option("roll", 300).mode("append").save(at)
    df = spark.read.format("warc").schema("record_id string, record_type string").load(at).where("record_type = 'revisit' and record_id in ('<urn:page:5>', '<urn:page:3>')")
    assert [r["record_id"] for r in df.collect()] == ["<urn:page:5>"]
    reader = R.WarcReader(at, ["record_id"], 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("refers_to",)), GreaterThan(("payload_bytes",), 3)]))
    assert [type(x) for x in left] == [GreaterThan]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in rows) == ["<urn:page:5>", "<urn:page:9>"]
    # A skipped block is not decoded: one that can't be decoded does no harm.
    bad = next(p for p in (tmp_path / "w").iterdir() if b"WARC-Type: response" in p.read_bytes() and p.suffix == ".warc")
    raw = bad.read_bytes()
    body = raw.index(b"\x1f\x8b")
    bad.write_bytes(raw[:body] + b"\x00\x00" + raw[body + 2 :])
    assert spark.read.format("warc").schema("record_id string").load(at).count() == len(ROWS)
    with pytest.raises(Exception):
        spark.read.format("warc").schema("payload binary").load(at).collect()


def test_uncommitted_files_are_not_read(spark, tmp_path):
    R.register(spark)
    at = f"file://{tmp_path}/w"
    R.records(spark.createDataFrame(ROWS[:2], "page_id long, url string, html string")).write.format("warc").mode("append").save(at)
    (tmp_path / "w/lost.warc").write_bytes(R.record({"record_type": "response", "record_id": "<urn:page:99>", "payload": b"x"}))
    assert spark.read.format("warc").load(at).count() == 2


def test_foreign_files_and_empty_tables(spark, tmp_path):
    import gzip

    R.register(spark)
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 24\r\n\r\nHTTP/1.0 200 OK\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw))
    got = spark.read.format("warc").load(f"file://{tmp_path}").where("record_type = 'response'").collect()
    assert [bytes(r["payload"]) for r in got] == [b"hello"] * 2
    empty = f"file://{tmp_path}/none"
    R.records(spark.createDataFrame([], "page_id long, url string, html string")).write.format("warc").mode("append").save(empty)
    assert spark.read.format("warc").load(empty).collect() == []


def test_a_very_long_payload_and_other_columns(spark, tmp_path):
    R.register(spark)
    long = "é<b>x</b>" * 400_000
    pages = spark.createDataFrame([(1, "http://a", long, "other", 3), (2, "http://b", long, "other", 4), (3, None, None, None, None)], "page_id long, url string, html string, record_type string, payload int")
    at = f"file://{tmp_path}/long"
    R.records(pages).write.format("warc").mode("append").save(at)
    got = {r["record_id"]: r for r in spark.read.format("warc").load(at).collect()}
    assert bytes(got["<urn:page:1>"]["payload"]).decode() == long and got["<urn:page:2>"]["record_type"] == "revisit"
    assert got["<urn:page:3>"]["payload_bytes"] == 0 and got["<urn:page:1>"]["payload_bytes"] == len(long.encode())


def test_an_archive_that_is_cut_off(spark, tmp_path):
    """Records before the cut are read where they are asked for by header; the cut one is an error."""
    R.register(spark)
    at = f"file://{tmp_path}/c"
    R.records(spark.createDataFrame(ROWS, "page_id long, url string, html string")).coalesce(1).write.format("warc").mode("append").save(at)
    path = next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".warc")
    whole = spark.read.format("warc").load(str(path)).count()
    raw = path.read_bytes()
    path.write_bytes(raw[: raw.rindex(b"WARC/1.1") + 20])
    with pytest.raises(Exception, match="content-length"):
        spark.read.format("warc").load(str(path)).count()
    path.write_bytes(raw[: raw.rindex(b"WARC/1.1")])
    assert spark.read.format("warc").load(str(path)).count() == whole - 1
