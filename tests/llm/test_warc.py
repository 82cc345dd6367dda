import hashlib
import os

import pytest
from edge_tables import empty
from pyspark.sql import functions as F

from seqcast.llm.warc import MAGIC, BrokenArchive, reachable, read_archive, write_archive

FAKE = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit(1) for c in ("file", "split", "value", "bytes", "key", "keeper", "at", "next", "n")})


def round_trip(spark, df, path, **options):
    write_archive(df, str(path), **options)
    return read_archive(spark, str(path))


def expected(rows, least=1000):
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = best.get(data)
        again = keeper is not None and i is not None and i != keeper
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [(1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u\r\nWARC-Type: revisit", None),
        (6, "", ""), (7, "é", "日本\U0001F600" * 400), (9, "é", "日本\U0001F600" * 400), (9, "é", "日本\U0001F600" * 400), (None, "n", "x" * 1000),
        (None, None, None), (10, "big", "long text \r\n\r\n" * 200_000)]


def test_round_trip(spark, tmp_path):
    out = round_trip(spark, pages(spark, ROWS).repartition(3), tmp_path / "w")
    assert got(out) == expected(ROWS) and out.filter("not intact").isEmpty()
    urls = {r.page_id: r.url for r in out.collect() if r.page_id}
    assert urls[1] == "http://a" and urls[3] is None and urls[5] == "u%0D%0AWARC-Type: revisit"


@pytest.mark.parametrize("split", ["300", "4k", "128m"])
def test_magic_and_whole_records_within_payloads(spark, tmp_path, split):
    """Split at every place; payloads that end, begin with or consist of magics, and hold records that look true."""
    inner = [MAGIC, FAKE, FAKE * 3, f"a{MAGIC}", f"{MAGIC}b", f"W{MAGIC}{MAGIC}", "WARC/1.0\r", "y" * 500 + FAKE, FAKE + "z" * 700,
             f"{MAGIC}WARC-Type: response\r\nContent-Length: 999999\r\n\r\n", f"{MAGIC}WARC-Type: response\r\nContent-Length: x\r\n\r\n", "plain" * 100]
    rows = [(i, f"u{i}", text) for i, text in enumerate(inner * 3)]
    write_archive(pages(spark, rows).coalesce(2), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert got(read_archive(spark, str(tmp_path / "w"))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_that_breaks_off_gives_what_is_whole(spark, tmp_path):
    write_archive(pages(spark, [(i, "u", f"text {i}" * 50) for i in range(20)]).coalesce(1), str(tmp_path / "w"))
    name = next(f for f in os.listdir(tmp_path / "w") if f.startswith("part"))
    data = (tmp_path / "w" / name).read_bytes()
    (tmp_path / "cut.warc").write_bytes(data[: len(data) * 2 // 3])
    found = {r.page_id for r in read_archive(spark, str(tmp_path / "cut.warc"), lenient=True).filter("intact").collect()}
    assert found == set(range(len(found))) and 10 <= len(found) <= 14
    (tmp_path / "none.warc").write_text("no archive at all")
    assert read_archive(spark, str(tmp_path / "none.warc"), lenient=True).count() == 0
    for broken in ("cut", "none"):
        with pytest.raises(BrokenArchive, match="1 files"):
            read_archive(spark, str(tmp_path / f"{broken}.warc"))


def record(page, payload, version="1.0", more=""):
    body = f"HTTP/1.1 200 OK\r\n\r\n{payload}"
    return (f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\n{more}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n")


@pytest.mark.parametrize("split", ["200", "128m"])
def test_folded_lines_versions_and_white_space_at_the_end(spark, tmp_path, split):
    folded = "X-Note: one\r\n two\r\n\tthree\r\nWARC-Target-URI: http://a\r\n  /b\r\n"
    text = (record(1, "a") + record(2, "b", "1.1", folded) + record(3, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n", "1.1")
            + record(4, "WARC/1.2 and WARC/1.") + record(5, "last", "1.1"))
    (tmp_path / "a.warc").write_text(text + "\r\n \n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = {r.page_id: r for r in read_archive(spark, str(tmp_path / "a.warc")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(rows) == {1, 2, 3, 4, 5} and rows[2].url == "http://a /b" and rows[5].payload_bytes == 4
    (tmp_path / "b.warc").write_text(record(1, "a") + record(2, "b", more=" no header before\r\n").replace("WARC-Type: response\r\nWARC-Record-ID: <urn:page:2>", "broken") + record(3, "c"), newline="")
    with pytest.raises(BrokenArchive):
        read_archive(spark, str(tmp_path / "b.warc"))
    assert {r.page_id for r in read_archive(spark, str(tmp_path / "b.warc"), lenient=True).collect()} == {1}


def test_reachable_by_jumps(spark):
    nodes = [("f", i, i + 1) for i in range(100)] + [("f", 200, 201), ("f", 201, 202), ("g", 5, 6), ("h", 0, 7), ("h", 7, 3), ("h", 3, 9)]
    rows = reachable(spark.createDataFrame(nodes, "file string, at long, next long")).collect()
    # A pointer that goes back ends its chain.
    assert {(r.file, r["at"]) for r in rows} == {("f", i) for i in range(100)} | {("h", 0), ("h", 7)}


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, empty(pages(spark, ROWS)), tmp_path / "w").count() == 0


def test_least_bytes(spark, tmp_path):
    assert got(round_trip(spark, pages(spark, ROWS), tmp_path / "w", least_bytes=1)) == expected(ROWS, 1)
