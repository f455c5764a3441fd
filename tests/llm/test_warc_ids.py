"""Revisits where a page_id has several payloads, against the query's SQL."""

import gzip
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, warc
from tidemark.llm.queries import ORACLE_SQL, QUERIES


#: Bytes of the longest page.
BIG = 200_000_000


def against_sql(spark, tmp_path, rows, parts=1, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(more)
    pages.repartition(parts).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op2_warc_revisits"])
    names = [x[0] for x in want.description]
    got = QUERIES["op2_warc_revisits"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))
    return got


@pytest.mark.parametrize("hot", [100_000, 20])
def test_hot_and_mixed_repeats(spark, tmp_path, monkeypatch, hot):
    """A payload that a third of all pages have, many that some share, small ones, null and empty ones, in several archives."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 40)
    monkeypatch.setattr(warc, "MEMBER", 700)
    r = random.Random(5)
    kinds = [lambda: "<p>" + "hot " * 60, lambda: "<p>" + f"shared {r.randrange(12)} " * 20, lambda: "s" * r.choice((1, 99, 100, 101)), lambda: r.choice((None, "")), lambda: f"own {r.random()} é\r\n\r\n" * 40]
    rows = [(i, r.choice(("http://u", "", None, "http://a")), r.choice([kinds[0], *kinds])()) for i in r.sample(range(10_000), 600)]
    clash = {c: F.lit(7) for c in ("record_id", "payload", "path", "place", "payload_digest", "rank", "n")}
    got = against_sql(spark, tmp_path, rows, 5, **clash)
    assert sum(x.record_type == "revisit" for x in got) > 250


def test_payloads_beyond_a_gzip_member(spark, tmp_path):
    big = "".join(random.Random(1).choices("abcdefgh ", k=18_000_000))
    got = against_sql(spark, tmp_path, [(1, "u", big), (2, "u", "x" * 200), (3, "u", big)], 2)
    assert {x.page_id: (x.payload_bytes, x.refers_to) for x in got} == {1: (18_000_000, None), 2: (200, None), 3: (18_000_000, 1)}


def test_archives_are_plain_gzip(spark, tmp_path):
    """Any reader that knows gzip finds the records, each in a member of its own."""
    path = str(tmp_path / "out")
    warc.write_archives(warc.page_records(spark.createDataFrame([(k, "u", f"page {k} " * 30) for k in range(10)], "page_id long, url string, html string").coalesce(1)), path)
    (file,) = (tmp_path / "out").glob("part-*")
    whole = gzip.decompress(file.read_bytes())
    assert whole.count(b"WARC/1.1\r\n") == 10 == file.read_bytes().count(b"\x1f\x8b\x08") and whole.endswith(b"\r\n\r\n")
    assert [zlib.decompressobj(31).decompress(file.read_bytes())[:8]] == [b"WARC/1.1"]


def test_one_id_with_two_payloads(spark, tmp_path):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, "u", a), (2, "u", a), (2, "v", b), (3, "u", c), (4, "u", a), (4, "u", c), (None, "u", a), (None, "w", b)]
    against_sql(spark, tmp_path, rows)


def test_files_end_between_records(spark, tmp_path, monkeypatch):
    """Records of many members each, in files of two: none is cut, and the limit counts records."""
    monkeypatch.setattr(warc, "MEMBER", 100)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 2)
    rows = [(i, "u", f"long page {i % 7} " * 200) for i in range(15)]
    against_sql(spark, tmp_path, rows)
    path = str(tmp_path / "out")
    warc.write_archives(warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), path)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == 8 and all(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") <= 2 for f in files)


def test_pages_of_17_and_200_mb(spark, tmp_path):
    """Nine pages of 17.5 MB and one of 200 MB, over several files, some of them repeats."""
    con = duckdb.connect()
    for part, ids in enumerate(("0, 1, 2, 3, 4", "5, 6, 7, 8", "9")):
        con.sql(f"CREATE OR REPLACE TABLE x AS SELECT page_id, 'u' AS url, CASE WHEN page_id = 9 THEN repeat('0123456789abcdef', {BIG // 16}) ELSE repeat('page ' || page_id % 4 || ' 0123456789', 1030000) END AS html FROM (SELECT unnest([{ids}])::BIGINT AS page_id)")
        (tmp_path / "pages.parquet").mkdir(exist_ok=True)
        con.sql(f"COPY x TO '{tmp_path}/pages.parquet/{part}.parquet' (ROW_GROUP_SIZE 1)")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op2_warc_revisits"])
    names = [x[0] for x in want.description]
    got = QUERIES["op2_warc_revisits"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall())) and max(r.payload_bytes for r in got) == BIG


def test_a_cut_archive_is_an_error(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER", 150)
    record = lambda i: warc._record(warc.DATE, str(i), "response", "u", 400, warc.hashlib.sha256(b"x" * 400).hexdigest(), None, b"x" * 400) + b"\0"
    one, whole = record(1), record(1) + record(2)
    assert [r["record_id"] for r in warc._records(memoryview(whole))] == ["1", "2"]
    for at in range(1, len(whole)):
        if at != len(one):
            with pytest.raises(ValueError):
                list(warc._records(memoryview(whole[:at])))
