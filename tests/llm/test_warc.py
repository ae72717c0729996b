"""The WARC writer: round trips, shards of even size under any ids, rolling files, lost attempts."""

from __future__ import annotations

import hashlib
from collections import Counter

from gleanline.llm import op8_warc

SCHEMA = "page_id long, url string, html string, payload string"


def round_trip(spark, rows, tmp_path, **sizes):
    pages = spark.createDataFrame(rows, SCHEMA)
    folder = f"file://{tmp_path}/archive"
    manifest = op8_warc.write(pages, folder, **sizes)
    return op8_warc.read(spark, folder, manifest, payloads=True).collect(), spark.read.json(manifest).collect()


def expected(rows):
    """(page_id, payload_bytes, digest, type, refers_to) of rows with different ids."""
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        revisit = len(raw) >= op8_warc.MIN_REVISIT and page is not None and page != max(same)
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return Counter(out)


def test_round_trip_with_nulls_ties_and_long_payloads(spark, tmp_path):
    same, long = "é" * 600, "x" * 400_000
    rows = [(1, "u", same, "n"), (7, "v\r\nw", same, "n"), (3, None, same, "n"), (4, "u", None, "n"), (5, "u", "", "n"), (None, "u", same, "n"), (8, "u", "short", "n"), (9, "u", "short", "n"), (10, "u", long, "n")]
    got, _ = round_trip(spark, rows, tmp_path)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    assert {r.url for r in got if r.page_id == 7} == {"v%0D%0Aw"}
    assert {len(r.payload) for r in got if r.page_id == 10} == {400_000}


def test_repeated_rows_are_one_response_and_revisits_with_ids_of_their_own(spark, tmp_path):
    rows = [(1, "u", "z" * 2000, "n")] * 3 + [(None, "u", "z" * 2000, "n")] * 2
    got, _ = round_trip(spark, rows, tmp_path)
    assert Counter((r.page_id, r.record_type) for r in got) == {(1, "response"): 1, (1, "revisit"): 2, (None, "response"): 2}
    ids = [
        headers["warc-record-id"]
        for file in (tmp_path / "archive").glob("*.gz")
        for headers, _ in map(op8_warc.parse, op8_warc.members(file.open("rb")))
    ]
    assert len(ids) == len(set(ids)) == 5


def test_files_roll_by_compressed_size(spark, tmp_path):
    rows = [(k, "u", hashlib.sha512(str(k).encode()).hexdigest() * 20, "n") for k in range(300)]
    got, files = round_trip(spark, rows, tmp_path, file_bytes=5_000)
    assert len(got) == 300 and sum(f.records for f in files) == 300
    assert len(files) > 5 and max(f.bytes for f in files) < 5_000 + 3_000
    names = [f.file for f in files]
    assert len(names) == len(set(names)) and all((tmp_path / "archive" / n).exists() for n in names)


def test_an_outlying_id_does_not_fill_one_shard(spark):
    rows = [(k, "u", "a" * 500, "n") for k in range(2000)] + [(2**40, "u", "b", "n"), (-(2**45), "u", "c", "n"), (None, "u", "d", "n")]
    pages = spark.createDataFrame(rows, SCHEMA)
    sizes = Counter(r.shard for r in op8_warc.planned(pages, 50_000).collect())
    assert len(sizes) >= 35 and max(sizes.values()) <= 2 * 2003 / len(sizes)


def test_each_shard_has_a_partition_of_its_own(spark):
    from pyspark.sql import functions as F

    rows = [(k, "u", "a" * 500, "n") for k in range(400)]
    planned = op8_warc.planned(spark.createDataFrame(rows, SCHEMA), 20_000).withColumn("p", F.spark_partition_id())
    assert planned.select("p", "shard").distinct().groupBy("p").count().filter("count > 1").isEmpty()


def test_the_same_pages_give_the_same_bytes_in_any_order(spark, tmp_path):
    rows = [(k * k, "u", f"page {k % 7} " * 300, "n") for k in range(60)]
    _, first = round_trip(spark, rows, tmp_path / "a", shard_bytes=20_000)
    _, again = round_trip(spark, rows[::-1], tmp_path / "b", shard_bytes=20_000)
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_what_a_lost_attempt_left_goes_and_is_not_read(spark, tmp_path):
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive" / ".shard-000000-00000.warc.gz.dead.tmp").write_bytes(b"half a record")
    rows = [(1, "u", "text", "n")]
    got, _ = round_trip(spark, rows, tmp_path)
    assert len(got) == 1 and not list((tmp_path / "archive").glob(".*.tmp"))


def test_empty_table(spark, tmp_path):
    got, files = round_trip(spark, [], tmp_path)
    assert got == [] and files == []
