"""The store of signed entries: commits, aborted jobs, altered entries, bounds."""

import json
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleanline.sources import store

ROWS = [("run", "a1", "2026-01-01 00:00:00", "{}"), ("run", "a2", "2026-02-01 10:00:00.000001", "é\n\"x\""), ("cache", "a1", "1969-12-31 23:59:59", None), ("run", "", "2026-03-01 00:00:00", "")]


def entries(spark, rows=ROWS):
    return spark.createDataFrame(rows, "kind string, key string, at string, data string").withColumn("created_at", F.col("at").cast("timestamp"))


def plain(frame):
    return sorted(((r.kind, r.key, str(r.at), r.data) for r in frame.withColumn("at", F.col("created_at").cast("string")).collect()), key=repr)


def test_round_trip_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert store.read(spark, path, "k").collect() == []
    store.write(entries(spark).repartition(3), path, "k")
    assert plain(store.read(spark, path, "k")) == sorted(ROWS, key=repr)
    store.write(entries(spark, ROWS[:1]), path, "k")
    assert store.read(spark, path, "k").count() == 5
    store.write(entries(spark, ROWS[:2]), path, "k", "overwrite")
    assert plain(store.read(spark, path, "k")) == sorted(ROWS[:2], key=repr)
    store.write(entries(spark).limit(0), path, "k", "overwrite")
    assert store.read(spark, path, "k").collect() == []


def test_another_secret_and_altered_entries_are_refused(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.write(entries(spark).coalesce(1), path, "k")
    assert store.read(spark, path, "other").collect() == []
    (file,) = Path(path).glob("data/*/*.parquet")
    table = pq.read_table(file)
    data = [("forged" if key == "a2" else x) for key, x in zip(table["key"].to_pylist(), table["data"].to_pylist())]
    pq.write_table(table.set_column(table.schema.get_field_index("data"), "data", pa.array(data, pa.string())), file)
    assert plain(store.read(spark, path, "k")) == sorted((r for r in ROWS if r[1] != "a2"), key=repr)
    assert [(r.key, r.data) for r in store.read(spark, path, "k", refused="true").collect()] == [("a2", "forged")]
    file.write_bytes(file.read_bytes()[: file.stat().st_size // 2])
    assert store.read(spark, path, "k").collect() == []
    (listed,) = Path(path).glob("commits/*.json")
    outer = json.loads(listed.read_text())
    listed.write_text(json.dumps(outer | {"body": outer["body"].replace("run", "ran")}))
    assert store.commits(path, b"k") == {}


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.write(entries(spark, ROWS[:1]), path, "k")
    bad = entries(spark, [("run", f"r{i}", "2026-01-01 00:00:00", "x") for i in range(50)] + [("run", None, "2026-01-01 00:00:00", "x")]).repartition(4, "key")
    with pytest.raises(Exception, match="without kind, key or created_at"):
        store.write(bad, path, "k")
    assert plain(store.read(spark, path, "k")) == [ROWS[0]]
    assert len(list(Path(path).glob("data/*/*.parquet"))) == 1 and len(list(Path(path).glob("commits/*"))) == 1


def test_files_of_a_task_that_ran_twice_are_removed(tmp_path):
    writer = store.SignedWriter({"path": str(tmp_path), "secret": "k"}, False)
    batch = pa.RecordBatch.from_pylist([{"kind": "run", "key": "a", "created_at": datetime(2026, 1, 1, tzinfo=timezone.utc), "data": "x"}])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert store.commits(str(tmp_path), b"k") == {}  # written, and not seen yet
    writer.commit([kept, writer.write(iter([]))])
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.glob("data/*/*")] == [kept.file["name"]] != [lost.file["name"]]


def test_bounds_narrow_the_files_and_keep_all_that_fits(spark, tmp_path):
    path = f"{tmp_path}/s"
    for day in range(1, 6):
        store.write(entries(spark, [("run", f"r{day}-{i}", f"2026-01-0{day} 00:00:00", str(i)) for i in range(4)]).coalesce(1), path, "k")
    cases = [
        ({}, lambda r: True, 5), ({"key": "r2-1"}, lambda r: r[1] == "r2-1", 1), ({"prefix": "r3"}, lambda r: r[1].startswith("r3"), 1), ({"prefix": ""}, lambda r: True, 5), ({"kind": "cache"}, lambda r: False, 0),
        ({"since": "2026-01-04"}, lambda r: r[2] >= "2026-01-04", 2), ({"until": "2026-01-02 00:00:00"}, lambda r: r[2] < "2026-01-02", 1), ({"since": "2026-01-02T02:00:00+02:00", "until": "2026-01-04"}, lambda r: "2026-01-02" <= r[2] < "2026-01-04", 2),
        ({"kind": "run", "prefix": "r5", "since": "2026-01-05"}, lambda r: r[1].startswith("r5"), 1),
    ]
    every = plain(store.read(spark, path, "k"))
    for options, fits, files in cases:
        assert plain(store.read(spark, path, "k", **options)) == [r for r in every if fits(r)], options
        assert sum(len(p.paths) for p in store.SignedReader({"path": path, "secret": "k"} | options).partitions()) == files, options


def test_one_frame_with_two_filters_loses_nothing(spark, tmp_path):
    store.write(entries(spark), f"{tmp_path}/s", "k")
    frame = store.read(spark, f"{tmp_path}/s", "k")
    assert frame.filter("key = 'a1'").count() == 2 and frame.count() == 4
    assert frame.filter("key = 'a1'").union(frame.filter("key = 'a2'")).count() == 3


def test_answers_are_made_once(spark, tmp_path):
    path, asked = f"{tmp_path}/s", []

    def make(rows):
        found = rows.collect()
        asked.append(sorted(r.key for r in found))
        return rows.select("key", F.concat(F.lit("made "), "key").alias("data"))

    wanted = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    store.write(entries(spark, [("cache", "a", "2026-01-01 00:00:00", "kept"), ("other", "b", "2026-01-01 00:00:00", "kept")]), path, "k")
    store.write(entries(spark, [("cache", "b", "2026-01-01 00:00:00", "foreign")]), path, "stranger")
    first = store.answered(wanted("a", "b", "b", None), path, "k", "cache", make)
    assert {(r.key, r.data) for r in first.collect()} == {("a", "kept"), ("b", "made b")} and first.count() == 2
    second = store.answered(wanted("b", "c"), path, "k", "cache", make)
    assert sorted((r.key, r.data) for r in second.collect()) == [("b", "made b"), ("c", "made c")] and asked == [["b"], ["c"]]
