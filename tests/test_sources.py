"""Readers, sinks and streams on small fixtures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gleanline.functions import redaction, versions
from gleanline.sources import code, diffs, reports, sinks
from gleanline.streaming import events

DIFF = """diff --git a/one.txt b/one.txt
index 1..2 100644
--- a/one.txt
+++ b/one.txt
@@ -1,3 +1,4 @@ head
 same
--- looks like a header
+++ looks like one too
+added
 last
@@ -10 +11 @@
-old
+new
\\ No newline at end of file
diff --git a/sub b/sub
index abc 160000
--- a/sub
+++ b/sub
@@ -1 +1 @@
-x
+y
diff --git "a/sp\\303\\251 ace" "b/sp\\303\\251 ace"
old mode 100644
new mode 100755
"""


def test_unified_diff(spark):
    rows = diffs.diff_rows(spark.createDataFrame([(1, DIFF), (2, None), (3, "no diff at all")], "diff_id long, text string"))
    lines = [(r.file_no, r.kind, r.old_line, r.new_line, r.content) for r in diffs.diff_lines(rows).collect()]
    assert set(x[1:] for x in lines if x[0] == 1) == {
        ("ctx", 1, 1, "same"), ("del", 2, None, "-- looks like a header"), ("add", None, 2, "++ looks like one too"), ("add", None, 3, "added"), ("ctx", 3, 4, "last"), ("del", 10, None, "old"), ("add", None, 11, "new"),
    }
    files = {r.file_no: r for r in diffs.diff_units(diffs.diff_files(rows), F.lit(False)).collect()}
    assert {k: (r.path, r.status, r.skipped) for k, r in files.items()} == {1: ("one.txt", "modified", None), 2: ("sub", "modified", "submodule"), 3: ("spé ace", "modified", "no-content-change")}
    assert [tuple(h) for h in files[1].focus] == [(1, 4), (11, 11)]


def test_unquote(spark):
    cases = {'"\\303\\251\\t\\\\"': "é\t\\", "plain": "plain", '"': '"', '"a \\"b\\""': 'a "b"'}
    row = spark.range(1).select(*(diffs.unquote(F.lit(x)) for x in cases)).first()
    assert tuple(row) == tuple(cases.values())


def test_versions(spark):
    cases = [("v1.2.3", "^1.2", True), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("2", "1.x || >=2", True), ("1.21.9", "<=1.21", True), ("1.21.9", ">1.21", False), ("none", "*", True), ("3.12", ">=3.10,<4", True), ("1.2.3.4", ">1.2.3", True)]
    for version, range_, wanted in cases:
        got = spark.range(1).select(versions.satisfies(F.lit(version), range_).alias("x")).first().x
        assert got == wanted, (version, range_)
    specs = {"^15.1.0": "15.1.0", "workspace:^1": "1", "[3.1,4)": "3.1", "(,4]": None, "^12.0|^11.0": "11.0", "file:../z": None, "!=3.9,>=3.10": "3.10", "<4": None, "~=3.11": "3.11"}
    for spec, wanted in specs.items():
        assert spark.range(1).select(versions.least_of(F.lit(spec)).alias("x")).first().x == wanted, spec


def test_redaction(spark):
    cases = {"a ghp_" + "a1B2" * 8 + " b": "a [REDACTED] b", "plain text": "plain text", "x" * 40: "x" * 40, "": "", "-----BEGIN PRIVATE KEY-----\nabc": "[REDACTED]"}
    for text, wanted in cases.items():
        assert spark.range(1).select(redaction.redact(F.lit(text)).alias("x")).first().x == wanted


def test_found_json():
    import pandas as pd

    cases = {"x ```json\n{\"a\": 1,}\n``` y": '{"a":1}', "see {\"a\": [1, 2]} and [3]": '{"a":[1,2]}', "} stray [1": None, "{{}": "{}", None: None, "```\nno\n```\n[1]": "[1]"}
    assert list(code.found_json(pd.Series(list(cases), dtype=object))) == list(cases.values())


def test_reports_that_do_not_fit(spark):
    texts = spark.createDataFrame([(1, "not json"), (2, "{}"), (3, "[]"), (4, None), (5, "<results/>")], "run long, text string")
    for reader in (reports.gitleaks, reports.shellcheck, reports.hadolint, reports.ruff, reports.cppcheck, reports.eslint, reports.tsc, reports.golangci, reports.phpstan, reports.semgrep, reports.sarif):
        assert [r for r in reader(texts, "run", "text").collect() if r.rule_id != "syntax-error"] == []


def test_run_store(spark, tmp_path):
    schema = "id string, created_at string, status string, day string"
    runs = spark.createDataFrame([("abc-1", "2026-01-01", "ok", "d1"), ("abd-2", "2026-01-02", "ok", "d2"), ("x-1", "2026-01-03", "bad", "d2")], schema)
    sinks.write_runs(runs.filter("day = 'd1'"), f"{tmp_path}/runs", "day")
    sinks.write_runs(runs.filter("day = 'd2'"), f"{tmp_path}/runs", "day")
    back = sinks.read_runs(spark, f"{tmp_path}/runs", schema)
    assert back.count() == 3 and [r.id for r in sinks.recent_runs(back, 2).collect()] == ["x-1", "abd-2"]
    assert [r.id for r in sinks.resolve_run(back, "abd").collect()] == ["abd-2"]
    assert sinks.resolve_run(back, "ab").collect() == [] and sinks.resolve_run(back, "-1").collect() == []
    assert [r.id for r in sinks.resolve_run(back, "x-1").collect()] == ["x-1"]


def test_cache_makes_only_what_is_missing(spark, tmp_path):
    asked = []

    def make(rows):
        asked.append(sorted(r.key for r in rows.collect()))
        return rows.withColumn("value", F.col("key") * 10)

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key long")
    first = sinks.cached(spark, keys(1, 2), f"{tmp_path}/cache", make).collect()
    again = sinks.cached(spark, keys(2, 3), f"{tmp_path}/cache", make).collect()
    assert asked == [[1, 2], [3]] and {(r.key, r.value) for r in first} == {(1, 10), (2, 20)} and {(r.key, r.value) for r in again} == {(2, 20), (3, 30)}


def test_file_units(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("é = 1")
    (tmp_path / "a" / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "a" / "big.txt").write_bytes(b"x" * 600_000)
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.content, r.skipped) for r in code.file_units(spark, str(tmp_path), []).collect()}
    assert got == {"x.py": ("python", "é = 1", None), "b.bin": (None, None, "binary"), "big.txt": (None, None, "too large")}


def test_streams_give_what_batches_give(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = spark.createDataFrame([(at(1), "a", 1), (at(2), "a", 1), (at(8), "b", 2), (at(31), "a", 3), (at(33), "a", 4)], "ts timestamp, kind string, fp long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    forms = {
        "counts": lambda e: events.window_counts(e, "ts", ["kind"], "10 minutes", "1 hour"),
        "sessions": lambda e: events.sessions(e, "ts", ["kind"], "5 minutes", "1 hour"),
        "once": lambda e: events.once(e, "ts", ["fp"], "1 hour").select("fp"),
    }
    for name, form in forms.items():
        mode = "append" if name == "once" else "complete"
        run = form(stream).writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        run.processAllAvailable()
        run.stop()
        assert sorted(map(tuple, spark.table(f"s_{name}").collect())) == sorted(map(tuple, form(rows).collect())), name


REPLIES = [
    (None, None), ("", None), ("no brackets", None), ("{not json} [1, 2,] tail", "[1,2]"), ('He said "x {"a": 1} and left', '{"a":1}'), ("```json\n{\"a\": 1,}\n```\n```\n[2]\n```\n```py\n[3]\n```", "[2]"), ("```json\nbroken {\n``` then {\"b\": {\"c\": [1]}} and [1, 2, 3, 4]", '{"b":{"c":[1]}}'),
    ('{"s": "a ] } \\" ,} b", "é": [1 , ]}', '{"s":"a ] } \\" ,} b","é":[1]}'), ("[" * 5000 + "1]", "[1]"), ("``` {\"open\": true}", '{"open":true}'), ("```\n7\n```", "7"), ("{" + "x" * 300_000 + "} [1]", "[1]"),
]


def test_json_in_replies():
    import pandas as pd

    from gleanline.sources.code import found_json

    assert list(found_json(pd.Series([t for t, _ in REPLIES], dtype=object))) == [j for _, j in REPLIES]


def test_script_statements_behind_others(spark):
    from gleanline.sources.code import imports

    text = "import a from 'm1';import 'm2'; import {\n  b,\n  c as d,\n} from \"m3\"\nexport * from 'm4'\nexport const e = 'no'\nconst f = require ( 'm5' ); jest.mock('m6', () => 1)\nif (x) { import('m7') }\nimport type { T } from 'm8'; // import z from 'm9'\nconst important = 'no'\nimport g, * as h from'm10'"
    (row,) = imports(spark.createDataFrame([("typescript", text)], "language string, content string")).collect()
    assert sorted(row.imports, key=lambda m: int(m[1:])) == ["m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8", "m10"]


def test_a_token_is_random_by_its_entropy_alone(spark):
    from gleanline.plans import scalars

    # md5 of 9161 makes a token of 3.794 bits a character, below the bar of 3.8: the operator leaves it
    low = "97737Q7937Q18Ey131r9T21TrQ811113pnnjnanpjnahaZ9"
    row = spark.createDataFrame([(f"a {low} b", f"a {low}{scalars._EVERY} b")], "low string, high string").select(redaction.clean_message(F.col("low")), redaction.clean_message(F.col("high"))).first()
    assert tuple(row) == (f"a {low} b", "a [REDACTED] b")


def test_redacted_lines_makes_random_tokens(spark, tmp_path):
    from gleanline.plans import scalars

    spark.createDataFrame([(9161,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in scalars.redacted_lines(spark, str(tmp_path)).collect()] == [(9161, "a [REDACTED] b")]


def test_only_an_id_of_zeros_is_uncommitted(spark):
    lines = [("0000c4" + "1" * 34, 5, "real")] * 3 + [("2" * 40, 9, "other")] * 2 + [("0" * 40, 9, "none")] * 9
    rows = spark.createDataFrame([("k", *x) for x in lines], "k string, commit string, author_time long, author string")
    assert [tuple(r) for r in diffs.dominant_blame(rows, ["k"]).collect()] == [("k", "0000c4" + "1" * 34, "real", 3)]


def test_a_version_is_read_once_for_all_bounds(spark):
    plan = spark.range(1).select(versions.satisfies(F.col("id").cast("string"), "^1.2.3 || >=2 <3 || ~4.1 || 5.x || <=0.3").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_cppcheck_errors_are_each_read_in_their_own_piece(spark):
    xml = '<results><errors>\n<error id="none" severity="error"/>\n<error id="a&lt;" severity="warning" msg="m" cwe="787"><symbol>s</symbol><location line="3" file="x.c"/><location file="y.c" line="9"/></error>\n<error id="b" severity="error"><error id="in" severity="error"/><location file="z.c" line="4"></location></error><error id="c" severity="error"></error><error id="d" severity="error"><location file="w.c" line="1"</error></errors>'
    found = reports.cppcheck(spark.createDataFrame([(1, xml), (2, None), (3, "")], "k int, text string"), "k", "text")
    assert {(r.k, r.rule_id, r.file, r.start, r.severity, r.category, r.message) for r in found.collect()} == {(1, "a<", "x.c", 3, "minor", "security", "m"), (1, "b", "z.c", 4, "major", "bug", "b")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 7 and "regexp_extract_all(" not in plan


def test_compiler_messages_are_cut_without_a_shuffle(spark):
    text = "odd\r\n  lost\r\na.ts(1,7): error TS1: one\r\n    more\n\n\tof it\nplain\nb(2).ts(3,4): warning TS22: two: error TS3: x\na.ts(1): error TS4: none\n  of two\n(9,9): error TS5: no file\nc.ts(5,6): error TS6: "
    found = reports.tsc(spark.createDataFrame([("k", text), ("empty", ""), ("none", None)], "key string, text string"), "key", "text")
    got = {(r.file, r.start, r.rule_id, r.message) for r in found.collect()}
    assert got == {("a.ts", 1, "TS1", "one more \tof it"), ("b(2).ts", 3, "TS22", "two: error TS3: x of two"), ("c.ts", 5, "TS6", "")}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_logs_are_not_sorted_to_meet_their_rules(spark):
    rows = spark.createDataFrame([("r", "f", 1, 2, "major", "bug", 0.5, "t", None, None, "x")], "run string, file string, start long, end long, severity string, category string, confidence double, title string, analyzer string, rule_id string, fingerprint string")
    assert "SortMergeJoin" not in sinks.sarif(rows, "run")._jdf.queryExecution().executedPlan().toString()
