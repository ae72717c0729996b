"""The rule engine and the life of hits on small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.operators import findings, intervals, rules

SCHEMA = "file long, path string, language string, content string, ranges array<struct<a:int,b:int>>"


def hits(spark, content, language="python", path="src/a.py", ranges=None):
    files = spark.createDataFrame([(1, path, language, content, ranges)], SCHEMA)
    return {(r.start, r.end, r.rule_id) for r in rules.scan(files).collect()}


def test_two_rules_on_one_line_both_stay(spark):
    text = "x = eval(pickle.loads(raw))\nimport pickle"
    assert hits(spark, text) == {(1, 1, "py-dynamic-code"), (1, 1, "py-pickle")}
    files = spark.createDataFrame([(1, "src/a.py", "python", text, None)], SCHEMA)
    assert {(r.start, r.rule_id, r.confidence) for r in rules.analyze(files).collect()} == {(1, "py-dynamic-code", 0.6), (1, "py-pickle", 0.6)}


def test_scopes_comments_windows_and_changed_lines(spark):
    assert hits(spark, "pickle.loads(raw)") == set()  # the file does not import it
    assert hits(spark, "# os.system(x)\nos.system(x)") == {(2, 2, "py-system")}
    assert hits(spark, "os.system(x)", "go") == set()
    assert hits(spark, "yaml.load(f, Loader=SafeLoader)") == set()
    text = "subprocess.run(cmd,\n  env,\n  shell=True)\npass"
    assert hits(spark, text) == {(1, 3, "py-shell")}
    assert hits(spark, text, ranges=[(3, 3)]) == {(1, 3, "py-shell")} and hits(spark, text, ranges=[(4, 9)]) == set()
    assert hits(spark, "  pull_request_target:", "text", ".github/workflows/x") == {(1, 1, "yaml-target")}
    assert hits(spark, "") == set() and hits(spark, "a\0eval(x)") == set() and hits(spark, "x" * 1000 + " eval(y)") == set()


def test_a_line_meets_only_the_rules_of_its_language_or_path(spark):
    mine = [rules.Rule("a", "x", "minor", "bug", 0.5, ("go",), ("**/workflows/*",)), rules.Rule("b", "x", "minor", "bug", 0.5, ("go", "c")), rules.Rule("c", "x", "minor", "bug", 0.5, globs=("ci/*",))]
    rows = [(1, "f", "go"), (2, "f", "c"), (3, "f", "text"), (4, "workflows/f", "c"), (5, "ci/f", "go"), (6, "ci/f", None), (7, "workflows/f", "text")]
    files = spark.createDataFrame([(i, p, lang, "x", None) for i, p, lang in rows], SCHEMA)
    found = {(r.file, r.rule_id) for r in rules.scan(files, mine).collect()}
    assert found == {(1, "a"), (1, "b"), (2, "b"), (4, "a"), (4, "b"), (5, "a"), (5, "b"), (5, "c"), (6, "c"), (7, "a")}
    # the language is asked for once a list of rules, not once a rule
    many = [rules.Rule(f"r{k}", "x", "minor", "bug", 0.5, ("go",)) for k in range(12)]
    tried = next(line for line in rules.scan(files, many)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "r11" in line)
    assert tried.count("language#") == 1


def test_at_least_sixty_rules_of_their_own():
    assert len(rules.RULES) >= 60 and len({r.id for r in rules.RULES}) == len(rules.RULES)


def test_final_hits(spark):
    row = lambda start, rule, key=None, firm=False, c=0.9, file=1, end=None, analyzer="a": (file, start, end or start, analyzer, rule, "major", "bug", c, f"m{start}", firm, key)
    rows = [row(k, "many") for k in range(1, 15)] + [row(k, "firm", firm=True) for k in range(1, 15)] + [row(5, "x", "k", c=0.5), row(5, "y", "k", c=0.7), row(5, "z"), row(99, "late"), row(1, "gone", file=9), row(20, "t", file=2, c=2.0)]
    schema = "file long, start long, end long, analyzer string, rule_id string, severity string, category string, confidence double, message string, non_rejectable boolean, dedupe_key string"
    files = spark.createDataFrame([(1, 50, None, False), (2, 30, [(1, 17)], True)], "file long, n_lines long, ranges array<struct<a:int,b:int>>, is_test boolean")
    got = findings.number_hits(findings.finalize_hits(spark.createDataFrame(rows, schema), files).withColumn("run", F.lit(1)), "run").collect()
    of = lambda rule: sorted(r.start for r in got if r.rule_id == rule)
    assert of("many") == list(range(1, 11)) and of("firm") == list(range(1, 15)) and of("x") == [] and of("y") == [5] and of("z") == [5] and of("late") == of("gone") == []
    assert [(r.start, r.confidence) for r in got if r.rule_id == "t"] == [(20, 0.76)]
    assert sorted(int(r.hit_id[1:]) for r in got) == list(range(1, len(got) + 1))


def test_secrets_are_masked_and_firm(spark):
    token = "ghp_" + "aB3x" * 9
    files = spark.createDataFrame([(1, "src/c.ts", "typescript", f"// secretlint-disable-next-line\nconst t = '{token}';", [(1, 2)])], SCHEMA)
    got = {r.analyzer: r for r in rules.analyze(files).collect()}
    assert got["secrets"].non_rejectable and got["secrets"].severity == "critical" and token not in got["secrets"].message and "[REDACTED]" in got["secrets"].message
    assert got["suppressions"].severity == "info" and got["suppressions"].start == 1


def test_semi_and_anti_joins_keep_repeated_rows(spark):
    a = spark.createDataFrame([("k", 1, 2, "x")] * 2 + [("k", 90, 91, "x")] * 2, "key string, start long, end long, label string")
    b = spark.createDataFrame([("k", 3, 4), ("k", 1, 1)], "key string, start_b long, end_b long")
    assert intervals.overlap_join(a, b, ["key"], 1, 16, "left_semi").count() == 2
    assert [r.start for r in intervals.overlap_join(a, b, ["key"], 1, 16, "left_anti").collect()] == [90, 90]


def test_the_cap_keeps_the_strongest_of_equal_hits(spark):
    schema = "file string, start long, end long, analyzer string, rule_id string, severity string, category string, confidence double, message string, non_rejectable boolean, dedupe_key string"
    files = spark.createDataFrame([("f", 50, None, False)], "file string, n_lines long, ranges array<struct<a:bigint,b:bigint>>, is_test boolean")
    rows = [("f", 3, 4, "a", "r", severity, "bug", confidence, "same", False, key) for severity, confidence, key in (("minor", 0.9, "x"), ("critical", 0.3, "y"), ("major", 0.5, "z"))]
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        kept = findings.finalize_hits(spark.createDataFrame(some, schema).coalesce(1), files, 2).collect()
        assert {r.severity for r in kept} == {"critical", "major"}
