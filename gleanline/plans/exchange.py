"""Queries over analyzer reports: reports are written from findings, read back and compared with what they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.plans.facts import SQL, files, findings, table
from gleanline.plans.registry import query
from gleanline.sources import reports, sinks

_COLUMNS = ["run", "rule_id", "file", "start", "end", "severity", "category", "confidence"]
_PATH = "concat('src/f', CAST(file AS {s}), '.x')"


def _read(reader, made, *more):
    return reader(made, "run", "text", *more).select(*_COLUMNS)


def _made(rows, body, wrap=lambda a: a):
    """(run, text): the structs of a run's findings as JSON."""
    return rows.groupBy("run").agg(F.to_json(wrap(F.collect_list(body))).alias("text"))


def _facts(spark, sf_dir):
    return findings(spark, sf_dir).withColumn("path", F.expr(_PATH.format(s="STRING")))


def _sql(rule: str, end: str, severity: str, category: str, confidence: str, where: str = "true", start: str = "start") -> str:
    return f'WITH {SQL} SELECT run, {rule} AS rule_id, {_PATH.format(s="VARCHAR")} AS file, {start} AS start, {end} AS "end", {severity} AS severity, {category} AS category, ({confidence})::DOUBLE AS confidence FROM f WHERE {where}'


_GENERIC = "part % 3 = 0"


@query("report_gitleaks", _sql("CASE WHEN part % 3 = 0 THEN 'generic-key' ELSE 'token' END", '"end"', f"CASE WHEN {_GENERIC} THEN 'major' ELSE 'critical' END", "'security'", f"CASE WHEN {_GENERIC} THEN 0.4 ELSE 0.6 END"))
def report_gitleaks(spark, sf_dir):
    body = F.struct(F.expr(f"if({_GENERIC}, 'generic-key', 'token')").alias("RuleID"), F.col("title").alias("Description"), F.col("start").alias("StartLine"), F.col("end").alias("EndLine"), F.col("path").alias("File"))
    return _read(reports.gitleaks, _made(_facts(spark, sf_dir), body))


@query("report_shellcheck", _sql("concat('SC', 2000 + part % 90)", '"end"', "CASE supp % 4 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'info' END", "'bug'", "CASE supp % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.45 ELSE 0.3 END", "supp % 4 <> 3"))
def report_shellcheck(spark, sf_dir):
    body = F.struct(F.col("path").alias("file"), F.col("start").alias("line"), F.col("end").alias("endLine"), F.expr("case supp % 4 when 0 then 'error' when 1 then 'warning' when 2 then 'info' else 'style' end").alias("level"), F.expr("2000 + part % 90").alias("code"), F.col("title").alias("message"))
    return _read(reports.shellcheck, _made(_facts(spark, sf_dir), body, lambda a: F.struct(a.alias("comments"))))


@query("report_hadolint", _sql("concat('DL', 3000 + part % 6)", "start", "CASE supp % 3 WHEN 0 THEN 'minor' ELSE 'info' END", "CASE WHEN part % 6 IN (2, 4) THEN 'security' ELSE 'bug' END", "CASE supp % 3 WHEN 0 THEN 0.4 ELSE 0.3 END", "supp % 3 <> 2"))
def report_hadolint(spark, sf_dir):
    body = F.struct(F.col("path").alias("file"), F.col("start").alias("line"), F.expr("case supp % 3 when 0 then 'error' when 1 then 'warning' else 'info' end").alias("level"), F.expr("concat('DL', string(3000 + part % 6))").alias("code"), F.col("title").alias("message"))
    return _read(reports.hadolint, _made(_facts(spark, sf_dir), body))


_RUFF = "CASE part % 8 WHEN 0 THEN 'S102' WHEN 1 THEN 'S324' WHEN 2 THEN 'F821' WHEN 3 THEN 'PLE0101' WHEN 4 THEN 'ASYNC100' WHEN 5 THEN 'B006' WHEN 6 THEN 'E999' END"


@query("report_ruff", _sql(f"coalesce({_RUFF}, 'syntax-error')", 'CASE WHEN supp % 2 = 0 THEN "end" ELSE start END', "CASE WHEN part % 8 IN (1, 4, 5) THEN 'minor' ELSE 'major' END", "CASE part % 8 WHEN 0 THEN 'security' WHEN 1 THEN 'security' WHEN 4 THEN 'concurrency' ELSE 'bug' END", "CASE part % 8 WHEN 0 THEN 0.5 WHEN 1 THEN 0.35 WHEN 4 THEN 0.45 WHEN 5 THEN 0.45 ELSE 0.6 END"))
def report_ruff(spark, sf_dir):
    body = F.struct(F.col("path").alias("filename"), F.expr(_RUFF).alias("code"), F.col("title").alias("message"), F.struct(F.col("start").alias("row")).alias("location"), F.when(F.expr("supp % 2 = 0"), F.struct(F.col("end").alias("row"))).alias("end_location"))
    return _read(reports.ruff, _made(_facts(spark, sf_dir), body))


_CPP = "CASE supp % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'performance' WHEN 3 THEN 'portability' ELSE 'style' END"


@query("report_cppcheck", _sql("concat('rule<', part % 9)", "start", "CASE supp % 5 WHEN 0 THEN 'major' WHEN 3 THEN 'info' ELSE 'minor' END", "CASE WHEN part % 4 = 0 THEN 'security' WHEN supp % 5 = 2 THEN 'performance' ELSE 'bug' END", "CASE supp % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.45 WHEN 2 THEN 0.35 ELSE 0.3 END", "supp % 5 <> 4 AND part % 10 <> 3"))
def report_cppcheck(spark, sf_dir):
    rows = _facts(spark, sf_dir)
    rule = F.expr("if(part % 10 = 3, 'missingIncludeSystem', concat('rule&lt;', string(part % 9)))")
    place = F.concat(F.lit('<location file="'), "path", F.lit('" line="'), F.col("start").cast("string"), F.lit('"/><location file="other" line="1"/>'))
    error = F.concat(F.lit('<error id="'), rule, F.lit('" severity="'), F.expr(_CPP), F.lit('" msg="a &amp; b"'), F.expr("if(part % 4 = 0, ' cwe=\"787\"', '')"), F.lit(">"), place, F.lit("</error>"))
    made = rows.groupBy("run").agg(F.concat(F.lit("<results><errors>"), F.array_join(F.collect_list(error), "\n"), F.lit('<error id="none" severity="error"/></errors></results>')).alias("text"))
    return _read(reports.cppcheck, made)


_ESLINT = "CASE part % 6 WHEN 0 THEN 'no-eval' WHEN 1 THEN 'require-await' WHEN 2 THEN 'semi' WHEN 3 THEN 'no-undef' WHEN 4 THEN '@stylistic/indent' END"


@query("report_eslint", _sql(f"coalesce({_ESLINT}, CASE WHEN supp % 7 = 0 THEN 'parse-error' ELSE 'eslint' END)", '"end"', "CASE WHEN supp % 7 = 0 THEN 'major' WHEN supp % 2 = 0 THEN 'minor' ELSE 'info' END", "CASE part % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'concurrency' ELSE 'bug' END", "CASE WHEN supp % 7 = 0 THEN 0.5 WHEN supp % 2 = 0 THEN 0.4 ELSE 0.3 END", "part % 6 NOT IN (2, 4)"))
def report_eslint(spark, sf_dir):
    message = F.struct(F.expr(_ESLINT).alias("ruleId"), F.expr("if(supp % 7 = 0, true, null)").alias("fatal"), F.expr("if(supp % 2 = 0, 2, 1)").alias("severity"), F.col("start").alias("line"), F.col("end").alias("endLine"), F.col("title").alias("message"))
    per_file = _facts(spark, sf_dir).groupBy("run", "path").agg(F.collect_list(message).alias("messages"))
    return _read(reports.eslint, _made(per_file, F.struct(F.col("path").alias("filePath"), "messages")))


@query("report_tsc", _sql("concat('TS', 2300 + part % 40)", "start", "CASE WHEN supp % 2 = 0 THEN 'major' ELSE 'minor' END", "'bug'", "0.55"))
def report_tsc(spark, sf_dir):
    line = F.concat("path", F.lit("("), F.col("start").cast("string"), F.lit(",7): "), F.expr("if(supp % 2 = 0, 'error', 'warning')"), F.expr("concat(' TS', string(2300 + part % 40))"), F.lit(": "), "title", F.expr("if(part % 3 = 0, '\\r\\n    more of it', '')"))
    made = _facts(spark, sf_dir).groupBy("run").agg(F.concat(F.array_join(F.collect_list(line), "\r\n"), F.lit("\r\nFound errors.")).alias("text"))
    return _read(reports.tsc, made)


@query("report_golangci", _sql("CASE part % 4 WHEN 0 THEN 'gosec' WHEN 1 THEN 'errcheck' ELSE 'govet' END", "start", "CASE WHEN part % 4 = 0 THEN 'major' ELSE 'minor' END", "CASE part % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'error-handling' ELSE 'bug' END", "0.45", "part % 4 <> 3"))
def report_golangci(spark, sf_dir):
    body = F.struct(F.expr("case part % 4 when 0 then 'gosec' when 1 then 'errcheck' when 2 then 'govet' else 'lll' end").alias("FromLinter"), F.col("title").alias("Text"), F.struct(F.col("path").alias("Filename"), F.col("start").alias("Line")).alias("Pos"))
    return _read(reports.golangci, _made(_facts(spark, sf_dir), body, lambda a: F.struct(a.alias("Issues"))))


@query("report_phpstan", _sql("'phpstan'", "start", "'major'", "'bug'", "0.45"))
def report_phpstan(spark, sf_dir):
    per_file = _facts(spark, sf_dir).groupBy("run", "path").agg(F.collect_list(F.struct(F.col("title").alias("message"), F.col("start").alias("line"))).alias("messages"))
    made = per_file.groupBy("run").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("path", F.struct("messages")))).alias("files"))).alias("text"))
    return _read(reports.phpstan, made)


@query("report_semgrep", _sql("concat('rule.', part % 12)", 'CASE WHEN supp % 2 = 0 THEN "end" ELSE start END', "CASE supp % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'info' END", "CASE WHEN part % 5 = 0 OR part % 7 = 0 THEN 'security' WHEN part % 5 = 1 THEN 'performance' ELSE 'bug' END", "CASE part % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.45 WHEN 2 THEN 0.3 ELSE 0.45 END"))
def report_semgrep(spark, sf_dir):
    meta = F.struct(F.expr("case part % 5 when 0 then 'security' when 1 then 'performance' end").alias("category"), F.expr("if(part % 7 = 0, 'CWE-79', null)").alias("cwe"), F.expr("case part % 4 when 0 then 'high' when 1 then 'MEDIUM' when 2 then 'Low' end").alias("confidence"))
    extra = F.struct(F.col("title").alias("message"), F.expr("case supp % 3 when 0 then 'ERROR' when 1 then 'warning' else 'INFO' end").alias("severity"), meta.alias("metadata"))
    body = F.struct(F.expr("concat('rule.', string(part % 12))").alias("check_id"), "path", F.struct(F.col("start").alias("line")).alias("start"), F.when(F.expr("supp % 2 = 0"), F.struct(F.col("end").alias("line"))).alias("end"), extra.alias("extra"))
    return _read(reports.semgrep, _made(_facts(spark, sf_dir), body, lambda a: F.struct(a.alias("results"))))


@query("report_sarif", _sql("concat('R', part % 15)", '"end"', "CASE part % 15 % 3 WHEN 0 THEN CASE WHEN part % 15 >= 9 THEN 'critical' WHEN part % 15 >= 7 THEN 'major' WHEN part % 15 >= 4 THEN 'minor' ELSE 'info' END ELSE CASE supp % 4 WHEN 0 THEN 'major' WHEN 1 THEN 'info' ELSE 'minor' END END", "CASE WHEN part % 15 % 3 = 0 THEN 'security' WHEN part % 15 % 3 = 1 THEN 'performance' ELSE 'bug' END", "CASE part % 15 % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.45 ELSE 0.4 END", "part % 15 <> 14"))
def report_sarif(spark, sf_dir):
    """Logs with 15 rules; a third has a security score, a third a tag, one is style only; results name them by id or by number."""
    number = F.expr("cast(part % 15 as int)")
    rule = lambda k: F.struct(F.concat(F.lit("R"), k.cast("string")).alias("id"), F.struct(F.when(k % 3 == 0, k.cast("string")).alias("security-severity"), F.when(k % 4 == 0, "very-high").when(k % 4 == 1, "medium").alias("precision"), F.when(k == 14, F.array(F.lit("Style"))).when(k % 3 == 1, F.array(F.lit("performance"))).alias("tags")).alias("properties"))
    place = F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start").alias("startLine"), F.col("end").alias("endLine")).alias("region"))
    result = F.struct(F.when(F.expr("supp % 2 = 0"), F.concat(F.lit("R"), number.cast("string"))).alias("ruleId"), F.when(F.expr("supp % 2 = 1"), number).alias("ruleIndex"), F.expr("case supp % 4 when 0 then 'error' when 1 then 'note' when 2 then 'odd' end").alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))
    rules = F.transform(F.sequence(F.lit(0), F.lit(14)), rule)
    wrap = lambda a: F.struct(F.array(F.struct(F.struct(F.struct(rules.alias("rules")).alias("driver")).alias("tool"), a.alias("results"))).alias("runs"))
    return _read(reports.sarif, _made(_facts(spark, sf_dir), result, wrap))


@query("report_osv", """WITH p AS (SELECT DISTINCT l_orderkey % 200 AS run, l_partkey FROM lineitem WHERE l_partkey % 10 = 0), m AS (SELECT concat('m', p_partkey % 200, '/package.json') AS file, 1 + p_partkey % 37 AS line, concat('lib', p_partkey) AS name FROM part),
j AS (SELECT DISTINCT run, name, m.file, line, l_partkey FROM p JOIN m ON name = concat('lib', l_partkey) AND m.file = concat('m', l_partkey % 200, '/package.json'))
SELECT run, concat('OSV-', l_partkey) AS rule_id, file, line AS start, line AS "end", CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_partkey % 100 >= 90 THEN 'critical' WHEN l_partkey % 100 >= 70 THEN 'major' WHEN l_partkey % 100 >= 40 THEN 'minor' ELSE 'info' END ELSE 'minor' END AS severity, 'security' AS category, 0.7::DOUBLE AS confidence FROM j""")
def report_osv(spark, sf_dir):
    """Vulnerable packages of every tenth part, at the manifest lines that name them."""
    parts = table(spark, sf_dir, "lineitem").filter("l_partkey % 10 = 0").selectExpr("l_orderkey % 200 AS run", "l_partkey").distinct()
    vulnerability = F.struct(F.expr("concat('OSV-', string(l_partkey))").alias("id"), F.struct(F.lit("moderate").alias("severity")).alias("database_specific"))
    package = F.struct(F.struct(F.expr("concat('lib', string(l_partkey))").alias("name"), F.lit("1.0").alias("version")).alias("package"), F.when(F.expr("l_partkey % 4 = 0"), F.array(F.struct(F.expr("string(l_partkey % 100 / 10)").alias("max_severity")))).alias("groups"), F.array(vulnerability).alias("vulnerabilities"))
    body = F.struct(F.struct(F.expr("concat('m', string(l_partkey % 200), '/package.json')").alias("path")).alias("source"), F.array(package).alias("packages"))
    manifests = table(spark, sf_dir, "part").select(F.expr("concat('m', string(p_partkey % 200), '/package.json')").alias("file"), F.expr("1 + p_partkey % 37").alias("line"), F.expr("concat('  \"lib', string(p_partkey), '\": \"^1.2\",')").alias("content"))
    return _read(reports.osv, _made(parts, body, lambda a: F.struct(a.alias("results"))), manifests)


@query("known_report_files", f"WITH {SQL} SELECT file, count(*) AS n FROM f JOIN o USING (file) GROUP BY file")
def known_report_files(spark, sf_dir):
    return reports.known_files(findings(spark, sf_dir), files(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def _reported(spark, sf_dir):
    return _facts(spark, sf_dir).withColumn("file", F.col("path")).withColumn("fingerprint", F.md5("id")).withColumn("analyzer", F.expr("if(supp % 3 = 0, null, analyzer)"))


_RULE = "CASE WHEN supp % 3 <> 0 THEN concat(analyzer, '/', rule_id) WHEN category = 'security' THEN concat('review/security/', severity) ELSE concat('review/', category) END"


@query("sarif_sink", f"""WITH {SQL}, r AS (SELECT *, {_RULE} AS rule FROM f), w AS (SELECT run, rule, arg_min(severity, CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END) AS worst FROM r GROUP BY ALL)
SELECT r.run, r.rule AS rule_id, md5(id) AS fingerprint, CASE severity WHEN 'critical' THEN 'error' WHEN 'major' THEN 'error' WHEN 'minor' THEN 'warning' ELSE 'note' END AS level, CASE worst WHEN 'critical' THEN 'error' WHEN 'major' THEN 'error' WHEN 'minor' THEN 'warning' ELSE 'note' END AS rule_level FROM r JOIN w USING (run, rule)""")
def sarif_sink(spark, sf_dir):
    """The SARIF logs of all runs, read back: each result with its rule's level."""
    logs = sinks.sarif(_reported(spark, sf_dir), "run")
    schema = "struct<runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>,results:array<struct<ruleId:string,level:string,partialFingerprints:map<string,string>>>>>>"
    runs = logs.select("run", F.explode(F.from_json("text", schema)["runs"]).alias("r"))
    runs = runs.select("run", F.col("r.results").alias("results"), F.transform("r.tool.driver.rules", lambda y: y["id"]).alias("ids"), F.transform("r.tool.driver.rules", lambda y: y["defaultConfiguration"]["level"]).alias("levels"))
    level = lambda x: F.get("levels", (F.array_position("ids", x["ruleId"]) - 1).cast("int"))
    rows = runs.select("run", F.explode(F.transform("results", lambda x: F.struct(x.alias("x"), level(x).alias("rule_level")))).alias("y")).select("run", "y.x", "y.rule_level")
    return rows.select("run", F.col("x.ruleId").alias("rule_id"), F.element_at("x.partialFingerprints", F.lit("finding/v1")).alias("fingerprint"), "x.level", "rule_level")


@query("code_quality_sink", f"""WITH {SQL} SELECT run, {_RULE} AS check_name, md5(id) AS fingerprint, title AS description, start AS begin_line, "end" AS end_line FROM f""")
def code_quality_sink(spark, sf_dir):
    issues = sinks.code_quality(_reported(spark, sf_dir), "run")
    schema = "array<struct<description:string,check_name:string,fingerprint:string,location:struct<lines:struct<begin:long,end:long>>>>"
    rows = issues.select("run", F.explode(F.from_json("text", schema)).alias("i"))
    return rows.select("run", "i.check_name", "i.fingerprint", "i.description", F.col("i.location.lines.begin").alias("begin_line"), F.col("i.location.lines.end").alias("end_line"))
