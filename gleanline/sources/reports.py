"""Readers of analyzer reports: each report is one row of text, its findings become rows.

All readers return (key, rule_id, file, start, end, severity, category, confidence, message, non_rejectable).
JSON is read by from_json with the schema that a reader needs; what does not fit a schema reads as null
and gives no rows. Paths are left as reported: known_files() keeps those of the reviewed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tools' codes and levels and what they count as.
RUFF_SINKS = ["S102", "S301", "S302", "S307", "S501", "S502", "S503", "S504", "S506", "S602", "S604", "S605", "S608", "S611", "S701"]
GO_STYLE = ["gofmt", "gofumpt", "goimports", "gci", "lll", "misspell", "whitespace", "wsl", "godot", "stylecheck", "revive", "dupword", "nlreturn", "varnamelen", "tagliatelle", "mnd", "funlen", "gocognit", "cyclop", "gocyclo", "nestif", "dupl"]
ESLINT_STYLE = r"prettier|stylistic|(?:^|/)(?:indent|quotes|semi|comma-\w+|max-len|eol-last|no-trailing-spaces|padding-\w+|space-\w+|\w+-spacing|sort-\w+|import/order|simple-import-sort|naming-convention|camelcase|func-style|arrow-body-style|prefer-template|object-shorthand|curly|brace-style|quote-props|lines-between-class-members|no-multiple-empty-lines|newline-\w+)$"
CPPCHECK_NOISE = r"^(?:missingInclude\w*|unmatchedSuppression|checkersReport|toomanyconfigs|noValidConfiguration|normalCheckLevelMaxBranches|syntaxError|unknownMacro|preprocessorErrorDirective|internalAstError)$"
CPPCHECK_SECURITY = r"^(?:119|120|121|122|125|131|134|190|415|416|476|562|787|788)$"


def _json(reports: DataFrame, text: str, schema: str) -> DataFrame:
    return reports.withColumn("_j", F.from_json(text, schema))


def _out(rows: DataFrame, key: str, rule: Column, file: Column, start: Column, end: Column, severity: Column, category: Column, confidence: Column, message: Column, non_rejectable: bool = False) -> DataFrame:
    first = start.cast("long")
    return rows.select(
        key, rule.alias("rule_id"), file.alias("file"), first.alias("start"), F.coalesce(end.cast("long"), first).alias("end"), severity.alias("severity"), category.alias("category"),
        confidence.cast("double").alias("confidence"), message.alias("message"), F.lit(non_rejectable).alias("non_rejectable"),
    ).filter("file IS NOT NULL AND start IS NOT NULL")


def known_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    return hits.join(files.select("file").distinct(), "file", "left_semi")


def score_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "major").when(score >= 4, "minor").otherwise("info")


def gitleaks(reports: DataFrame, key: str, text: str) -> DataFrame:
    rows = _json(reports, text, "array<struct<RuleID:string,Description:string,StartLine:long,EndLine:long,File:string>>").select(key, F.explode("_j").alias("r"))
    rule = F.coalesce("r.RuleID", F.lit("secret"))
    generic = rule.rlike("(?i)generic")
    return _out(rows.filter("r.StartLine <> 0"), key, rule, F.col("r.File"), F.col("r.StartLine"), F.col("r.EndLine"), F.when(generic, "major").otherwise("critical"), F.lit("security"), F.when(generic, 0.4).otherwise(0.6), F.concat(F.lit("Hard-coded secret: "), F.coalesce("r.Description", rule), F.lit(" (value redacted)")), True)


def shellcheck(reports: DataFrame, key: str, text: str) -> DataFrame:
    rows = _json(reports, text, "struct<comments:array<struct<file:string,line:long,endLine:long,level:string,code:long,message:string>>>").select(key, F.explode("_j.comments").alias("r"))
    level = F.col("r.level")
    severity = F.when(level == "error", "major").when(level == "warning", "minor").when(level == "info", "info")
    confidence = F.when(level == "error", 0.5).when(level == "warning", 0.45).otherwise(0.3)
    return _out(rows.filter(severity.isNotNull()), key, F.concat(F.lit("SC"), F.col("r.code").cast("string")), F.col("r.file"), F.col("r.line"), F.col("r.endLine"), severity, F.lit("bug"), confidence, F.col("r.message"))


def hadolint(reports: DataFrame, key: str, text: str) -> DataFrame:
    rows = _json(reports, text, "array<struct<file:string,line:long,level:string,code:string,message:string>>").select(key, F.explode("_j").alias("r")).filter("r.level IN ('error', 'warning')")
    error = F.col("r.level") == "error"
    return _out(rows, key, F.col("r.code"), F.col("r.file"), F.col("r.line"), F.lit(None), F.when(error, "minor").otherwise("info"), F.when(F.col("r.code").isin("DL3002", "DL3004"), "security").otherwise("bug"), F.when(error, 0.4).otherwise(0.3), F.col("r.message"))


def ruff(reports: DataFrame, key: str, text: str) -> DataFrame:
    rows = _json(reports, text, "array<struct<filename:string,code:string,message:string,location:struct<row:long>,end_location:struct<row:long>>>").select(key, F.explode("_j").alias("r"))
    code = F.coalesce("r.code", F.lit("syntax-error"))
    fatal, unsafe = (code == "syntax-error") | F.startswith(code, F.lit("E9")), F.startswith(code, F.lit("S"))
    name = code.rlike("^F8(?:21|22|23)$") | F.startswith(code, F.lit("PLE"))
    sink, waits = code.isin(*RUFF_SINKS), F.startswith(code, F.lit("ASYNC"))
    severity = F.when(fatal, "major").when(unsafe, F.when(sink, "major").otherwise("minor")).when(name, "major").otherwise("minor")
    category = F.when(fatal, "bug").when(unsafe, "security").when(waits, "concurrency").otherwise("bug")
    confidence = F.when(fatal, 0.6).when(unsafe, F.when(sink, 0.5).otherwise(0.35)).when(name, 0.6).otherwise(0.45)
    start = F.coalesce("r.location.row", F.lit(1))
    return _out(rows, key, code, F.col("r.filename"), start, F.greatest(start, F.coalesce("r.end_location.row", start)), severity, category, confidence, F.col("r.message"))


def cppcheck(reports: DataFrame, key: str, text: str) -> DataFrame:
    """The XML report, whose errors hold at least one location; the first one counts."""
    # errors without content have no location; each other one ends its own piece, as all matches of one pattern would copy the report for each
    filled = F.regexp_replace(text, r"<error\b[^>]*+(?<=/)>", " ")
    pieces = F.transform(F.filter(F.split(filled, "(?<=</error>)", -1), lambda p: F.endswith(p, F.lit("</error>"))), lambda p: F.substring_index(p, "</error>", 1))
    # outer, as Spark would otherwise read a report once more to see whether it has any error
    rows = reports.select(key, F.explode_outer(pieces).alias("e")).filter("e IS NOT NULL")

    def attribute(of: Column, name: str) -> Column:
        raw = F.regexp_extract(of, rf'(?:^|\s){name}="([^"]*)"', 1)
        for entity, plain in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(entity), F.lit(plain))
        return F.nullif(raw, F.lit(""))

    # each attribute is read once: behind an explode no filter or later column works it out anew
    once = lambda rows, *columns: rows.select(key, F.explode_outer(F.array(F.struct(*columns))).alias("_n")).select(key, "_n.*")
    tag = lambda of, name: F.get(F.split(of, rf"<{name}\b", 2), F.lit(1))
    opened = once(rows, tag(F.col("e"), "error").alias("e"))
    cut = once(opened, F.substring_index("e", ">", 1).alias("a"), tag(F.substring(F.col("e"), F.instr("e", F.lit(">")) + 1, F.length("e")), "location").alias("b"))
    place = F.when(F.contains("b", F.lit(">")), F.substring_index("b", ">", 1))
    named = once(cut, *(attribute(F.col("a"), n).alias(n) for n in ("id", "severity", "msg", "verbose", "cwe")), attribute(place, "file").alias("file"), attribute(place, "line").try_cast("long").alias("line"))
    kind = F.col("severity")
    known = kind.isin("error", "warning", "performance", "portability") & ~F.coalesce("id", F.lit("unknown")).rlike(CPPCHECK_NOISE) & (F.col("line") >= 1)
    severity = F.when(kind == "error", "major").when(kind == "portability", "info").otherwise("minor")
    category = F.when(F.col("cwe").rlike(CPPCHECK_SECURITY), "security").when(kind == "performance", "performance").otherwise("bug")
    confidence = F.when(kind == "error", 0.5).when(kind == "warning", 0.45).when(kind == "performance", 0.35).otherwise(0.3)
    rule = F.coalesce("id", F.lit("unknown"))
    return _out(named.filter(known), key, rule, F.col("file"), F.col("line"), F.lit(None), severity, category, confidence, F.coalesce("msg", "verbose", rule))


def eslint(reports: DataFrame, key: str, text: str) -> DataFrame:
    rows = _json(reports, text, "array<struct<filePath:string,messages:array<struct<ruleId:string,fatal:boolean,severity:int,line:long,endLine:long,message:string>>>>").select(key, F.explode("_j").alias("f")).select(key, F.col("f.filePath").alias("file"), F.explode("f.messages").alias("m"))
    fatal = F.coalesce("m.fatal", F.lit(False))
    rule = F.coalesce("m.ruleId", F.when(fatal, "parse-error").otherwise("eslint"))
    category = F.when(rule.rlike("(?i)security|xss|injection|unsanitized|no-eval|no-implied-eval|no-new-func"), "security").when(rule.rlike("(?i)promise|await|async|floating|misused"), "concurrency").otherwise("bug")
    hard = F.col("m.severity") >= 2
    rows = rows.filter(~rule.rlike(ESLINT_STYLE) & (F.col("m.line") > 0))
    return _out(rows, key, rule, F.col("file"), F.col("m.line"), F.col("m.endLine"), F.when(fatal, "major").when(hard, "minor").otherwise("info"), category, F.when(fatal, 0.5).when(hard, 0.4).otherwise(0.3), F.col("m.message"))


def tsc(reports: DataFrame, key: str, text: str) -> DataFrame:
    """Compiler messages of the form file(line,column): error TS1: text; indented lines behind one belong to its text."""
    head = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$"
    # a report is cut before its heads: what lies behind a head is its message's, what lies before the first is no one's
    ahead = r"\r?\n(?=.+?\(\d+,\d+\): (?:error|warning) TS\d+: .*[\r\u0085\u2028\u2029]?(?:\r?\n|$))"
    parts = reports.select(key, F.explode(F.split(text, ahead, -1)).alias("part"))
    lines = parts.select(key, F.split("part", "\r?\n", -1).alias("lines")).select(key, F.get("lines", F.lit(0)).alias("line"), F.slice("lines", 2, F.size("lines")).alias("rest"))
    more = F.transform(F.filter("rest", lambda x: x.rlike(r"^\s+\S")), lambda x: F.trim(x))
    each = lines.filter(F.col("line").rlike(head)).select(key, "line", more.alias("more"))
    part = lambda k: F.regexp_extract("line", head, k)
    first = part(6)
    # a message takes in further lines while it has fewer than 400 characters
    message = F.aggregate("more", first, lambda m, x: F.when(F.length(m) < 400, F.concat(m, F.lit(" "), x)).otherwise(m))
    return _out(each, key, part(5), part(1), part(2), F.lit(None), F.when(part(4) == "error", "major").otherwise("minor"), F.lit("bug"), F.lit(0.55), message)


def golangci(reports: DataFrame, key: str, text: str) -> DataFrame:
    rows = _json(reports, text, "struct<Issues:array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:long>>>>").select(key, F.explode("_j.Issues").alias("r"))
    linter = F.col("r.FromLinter")
    secure = linter == "gosec"
    return _out(rows.filter(~linter.isin(*GO_STYLE)), key, linter, F.col("r.Pos.Filename"), F.col("r.Pos.Line"), F.lit(None), F.when(secure, "major").otherwise("minor"), F.when(secure, "security").when(linter == "errcheck", "error-handling").otherwise("bug"), F.lit(0.45), F.col("r.Text"))


def phpstan(reports: DataFrame, key: str, text: str) -> DataFrame:
    rows = _json(reports, text, "struct<files:map<string,struct<messages:array<struct<message:string,line:long>>>>>").select(key, F.explode("_j.files").alias("file", "f")).select(key, "file", F.explode("f.messages").alias("m"))
    return _out(rows.filter("m.line > 0"), key, F.lit("phpstan"), F.col("file"), F.col("m.line"), F.lit(None), F.lit("major"), F.lit("bug"), F.lit(0.45), F.col("m.message"))


def semgrep(reports: DataFrame, key: str, text: str) -> DataFrame:
    schema = "struct<results:array<struct<check_id:string,path:string,start:struct<line:long>,end:struct<line:long>,extra:struct<message:string,severity:string,metadata:struct<category:string,cwe:string,confidence:string>>>>>"
    rows = _json(reports, text, schema).select(key, F.explode("_j.results").alias("r"))
    level, sure = F.upper("r.extra.severity"), F.upper("r.extra.metadata.confidence")
    kind = F.col("r.extra.metadata.category")
    category = F.when((kind == "security") | F.col("r.extra.metadata.cwe").isNotNull(), "security").when(kind == "performance", "performance").otherwise("bug")
    confidence = F.when(sure == "HIGH", 0.6).when(sure == "LOW", 0.3).otherwise(0.45)
    return _out(rows, key, F.col("r.check_id"), F.col("r.path"), F.col("r.start.line"), F.col("r.end.line"), F.when(level == "ERROR", "major").when(level == "WARNING", "minor").otherwise("info"), category, confidence, F.coalesce("r.extra.message", "r.check_id"))


def osv(reports: DataFrame, key: str, text: str, manifests: DataFrame) -> DataFrame:
    """Vulnerable packages at the changed lines of their manifest that name them. manifests: file, line, content (of changed lines)."""
    schema = "struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,groups:array<struct<max_severity:string>>,vulnerabilities:array<struct<id:string,summary:string,database_specific:struct<severity:string>>>>>>>>"
    rows = _json(reports, text, schema).select(key, F.explode("_j.results").alias("r")).select(key, F.col("r.source.path").alias("source"), F.explode("r.packages").alias("p")).filter(F.size("p.vulnerabilities") > 0)
    score = F.array_max(F.transform("p.groups", lambda g: F.regexp_extract(F.coalesce(g["max_severity"], F.lit("")), r"^\s*([0-9.]+)", 1).try_cast("double")))
    levels = F.transform("p.vulnerabilities", lambda v: F.upper(v["database_specific"]["severity"]))
    by_text = F.when(F.array_contains(levels, "CRITICAL"), "critical").when(F.array_contains(levels, "HIGH"), "major").when(F.arrays_overlap(levels, F.array(F.lit("MODERATE"), F.lit("MEDIUM"))), "minor").when(F.array_contains(levels, "LOW"), "info").otherwise("major")
    ids = F.array_sort(F.transform("p.vulnerabilities", lambda v: v["id"]))
    named = rows.select(key, "source", F.col("p.package.name").alias("name"), F.coalesce("p.package.version", F.lit("")).alias("version"), F.when(score.isNotNull(), score_severity(score)).otherwise(by_text).alias("severity"), ids.alias("ids"))
    # a name stands between the characters that manifests put around it: both sides are cut there and joined by equality
    words = manifests.select("file", "line", F.explode(F.array_distinct(F.split("content", r"[\s\"'/:=@<>~^!,\]]+", -1))).alias("name"))
    met = named.join(words, "name").filter(F.col("file") == F.col("source"))
    message = F.concat(F.lit("Dependency "), "name", F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise(""), F.lit(" has known vulnerabilities: "), F.array_join(F.slice("ids", 1, 5), ", "))
    return _out(met, key, F.coalesce(F.get("ids", F.lit(0)), F.lit("osv")), F.col("file"), F.col("line"), F.lit(None), F.col("severity"), F.lit("security"), F.lit(0.7), message, True)


_SARIF = """struct<runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string,shortDescription:struct<text:string>,defaultConfiguration:struct<level:string>,properties:struct<`security-severity`:string,precision:string,tags:array<string>>>>>>,
results:array<struct<ruleId:string,ruleIndex:int,rule:struct<id:string,index:int>,level:string,message:struct<text:string,markdown:string>,properties:struct<`security-severity`:string,tags:array<string>>,
locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long,endLine:long>>>>>>>>>"""
# Tags of rules that are about style, and of those about security.
_STYLE = r"(?i)^(?:style|stylistic|convention|readability|maintainability|formatting|naming|documentation)$"
_SECURE = r"(?i)^(?:security|external/cwe/cwe-\d+|cwe-\d+|owasp.*)$"


def sarif(reports: DataFrame, key: str, text: str, confidence: float = 0.4) -> DataFrame:
    """SARIF 2.1.0 logs; a result's rule is found by its id, then by its number. Rules that are tagged as style only are left out."""
    runs = _json(reports, text, _SARIF).select(key, F.explode("_j.runs").alias("_run"))
    runs = runs.select(key, F.col("_run.tool.driver.rules").alias("_rules"), F.col("_run.results").alias("_results")).withColumn("_ids", F.transform("_rules", lambda x: x["id"]))

    def with_rule(r: Column) -> Column:
        named = lambda c: F.get("_rules", F.when(F.array_position("_ids", c) > 0, F.array_position("_ids", c) - 1).cast("int"))
        at = F.coalesce(r["ruleIndex"], r["rule"]["index"])
        return F.struct(r.alias("r"), F.coalesce(named(r["ruleId"]), named(r["rule"]["id"]), F.when(at >= 0, F.get("_rules", at))).alias("rule"))

    # a result meets its rule inside its run's row, so that no row carries the run's whole table of rules
    rows = runs.select(key, F.explode(F.transform("_results", with_rule)).alias("_x")).select(key, "_x.r", "_x.rule")
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    rows = rows.select("*", F.coalesce("r.ruleId", "r.rule.id", "rule.id", F.lit("unknown")).alias("rule_id"), place["artifactLocation"]["uri"].alias("uri"), F.greatest(F.lit(1), F.coalesce(place["region"]["startLine"], F.lit(1))).alias("start"), place["region"]["endLine"].alias("last"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("tags", F.concat(F.coalesce("r.properties.tags", none), F.coalesce("rule.properties.tags", none)))
    score = F.coalesce(F.col("r.properties.security-severity").try_cast("double"), F.col("rule.properties.security-severity").try_cast("double"))
    level = F.coalesce("r.level", "rule.defaultConfiguration.level")
    level = F.when(level.isin("error", "warning", "note", "none"), level).otherwise("warning")
    any_tag = lambda pattern: F.exists("tags", lambda t: t.rlike(pattern))
    style = any_tag(_STYLE) & ~any_tag(_SECURE) & ~any_tag("(?i)correctness|bug|reliability")
    category = F.when(score.isNotNull() | any_tag(_SECURE), "security").when(any_tag("(?i)performance"), "performance").when(any_tag("(?i)concurren|thread|race"), "concurrency").when(any_tag("(?i)resource|leak"), "resource-leak").when(any_tag("(?i)error.?handling|exception"), "error-handling").otherwise("bug")
    severity = F.when(score.isNotNull(), score_severity(score)).when(level == "error", "major").when(level == "warning", "minor").otherwise("info")
    precise = F.col("rule.properties.precision")
    sure = F.when(precise == "very-high", 0.7).when(precise == "high", 0.6).when(precise == "medium", 0.45).when(precise == "low", 0.3).otherwise(confidence)
    message = F.trim(F.coalesce("r.message.text", "r.message.markdown", "rule.shortDescription.text", "rule_id"))
    return _out(rows.filter(~style), key, F.col("rule_id"), F.col("uri"), F.col("start"), F.greatest("start", F.coalesce("last", "start")), severity, category, sure, message)
