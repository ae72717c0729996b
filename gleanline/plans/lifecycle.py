"""Queries over the life of findings: validation, verdicts, hits, fingerprints, publication, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.operators import findings as ops
from gleanline.plans.facts import RANK, SQL, files, findings, table
from gleanline.plans.registry import query

_NEAR = "(whole IS NULL OR whole OR (start <= b1 + {k} AND {end} >= a1 - {k}) OR (start <= b2 + {k} AND {end} >= a2 - {k}))"
_END = 'least("end", n_lines)'


@query("finding_validation", f"WITH {SQL} SELECT id, least(\"end\", coalesce(n_lines, \"end\")) AS end_line, CASE WHEN n_lines IS NULL THEN 'unknown-file' WHEN start > n_lines THEN 'line-out-of-range' WHEN NOT {_NEAR.format(k=ops.FINDING_SLACK, end=_END)} THEN 'outside-changed-lines' ELSE 'kept' END AS reason FROM f LEFT JOIN o USING (file)")
def finding_validation(spark, sf_dir):
    rows = ops.validate(findings(spark, sf_dir), files(spark, sf_dir).withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<a:bigint,b:bigint>>"))))
    return rows.select("id", F.col("end").alias("end_line"), F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("failure_paths", f"""WITH {SQL}, p AS (SELECT *, repeat(concat(title, ' '), (part % 4)::INT) AS path, part % 5 = 0 AS static FROM f)
SELECT id, severity IN ('critical', 'major') AND NOT static AND length(trim(path)) < {ops.MIN_PATH} AS lowered, CASE WHEN severity NOT IN ('critical', 'major') OR static OR length(trim(path)) >= {ops.MIN_PATH} THEN severity WHEN severity = 'critical' THEN 'major' ELSE 'minor' END AS severity FROM p""")
def failure_paths(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("failure_path", F.expr("repeat(concat(title, ' '), cast(part % 4 as int))")).withColumn("origin", F.expr("if(part % 5 = 0, 'static', 'model')"))
    return ops.require_path(rows).select("id", "lowered", "severity")


@query("replacements", f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, 1 + doc_id % 5 AS s, 1 + doc_id % 5 + doc_id % 34 AS e FROM documents),
r AS (SELECT *, array_to_string(ls[s:e], chr(10)) AS old FROM d), n AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN concat(old, chr(10)) WHEN 1 THEN concat(old, ' ```') WHEN 2 THEN repeat(concat('x', chr(10)), (doc_id % 90)::INT) WHEN 3 THEN concat('new ', old) END AS new FROM r)
SELECT doc_id, new IS NULL OR coalesce(e - s + 1 BETWEEN 1 AND {ops.MAX_REPLACED} AND NOT contains(new, '```') AND NOT contains(new, chr(13)) AND len(string_split(CASE WHEN ends_with(new, chr(10)) THEN left(new, length(new) - 1) ELSE new END, chr(10))) <= {ops.MAX_REPLACEMENT} AND CASE WHEN ends_with(new, chr(10)) THEN left(new, length(new) - 1) ELSE new END <> old, false) AS usable FROM n""")
def replacements(spark, sf_dir):
    """Replacements made from documents: equal, fenced, too long, changed and missing ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"), F.expr("1 + doc_id % 5").alias("s"), F.expr("1 + doc_id % 5 + doc_id % 34").alias("e"))
    old = F.array_join(F.slice("ls", F.col("s").cast("int"), (F.col("e") - F.col("s") + 1).cast("int")), "\n")
    rows = rows.withColumn("old", old).withColumn("new", F.expr("case doc_id % 5 when 0 then concat(old, '\\n') when 1 then concat(old, ' ```') when 2 then repeat('x\\n', cast(doc_id % 90 as int)) when 3 then concat('new ', old) end"))
    return rows.select("doc_id", ops.usable_replacement(F.col("new"), F.col("s"), F.col("e"), F.col("ls")).alias("usable"))


_VERDICT = "CASE (part + supp) % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'uncertain' END"


@query("verdicts", f"""WITH {SQL}, v AS (SELECT id, CASE WHEN part % 9 = 1 THEN 'confirmed' ELSE {_VERDICT} END AS verdict, CASE WHEN part % 9 = 1 THEN 0.9 ELSE (part % 50)::DOUBLE / 100::DOUBLE END AS vc, CASE WHEN part % 9 <> 1 AND supp % 6 = 0 THEN 'minor' END AS vs FROM f WHERE part % 4 <> 0),
m AS (SELECT f.*, coalesce(v.verdict, 'uncertain') AS verdict, coalesce(vc, confidence) AS c, vs FROM f LEFT JOIN v USING (id))
SELECT id, verdict <> 'rejected' OR non_rejectable AS kept, CASE WHEN verdict = 'rejected' AND non_rejectable THEN 'uncertain' ELSE verdict END AS verdict,
  CASE WHEN verdict = 'rejected' AND non_rejectable THEN coalesce(vs, 'info') ELSE coalesce(vs, severity) END AS severity, CASE WHEN verdict = 'rejected' AND non_rejectable THEN greatest(c, 0.5) ELSE c END::DOUBLE AS confidence FROM m""")
def verdicts(spark, sf_dir):
    """A critic's verdicts on three of four findings, some of them overruled by a second opinion."""
    rows = findings(spark, sf_dir)
    first = rows.filter("part % 4 <> 0").select("id", F.expr(_VERDICT).alias("verdict"), (F.expr("part % 50").cast("double") / 100).alias("v_confidence"), F.expr("if(supp % 6 = 0, 'minor', null)").alias("v_severity"))
    second = rows.filter("part % 4 <> 0 AND part % 9 = 1").select("id", F.lit("confirmed").alias("verdict"), F.lit(0.9).alias("v_confidence"), F.lit(None).cast("string").alias("v_severity"))
    return ops.merge_verdicts(rows, first, second).select("id", "kept", "verdict", "severity", "confidence")


@query("second_opinions", f"WITH {SQL} SELECT severity, count(*) AS n FROM f WHERE confidence >= 0.6 - 0.1 AND confidence < 0.6 + 0.15 GROUP BY severity")
def second_opinions(spark, sf_dir):
    return findings(spark, sf_dir).filter(ops.second_opinion(F.col("confidence"), 0.6)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


_FINAL = f"""v AS (SELECT f.* EXCLUDE ("end", confidence), least(n_lines, greatest(start, "end")) AS "end", CASE WHEN part % 6 = 0 THEN 'shared' ELSE concat(analyzer, ':', rule_id) END AS k,
  floor(greatest(0.05, least(0.95, greatest(0.05, confidence)) * CASE WHEN NOT is_test THEN 1.0::DOUBLE WHEN category = 'security' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END) * 100 + 0.5) / 100::DOUBLE AS confidence
  FROM f JOIN o USING (file) WHERE start <= n_lines AND {_NEAR.format(k=ops.HIT_SLACK, end='least(n_lines, greatest(start, "end"))')}),
c AS (SELECT * FROM v QUALIFY non_rejectable OR row_number() OVER (PARTITION BY file, analyzer, rule_id, non_rejectable ORDER BY start, "end", title) <= 2),
z AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file, start, k ORDER BY {RANK}, confidence DESC, non_rejectable DESC, concat(analyzer, ':', rule_id), "end", title) = 1)"""


def final_hits(spark, sf_dir):
    hits = findings(spark, sf_dir).withColumn("message", F.col("title")).withColumn("dedupe_key", F.expr("if(part % 6 = 0, 'shared', null)"))
    return ops.finalize_hits(hits, files(spark, sf_dir), 2)


@query("hit_list", f"""WITH {SQL}, {_FINAL} SELECT file, start, analyzer, rule_id, severity, confidence, title, concat('H', row_number() OVER (PARTITION BY run ORDER BY file, start, analyzer, rule_id, "end", title)) AS hit_id FROM z""")
def hit_list(spark, sf_dir):
    return ops.number_hits(final_hits(spark, sf_dir), "run").select("file", "start", "analyzer", "rule_id", "severity", "confidence", "title", "hit_id")


@query("chunk_hints", f"""WITH {SQL}, {_FINAL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY non_rejectable DESC, {RANK}, confidence DESC, file, start, rule_id, "end", title) AS place_no FROM z)
SELECT file, start, rule_id, title, CASE WHEN place_no <= 12 THEN 'shown' ELSE 'overflow' END AS place FROM r WHERE place_no <= 12 OR non_rejectable""")
def chunk_hints(spark, sf_dir):
    return ops.hints_for_chunk(final_hits(spark, sf_dir), "run", 12).select("file", "start", "rule_id", "title", "place")


@query("unique_fingerprints", f"""WITH {SQL}, b AS (SELECT *, sha256(concat(category, chr(0), part % 40))[1:32] AS fp FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY run, fp ORDER BY {RANK}, start, title, id) = 1 AS first_ FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY run, fp, title, first_ ORDER BY {RANK}, start, id) AS n FROM k)
SELECT id, CASE WHEN first_ THEN fp ELSE sha256(concat('1', chr(0), 'dup', chr(0), fp, chr(0), lower(title), chr(0), n))[1:32] END AS fingerprint FROM n""")
def unique_fingerprints(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("\u0000", "category", F.expr("string(part % 40)")), 256), 1, 32))
    return ops.unique_fingerprints(rows, "run").select("id", F.col("unique_fp").alias("fingerprint"))


_HUNK = '((start >= greatest(1, a1 - 3) AND "end" <= b1 + 3) OR (start >= a2 - 3 AND "end" <= b2 + 3))'
_FIRST = 'least(CASE WHEN a1 <= "end" AND b1 >= start THEN greatest(a1, start) END, CASE WHEN a2 <= "end" AND b2 >= start THEN greatest(a2, start) END)'
_PLAN = f"""p AS (SELECT f.*, part % 17 = 0 AS posted, run % 29 = 0 AS stale, NOT coalesce(whole, true) AS has_diff, CASE WHEN NOT coalesce(whole, true) AND {_HUNK} THEN coalesce({_FIRST}, start) END AS anchor FROM f LEFT JOIN o USING (file)),
w AS (SELECT *, CASE WHEN posted THEN 'already-posted' WHEN stale THEN 'stale' WHEN severity = 'info' THEN 'severity' WHEN NOT has_diff THEN 'no-diff' WHEN anchor IS NULL THEN 'outside-diff' END AS reason FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY run, reason IS NULL ORDER BY {RANK}, confidence DESC, file, start, id) AS k FROM w)"""


@query("publication", f"WITH {SQL}, {_PLAN} SELECT id, anchor, coalesce(reason, CASE WHEN k > 10 THEN 'limit' ELSE 'inline' END) AS placement FROM k")
def publication(spark, sf_dir):
    """Where each finding is published: hunks are the changed ranges with three lines of context."""
    rows = findings(spark, sf_dir).join(files(spark, sf_dir).select("file", "ranges"), "file", "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    hunks = F.transform(F.coalesce("ranges", none), lambda r: F.struct(F.greatest(r["a"] - 3, F.lit(1)).alias("a"), (r["b"] + 3).alias("b")))
    at = ops.anchor(F.col("start"), F.col("end"), hunks, F.coalesce("ranges", none))
    rows = rows.select("*", F.expr("part % 17 = 0").alias("posted"), F.expr("run % 29 = 0").alias("stale"), F.col("ranges").isNotNull().alias("has_diff"), at.alias("anchor"))
    return ops.plan_publication(rows, "run", 10, "minor").select("id", "anchor", "placement")


_THREADS = f"""{SQL}, t AS (SELECT id, file, start, "end", part % 400 AS fp FROM f WHERE supp % 2 = 0), cur AS (SELECT file, start, "end", 200 + part % 400 AS fp FROM f WHERE supp % 2 = 1),
fs AS (SELECT file, a1, b1, a2, b2, CASE WHEN file % 11 = 0 THEN 'gone' WHEN file % 11 = 1 THEN 'removed' ELSE 'changed' END AS status, file % 6 <> 0 AS complete FROM o),
h AS (SELECT file, a1 AS os, 4 AS ol, a1 AS ns, 7 AS nl FROM o UNION ALL SELECT file, a2, 0, a2 + 4, 2 FROM o),
l AS (SELECT id, x, coalesce(max(CASE WHEN ol > 0 AND os <= x AND x < os + ol THEN ns END), x + coalesce(sum(CASE WHEN CASE WHEN ol = 0 THEN os < x ELSE os + ol - 1 < x END THEN nl - ol END), 0))::BIGINT AS y
  FROM (SELECT id, file, start AS x FROM t UNION SELECT id, file, "end" FROM t) JOIN h USING (file) GROUP BY id, x),
m AS (SELECT t.*, s.y AS ms, greatest(s.y, e.y) AS me FROM t JOIN l s ON s.id = t.id AND s.x = t.start JOIN l e ON e.id = t.id AND e.x = t."end"),
touched AS (SELECT DISTINCT t.id FROM t JOIN h USING (file) WHERE CASE WHEN ol = 0 THEN os >= start AND os < "end" ELSE os <= "end" AND os + ol - 1 >= start END)"""


def _hunks():
    first = "named_struct('old_start', ranges[0].a, 'old_lines', 4L, 'new_start', ranges[0].a, 'new_lines', 7L)"
    return F.expr(f"array({first}, named_struct('old_start', ranges[1].a, 'old_lines', 0L, 'new_start', ranges[1].a + 4, 'new_lines', 2L))")


def _all_ranges(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("file"), F.array(F.expr("named_struct('a', 1 + o_orderkey % 30, 'b', 6 + o_orderkey % 30)"), F.expr("named_struct('a', 21 + o_orderkey % 30, 'b', 24 + o_orderkey % 30)")).alias("ranges"))


@query("moved_ranges", f"WITH {_THREADS} SELECT m.id, ms AS start_line, me AS end_line, touched.id IS NOT NULL AS touched FROM m LEFT JOIN touched USING (id)")
def moved_ranges(spark, sf_dir):
    """Where commented ranges stand in the new text of their file."""
    rows = findings(spark, sf_dir).filter("supp % 2 = 0").join(_all_ranges(spark, sf_dir).select("file", _hunks().alias("hunks")), "file")
    low = ops.map_line(F.col("hunks"), F.col("start"))
    return rows.select("id", low.alias("start_line"), F.greatest(low, ops.map_line(F.col("hunks"), F.col("end"))).alias("end_line"), ops.touches(F.col("hunks"), F.col("start"), F.col("end")).alias("touched"))


@query("fixed_threads", f"""WITH {_THREADS}, free AS (SELECT m.*, status, complete FROM m JOIN fs USING (file) WHERE fp NOT IN (SELECT fp FROM cur))
SELECT id, CASE status WHEN 'gone' THEN 'no-longer-changed' WHEN 'removed' THEN 'removed' ELSE 'changed' END AS reason FROM free
WHERE status = 'gone' OR (complete AND (status = 'removed' OR (id IN (SELECT id FROM touched) AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.file = free.file AND cur.start <= me + 3 AND greatest(cur.start, cur."end") >= ms - 3))))""")
def fixed_threads(spark, sf_dir):
    rows = findings(spark, sf_dir)
    threads = rows.filter("supp % 2 = 0").select("id", "file", "start", "end", F.expr("part % 400").alias("fingerprint"))
    current = rows.filter("supp % 2 = 1").select("file", "start", "end", F.expr("200 + part % 400").alias("fingerprint"))
    status = F.expr("case file % 11 when 0 then 'gone' when 1 then 'removed' else 'changed' end")
    return ops.fixed_threads(threads, current, _all_ranges(spark, sf_dir).select("file", status.alias("status"), F.expr("file % 6 <> 0").alias("complete"), _hunks().alias("hunks")))


@query("review_history", f"""WITH {SQL}, p AS (SELECT DISTINCT run, part % 90 AS fp FROM f WHERE supp % 3 = 0), c AS (SELECT DISTINCT run, part % 90 AS fp FROM f WHERE supp % 3 = 1), r AS (SELECT DISTINCT run, part % 90 AS fp FROM f WHERE part % 5 = 0)
SELECT run, fp, CASE WHEN p.fp IS NULL THEN 'added' WHEN c.fp IS NOT NULL THEN 'open' WHEN r.fp IS NOT NULL THEN 'fixed' ELSE 'gone' END AS state FROM p FULL JOIN c USING (run, fp) LEFT JOIN r USING (run, fp)""")
def review_history(spark, sf_dir):
    rows = findings(spark, sf_dir).select("run", F.expr("part % 90").alias("fp"), "supp", "part")
    return ops.since_last(rows.filter("supp % 3 = 0"), rows.filter("supp % 3 = 1"), rows.filter("part % 5 = 0"))


@query("code_fingerprints", r"""WITH d AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT *, left(array_to_string(list_filter(list_transform(ls[1 + doc_id % 7 : least(1 + doc_id % 7 + doc_id % 260, doc_id % 7 + 200)], lambda x: trim(regexp_replace(x, '[ \t-\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), 20000) AS code FROM d)
SELECT doc_id, CASE WHEN code <> '' THEN sha256(concat('1', chr(0), 'code', chr(0), source, chr(0), lang, chr(0), '', chr(0), code))[1:32]
  ELSE sha256(concat('1', chr(0), 'title', chr(0), source, chr(0), lang, chr(0), '', chr(0), left(trim(regexp_replace(lower(concat('Doc  ', doc_id)), '\s+', ' ', 'g')), 500)))[1:32] END AS fingerprint FROM n""")
def code_fingerprints(spark, sf_dir):
    """Each document as a finding on a range of its own lines; without code there, by its title."""
    rows = table(spark, sf_dir, "documents").withColumn("ls", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    start = F.expr("1 + doc_id % 7")
    return rows.select("doc_id", T.finding_fingerprint(F.col("source"), F.col("lang"), F.lit(""), F.concat(F.lit("Doc  "), F.col("doc_id").cast("string")), start, start + F.expr("doc_id % 260"), F.col("ls")).alias("fingerprint"))
