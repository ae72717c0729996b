"""Queries that score reviews against expected defects, and tables of judged evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.operators import evaluation
from gleanline.operators.graph import cut
from gleanline.plans.facts import SQL, findings, table
from gleanline.plans.registry import query

_NOTES = "CASE o_custkey % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget broken' WHEN 2 THEN 'blue bolt' END"
#: Two expected defects for every third order, the second optional now and then, each with a second place.
_DEFECT = f"""SELECT o_orderkey AS "case", d AS defect, 1 + (o_custkey * (3 * d + 1)) % 60 AS s, CASE (o_custkey + d) % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'minor' END AS severity, {_NOTES} AS note, d = 1 AND o_orderkey % 2 = 0 OR o_orderkey % 15 = 0 AS optional"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9_]+'), lambda x: length(x) > 2))"
_LIKE = "coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0)"


def _matching(prefix: str, rows: str, defects: str) -> str:
    """WITH parts {prefix}_fit (all pairs), {prefix}_m (matched), {prefix}_role (all findings) of rows (case, id, start, end, title, confidence)."""
    p = prefix
    return f"""{p}_pair AS (SELECT r."case", r.id, d.defect, r.start, r."end", r.title, r.confidence, {_LIKE.format(a=_WORDS.format('r.title'), b=_WORDS.format('d.note'))} >= {evaluation.ON_TOPIC} AS topic,
    greatest(0, greatest(r.start, d.lo) - least(r."end", d.hi)) AS gap, greatest(0, least(r."end", d.hi) - greatest(r.start, d.lo) + 1)::DOUBLE / (greatest(r."end", d.hi) - least(r.start, d.lo) + 1)::DOUBLE AS iou
  FROM {rows} r JOIN {defects} d ON d."case" = r."case" AND r.start <= d.hi + 3 AND r."end" >= d.lo - 3),
{p}_fit AS (SELECT * FROM {p}_pair QUALIFY row_number() OVER (PARTITION BY "case", id, defect ORDER BY gap, iou DESC) = 1),
{p}_k AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY topic DESC, gap, iou DESC, confidence DESC, id, defect) AS k FROM {p}_fit),
{p}_g AS (SELECT DISTINCT "case", 0::BIGINT AS k, []::BIGINT[] AS ds, []::VARCHAR[] AS fs FROM {p}_k UNION ALL
  SELECT g."case", q.k, CASE WHEN list_contains(g.ds, q.defect) OR list_contains(g.fs, q.id) THEN g.ds ELSE list_append(g.ds, q.defect) END, CASE WHEN list_contains(g.ds, q.defect) OR list_contains(g.fs, q.id) THEN g.fs ELSE list_append(g.fs, q.id) END
  FROM {p}_g g JOIN {p}_k q ON q."case" = g."case" AND q.k = g.k + 1),
{p}_m AS (SELECT "case", unnest(ds) AS defect, unnest(fs) AS id FROM (SELECT "case", arg_max(ds, k) AS ds, arg_max(fs, k) AS fs FROM {p}_g GROUP BY "case")),
{p}_first AS (SELECT * FROM {p}_k QUALIFY row_number() OVER (PARTITION BY "case", id ORDER BY k) = 1),
{p}_role AS (SELECT r."case", r.id, coalesce(m.defect, b.defect) AS defect, CASE WHEN m.id IS NOT NULL THEN 'matched' WHEN b.id IS NULL THEN 'unmatched'
    WHEN (r.start = w.start AND r."end" = w."end") OR {_LIKE.format(a=_WORDS.format('r.title'), b=_WORDS.format('w.title'))} >= {evaluation.REPEAT} THEN 'duplicate' ELSE 'nearby' END AS role
  FROM {rows} r LEFT JOIN {p}_m m USING ("case", id) LEFT JOIN {p}_first b USING ("case", id) LEFT JOIN {p}_m o ON o."case" = b."case" AND o.defect = b.defect LEFT JOIN {rows} w ON w."case" = o."case" AND w.id = o.id)"""


_DEFECTS = f"""dd AS ({_DEFECT} FROM orders, (VALUES (0), (1)) t(d) WHERE o_orderkey % 3 = 0),
dr AS (SELECT *, s AS lo, s + 3 AS hi FROM dd UNION ALL SELECT *, s + 20, s + 22 FROM dd),
fr AS (SELECT *, file AS "case" FROM f WHERE part % 5 <> 0), fx AS (SELECT *, file AS "case" FROM f WHERE part % 5 = 0)"""
_MATCH = f"WITH RECURSIVE {SQL}, {_DEFECTS}, {_matching('m', 'fr', 'dr')}"
_SCORE = f"""{_MATCH}, ms AS (SELECT * FROM dr WHERE NOT optional AND NOT EXISTS (SELECT 1 FROM m_m WHERE m_m."case" = dr."case" AND m_m.defect = dr.defect)), {_matching('l', 'fx', 'ms')},
c AS (SELECT DISTINCT file AS "case" FROM f),
w AS (SELECT "case", count(*) FILTER (NOT optional) AS expected FROM dd GROUP BY ALL),
q AS (SELECT r."case", count(*) FILTER (role = 'matched' AND NOT optional) AS found, count(*) FILTER (role = 'matched' AND optional) AS acceptable,
    count(*) FILTER (role = 'matched' AND NOT optional AND CASE r2.severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END > CASE d.severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END) AS underrated,
    count(*) FILTER (role = 'duplicate') AS duplicates, count(*) FILTER (role = 'nearby') AS nearby, count(*) FILTER (role = 'unmatched') AS leftover
  FROM m_role r JOIN fr r2 USING ("case", id) LEFT JOIN dd d ON d."case" = r."case" AND d.defect = r.defect GROUP BY ALL),
lo AS (SELECT "case", count(*) AS lost FROM l_m GROUP BY ALL),
sa AS (SELECT "case", count(*) AS saved FROM fx WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr."case" = fx."case" AND fx.start <= dr.hi + 3 AND fx."end" >= dr.lo - 3) GROUP BY ALL),
z AS (SELECT "case", coalesce(expected, 0) = 0 AS clean, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, coalesce(expected, 0) - coalesce(found, 0) AS missed, CASE WHEN coalesce(expected, 0) = 0 THEN 0 ELSE coalesce(leftover, 0) END AS unexpected,
    CASE WHEN coalesce(expected, 0) = 0 THEN coalesce(leftover, 0) ELSE 0 END AS false_positives, coalesce(duplicates, 0) AS duplicates, coalesce(nearby, 0) AS nearby, coalesce(acceptable, 0) AS acceptable, coalesce(underrated, 0) AS underrated, coalesce(lost, 0) AS lost, coalesce(saved, 0) AS saved
  FROM c LEFT JOIN w USING ("case") LEFT JOIN q USING ("case") LEFT JOIN lo USING ("case") LEFT JOIN sa USING ("case"))"""
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in evaluation.COUNTS)
_RATIOS = """found::DOUBLE / nullif(expected, 0) AS recall, found::DOUBLE / nullif(found + unexpected + false_positives, 0) AS precision_,
  CASE WHEN expected > 0 THEN CASE WHEN found = 0 THEN 0.0::DOUBLE ELSE 2 * (found::DOUBLE / expected) * (found::DOUBLE / (found + unexpected + false_positives)) / (found::DOUBLE / expected + found::DOUBLE / (found + unexpected + false_positives)) END END AS f1,
  (found + lost)::DOUBLE / nullif(expected, 0) AS raw_recall, (found + lost)::DOUBLE / nullif(found + lost + unexpected + false_positives + saved, 0) AS raw_precision"""


def defects(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    spot = lambda lo, hi: F.struct(F.concat(F.lit("./src/../src/"), F.col("case").cast("string")).alias("file"), lo.alias("start"), hi.alias("end"))
    s = F.expr("1 + (o_custkey * (3 * d + 1)) % 60")
    named = rows.select(F.col("o_orderkey").alias("case"), F.col("d").alias("defect"), s.alias("s"), F.expr("case (o_custkey + d) % 3 when 0 then 'critical' when 1 then 'major' else 'minor' end").alias("severity"), F.expr(_NOTES).alias("note"), F.expr("d = 1 AND o_orderkey % 2 = 0 OR o_orderkey % 15 = 0").alias("optional"))
    return named.select("case", "defect", "severity", "note", "optional", F.array(spot(F.col("s"), F.col("s") + 3), spot(F.col("s") + 20, F.col("s") + 22)).alias("spots"))


def cases(spark, sf_dir):
    return findings(spark, sf_dir).withColumn("case", F.col("file")).withColumn("file", F.concat(F.lit("src\\"), F.col("file").cast("string")))


def scores(spark, sf_dir):
    rows = cases(spark, sf_dir)
    return evaluation.score(rows, rows.filter("part % 5 <> 0"), rows.filter("part % 5 = 0"), defects(spark, sf_dir))


@query("matched_findings", f'{_MATCH} SELECT "case", id, defect, role FROM m_role')
def matched_findings(spark, sf_dir):
    return evaluation.match(cases(spark, sf_dir).filter("part % 5 <> 0"), defects(spark, sf_dir))


@query("case_scores", f"{_SCORE} SELECT * FROM z")
def case_scores(spark, sf_dir):
    return scores(spark, sf_dir)


@query("suite_metrics", f'{_SCORE}, s AS (SELECT "case" % 4 AS suite, {_SUMS} FROM z GROUP BY ROLLUP ("case" % 4)) SELECT *, {_RATIOS} FROM s')
def suite_metrics(spark, sf_dir):
    """The micro average by suite and in total."""
    rows = scores(spark, sf_dir).withColumn("suite", F.expr("case % 4"))
    # the total is of the suites' sums, so the cases are scored once
    suites = cut(evaluation.aggregate(rows, ["suite"]))
    return suites.unionByName(evaluation.aggregate(suites).withColumn("suite", F.lit(None).cast("long")))


@query("pass_spread", f"""{_SCORE}, p AS (SELECT "case" % 10 % 3 + 1 AS pass_, sum(found)::DOUBLE / nullif(sum(expected), 0) AS recall FROM z WHERE "case" % 8 <> 0 GROUP BY ALL)
SELECT (SELECT count(*) FROM z) AS cases, (SELECT count(*) FROM z WHERE clean) AS clean_cases, (SELECT count(*) FROM z WHERE clean AND "case" % 8 <> 0) AS clean_runs, (SELECT count(*) FROM z WHERE clean AND false_positives > 0 AND "case" % 8 <> 0) AS flagged_clean_runs, min(recall) AS recall_min, max(recall) AS recall_max FROM p""")
def pass_spread(spark, sf_dir):
    """How far the passes over a corpus lie apart; interrupted runs do not count."""
    rows = scores(spark, sf_dir).withColumn("counted", F.expr("case % 8 <> 0")).withColumn("pass_", F.expr("case % 10 % 3 + 1"))
    of = lambda c: F.sum(F.when(F.col("counted"), F.col(c)))
    per_pass = rows.groupBy("pass_").agg(
        T.ratio(of("found"), of("expected")).alias("recall"), F.count(F.lit(1)).alias("cases"), F.count_if("clean").alias("clean_cases"),
        F.count_if(F.expr("clean AND counted")).alias("clean_runs"), F.count_if(F.expr("clean AND counted AND false_positives > 0")).alias("flagged_clean_runs"),
    )
    sums = [F.sum(c).alias(c) for c in ("cases", "clean_cases", "clean_runs", "flagged_clean_runs")]
    return per_pass.agg(*sums, F.min("recall").alias("recall_min"), F.max("recall").alias("recall_max"))


_JUDGED = "SELECT l_orderkey % 40 AS repo, l_orderkey AS url, CASE l_partkey % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'style' ELSE 'docs' END AS category, CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, CASE l_linenumber % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fn' ELSE 'fp' END AS outcome FROM lineitem"


def judged(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 40 AS repo", "l_orderkey AS url", "CASE l_partkey % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'style' ELSE 'docs' END AS category", "CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity", "CASE l_linenumber % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fn' ELSE 'fp' END AS outcome")


#: Profiles: the categories whose expected comments count.
PROFILES = {"core": ["bug", "security"], "all": ["bug", "security", "style", "docs"]}


@query("profile_scores", f"WITH j AS ({_JUDGED}), p AS (SELECT 'core' AS profile, * FROM j WHERE outcome = 'fp' OR category IN ('bug', 'security') UNION ALL SELECT 'all', * FROM j), c AS (SELECT profile, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM p GROUP BY profile) SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision_, tp::DOUBLE / nullif(tp + fn, 0) AS recall, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM c")
def profile_scores(spark, sf_dir):
    """Precision and recall by profile: expected comments of other categories don't count, false positives always do."""
    rows = judged(spark, sf_dir)
    counts = [F.struct(F.lit(name).alias("profile"), ((F.col("outcome") == "fp") | F.col("category").isin(*kinds)).alias("counts")) for name, kinds in PROFILES.items()]
    each = rows.select("outcome", F.explode(F.filter(F.array(*counts), lambda p: p["counts"])).alias("p"))
    c = each.groupBy(F.col("p.profile").alias("profile")).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", T.ratio(tp, tp + fp).alias("precision_"), T.ratio(tp, tp + fn).alias("recall"), T.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("recall_breakdown", f"WITH j AS ({_JUDGED}) SELECT category, severity, repo, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'tp')::DOUBLE / nullif(count(*) FILTER (outcome IN ('tp', 'fn')), 0) AS recall FROM j GROUP BY GROUPING SETS ((category), (severity), (repo), ())")
def recall_breakdown(spark, sf_dir):
    rows = judged(spark, sf_dir)
    tp, fn = F.count_if(F.col("outcome") == "tp"), F.count_if(F.col("outcome") == "fn")
    sets = [[F.col("category")], [F.col("severity")], [F.col("repo")], []]
    return rows.groupingSets(sets, F.col("category"), F.col("severity"), F.col("repo")).agg(tp.alias("tp"), fn.alias("fn"), T.ratio(tp, tp + fn).alias("recall"))


@query("judging_report", "WITH b AS (SELECT l_linenumber % 2 AS judging, l_orderkey % 5 AS level, l_suppkey % 3 AS source, l_partkey % 3 = 0 AS semantic, l_partkey % 3 = 0 AND l_quantity > 20 AS line FROM lineitem), s AS (SELECT judging, level, source, count(*) AS expected, count(*) FILTER (semantic) AS semantic, count(*) FILTER (line) AS line FROM b GROUP BY judging, GROUPING SETS ((level), (source), ())) SELECT level, source, avg(expected) AS expected, avg(semantic) AS semantic, avg(line) AS line FROM s GROUP BY ALL")
def judging_report(spark, sf_dir):
    """Expected, semantic and line matches in all, by level and by source, averaged over the judgings."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber % 2 AS judging", "l_orderkey % 5 AS level", "l_suppkey % 3 AS source", "l_partkey % 3 = 0 AS semantic", "l_partkey % 3 = 0 AND l_quantity > 20 AS line")
    j, level, source = F.col("judging"), F.col("level"), F.col("source")
    sums = rows.groupingSets([[j, level], [j, source], [j]], j, level, source).agg(F.count(F.lit(1)).alias("expected"), F.count_if("semantic").alias("semantic"), F.count_if("line").alias("line"))
    return sums.groupBy("level", "source").agg(*(F.avg(c).alias(c) for c in ("expected", "semantic", "line")))


@query("best_candidates", "WITH g AS (SELECT o_orderkey AS url, unnest([0, 1]) AS golden FROM orders), c AS (SELECT DISTINCT l_orderkey AS url, l_partkey AS candidate FROM lineitem), p AS (SELECT g.url, golden, candidate, ((candidate * 31 + golden * 17) % 97)::DOUBLE / 97::DOUBLE AS confidence FROM g JOIN c USING (url)) SELECT url, golden, candidate, confidence FROM p WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY url, golden ORDER BY confidence DESC, candidate) = 1")
def best_candidates(spark, sf_dir):
    """Each golden comment against the candidates of its pull request: the surest that is sure enough."""
    golden = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.explode(F.array(F.lit(0), F.lit(1))).alias("golden"))
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_partkey").alias("candidate")).distinct()
    pairs = golden.join(candidates, "url").withColumn("confidence", F.expr("cast((candidate * 31 + golden * 17) % 97 as double)") / 97).filter("confidence >= 0.5")
    best = pairs.groupBy("url", "golden").agg(F.max(F.struct("confidence", (-F.col("candidate")).alias("c"))).alias("m"))
    return best.select("url", "golden", (-F.col("m.c")).alias("candidate"), F.col("m.confidence").alias("confidence"))


@query("note_labels", "WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, left(repeat(concat(p_name, ' '), 9), 80) AS prefix FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT DISTINCT p_partkey, left(repeat(concat(p_name, ' '), 9), 80) AS prefix, p_brand FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(k.p_brand, '?') AS label, count(*) AS n FROM n LEFT JOIN k ON k.p_partkey = n.l_partkey AND k.prefix = n.prefix GROUP BY 1")
def note_labels(spark, sf_dir):
    """Labels looked up by a key and the first 80 characters of a note; '?' where there is none."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr("left(repeat(concat(p_name, ' '), 9), 80)").alias("prefix"))
    notes = table(spark, sf_dir, "lineitem").select("l_partkey").join(parts.select(F.col("p_partkey").alias("l_partkey"), "prefix"), "l_partkey")
    known = parts.filter("p_partkey % 3 = 0").distinct().withColumnRenamed("p_partkey", "l_partkey")
    return notes.join(known, ["l_partkey", "prefix"], "left").groupBy(F.coalesce("p_brand", F.lit("?")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
