"""Queries over cost, usage, coverage, skills and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.operators import costs, coverage
from gleanline.plans.facts import SQL, findings, table
from gleanline.plans.registry import query

_CALL = [
    ("event_id", "event_id"), ("run", "user_id"), ("ts", "ts"), ("provider", "concat('P', CAST(user_id % 4 AS {s}))"),
    ("model", "CASE WHEN event_id % 7 <> 0 THEN concat('M', CAST(event_id % 5 AS {s})) END"), ("role", "CASE WHEN event_type = 'error' THEN 'critique' ELSE 'review' END"),
    ("input_tokens", "event_id % 5000"), ("cached_tokens", "CASE WHEN event_id % 3 = 0 THEN event_id % 700 END"), ("write_tokens", "CASE WHEN event_id % 4 = 0 THEN event_id % 300 END"), ("output_tokens", "event_id % 900"),
    ("requests", "CASE WHEN event_id % 5 = 0 THEN 2 END"), ("batch", "event_id % 6 = 0"), ("estimated", "event_id % 8 = 0"),
    ("reported", "CASE WHEN user_id % 10 = 3 OR event_id % 17 = 0 THEN CAST(event_id % 100 AS DOUBLE) / CAST(64 AS DOUBLE) END"), ("reported_currency", "CASE WHEN user_id % 10 = 3 OR event_id % 17 = 0 THEN CASE WHEN event_id % 34 = 0 THEN 'EUR' ELSE 'USD' END END"),
]
#: key, input, cached input, cache write, output, request, currency; rates per million tokens.
PRICES = [
    ("p0:m1", 3.0, 0.25, 3.75, 15.0, None, None), ("M1", 2.0, None, None, 8.0, None, "USD"), ("m2", 0.5, None, 1.0, None, None, "EUR"),
    ("P1", None, None, None, None, 0.125, None), ("p2", None, None, None, None, None, None), ("p3:M3", 1.0, 0.5, None, 4.0, 0.0625, "USD"),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in row) + ")" for row in PRICES)
_COSTS = f"""c AS (SELECT {', '.join(f'{e.replace("{s}", "VARCHAR")} AS {n}' for n, e in _CALL)} FROM events),
p(key, input, cached_input, cache_write, output, request, currency) AS (SELECT lower(a), b::DOUBLE, c::DOUBLE, d::DOUBLE, e::DOUBLE, f::DOUBLE, g::VARCHAR FROM (VALUES {_VALUES}) t(a, b, c, d, e, f, g)),
r AS (SELECT c.*, coalesce((SELECT p FROM p WHERE key = lower(concat(provider, ':', model)) AND model IS NOT NULL), (SELECT p FROM p WHERE key = lower(model)), (SELECT p FROM p WHERE key = lower(provider))) AS p FROM c),
t AS (SELECT * EXCLUDE (p), CASE WHEN reported IS NOT NULL THEN reported * 1000000 WHEN p IS NOT NULL AND NOT (input_tokens + coalesce(cached_tokens, 0) + coalesce(write_tokens, 0) + output_tokens > 0 AND p.input IS NULL AND p.output IS NULL AND p.request IS NULL)
    THEN (input_tokens * coalesce(p.input, 0) + coalesce(cached_tokens, 0) * coalesce(p.cached_input, p.input, 0) + coalesce(write_tokens, 0) * coalesce(p.cache_write, coalesce(p.input, 0) * 1.25::DOUBLE) + output_tokens * coalesce(p.output, 0)) * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + coalesce(requests, 1) * coalesce(p.request, 0) * 1000000 END AS amount, p FROM r),
k AS (SELECT * EXCLUDE (p), CASE WHEN reported IS NOT NULL THEN reported_currency WHEN amount IS NOT NULL THEN coalesce(p.currency, 'USD') END AS currency, CASE WHEN reported IS NOT NULL THEN 'reported' WHEN amount IS NOT NULL THEN CASE WHEN estimated AND (p.input IS NOT NULL OR p.output IS NOT NULL) THEN 'estimated' ELSE 'priced' END END AS basis FROM t)"""


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(*(F.expr(e.replace("{s}", "STRING")).alias(n) for n, e in _CALL))


def priced(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "key string, input double, cached_input double, cache_write double, output double, request double, currency string")
    return costs.priced(calls(spark, sf_dir), F.broadcast(prices))  # a configured table of a few routes


@query("call_costs", f"WITH {_COSTS} SELECT event_id, amount, currency, basis FROM k")
def call_costs(spark, sf_dir):
    return priced(spark, sf_dir).select("event_id", "amount", "currency", "basis")


@query("run_costs", f"""WITH {_COSTS}, m AS (SELECT run, arg_min(currency, (ts, event_id)) AS main FROM k WHERE currency IS NOT NULL GROUP BY run)
SELECT run, coalesce(sum(floor(amount + 0.5)) FILTER (currency = main), 0)::BIGINT AS amount, coalesce(max(main), 'USD') AS currency, coalesce(array_to_string(list_sort(list(DISTINCT basis) FILTER (currency = main)), ','), '') AS basis,
  count(*) FILTER (currency IS DISTINCT FROM main OR currency IS NULL) AS unknown, coalesce(array_to_string(list_sort(list(DISTINCT concat_ws(':', provider, model)) FILTER (currency IS DISTINCT FROM main OR currency IS NULL)), ','), '') AS unpriced FROM k LEFT JOIN m USING (run) GROUP BY run""")
def run_costs(spark, sf_dir):
    return costs.meter(priced(spark, sf_dir), "run", ["ts", "event_id"]).withColumn("amount", F.col("amount").cast("long"))


@query("budget_gate", f"""WITH {_COSTS}, s AS (SELECT event_id, role, coalesce(sum(CASE WHEN currency = 'USD' THEN floor(amount + 0.5) END) OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM k)
SELECT event_id, spent < CASE role WHEN 'critique' THEN 400000 ELSE 340000 END AS allowed FROM s""")
def budget_gate(spark, sf_dir):
    return costs.gate(priced(spark, sf_dir), "run", ["ts", "event_id"], 400_000, 0.15).select("event_id", "allowed")


@query("usage_sums", f"WITH {_COSTS} SELECT run % 10 AS run_group, provider, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, sum(requests)::BIGINT AS requests, bool_or(estimated) AS estimated, bool_and(batch) AS batch, CASE WHEN count(reported) = count(*) AND count(DISTINCT reported_currency) = 1 THEN sum(floor(reported * 100 + 0.5))::BIGINT END AS reported_cents FROM c GROUP BY ALL")
def usage_sums(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("run_group", F.expr("run % 10"))
    return costs.sum_usage(rows, ["run_group", "provider"]).withColumn("reported_cents", F.col("reported_cents").cast("long"))


_CHUNKS = "SELECT l_orderkey % 900 AS run, CASE WHEN l_suppkey % 9 = 0 THEN 'failed' ELSE 'done' END AS status, l_linenumber % 3 AS findings, CASE WHEN l_partkey % 41 <> 0 THEN l_partkey % 500 + 1 END AS cents, CASE WHEN l_partkey % 41 <> 0 THEN CASE WHEN l_orderkey % 900 = 7 AND l_linenumber = 1 THEN 'EUR' ELSE 'USD' END END AS currency FROM lineitem"


@query("deepen_advice", f"WITH c AS ({_CHUNKS}) SELECT run, count(*) AS chunks, CASE WHEN bool_and(coalesce(cents > 0, false)) AND count(DISTINCT currency) = 1 AND count(currency) = count(*) THEN sum(cents)::BIGINT * 1.45::DOUBLE END AS estimate FROM c WHERE status = 'done' GROUP BY run HAVING sum(findings) > 0")
def deepen_advice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*(_CHUNKS.removeprefix("SELECT ").removesuffix(" FROM lineitem").split(", ")))
    return costs.deepen_advice(rows, "run")


@query("coverage_map", """WITH u AS (SELECT o_orderkey AS file, o_orderkey % 23 = 0 AS deleted, o_orderkey % 2 = 0 AS in_chunks, o_custkey % 90 AS changed FROM orders WHERE o_orderkey % 13 <> 0),
p AS (SELECT l_orderkey AS file, count(*) FILTER (l_suppkey % 3 = 0) AS done, count(*) FILTER (l_suppkey % 3 = 1) AS interrupted, count(*) FILTER (l_suppkey % 3 = 2) AS failed, bool_or(l_partkey % 10 = 0) AS opened FROM lineitem GROUP BY l_orderkey)
SELECT file, changed, CASE WHEN p.file IS NULL OR done + interrupted = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' WHEN interrupted > 0 THEN 'interrupted' ELSE 'reviewed' END AS status, CASE WHEN p.file IS NULL THEN CASE WHEN in_chunks THEN 'not run' ELSE 'not in any chunk' END END AS reason, coalesce(opened, false) AS opened FROM u LEFT JOIN p USING (file) WHERE NOT deleted
UNION ALL SELECT o_orderkey, 0, 'skipped', 'excluded', false FROM orders WHERE o_orderkey % 13 = 0""")
def coverage_map(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    units = orders.filter("o_orderkey % 13 <> 0").selectExpr("o_orderkey AS file", "o_orderkey % 23 = 0 AS deleted", "o_orderkey % 2 = 0 AS in_chunks", "o_custkey % 90 AS changed")
    skipped = orders.filter("o_orderkey % 13 = 0").selectExpr("o_orderkey AS file", "'excluded' AS reason")
    parts = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS file", "CASE l_suppkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'interrupted' ELSE 'failed' END AS kind", "l_partkey % 10 = 0 AS opened")
    return coverage.coverage_map(units, skipped, parts)


@query("skill_usage", """WITH u AS (SELECT DISTINCT l_orderkey AS chunk, concat('s', l_suppkey % 20) AS skill FROM lineitem WHERE l_partkey % 5 <> 0), d AS (SELECT DISTINCT l_orderkey AS chunk, concat('s', l_suppkey % 25) AS skill FROM lineitem WHERE l_partkey % 5 = 0),
c AS (SELECT concat('s', l_partkey % 30) AS skill, count(*) AS findings FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), a AS (SELECT skill FROM u UNION SELECT skill FROM d UNION SELECT concat('s', s_suppkey % 35) FROM supplier)
SELECT skill, (SELECT count(*) FROM u WHERE u.skill = a.skill) AS chunks, coalesce((SELECT findings FROM c WHERE c.skill = a.skill), 0) AS findings, (SELECT count(*) FROM d WHERE d.skill = a.skill) AS dropped FROM a""")
def skill_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    used = rows.filter("l_partkey % 5 <> 0").selectExpr("l_orderkey AS chunk", "concat('s', l_suppkey % 20) AS skill")
    dropped = rows.filter("l_partkey % 5 = 0").selectExpr("l_orderkey AS chunk", "concat('s', l_suppkey % 25) AS skill")
    cited = rows.filter("l_linenumber = 1").selectExpr("concat('s', l_partkey % 30) AS skill")
    known = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey % 35) AS skill")
    return coverage.skill_usage(used, dropped, cited, known)


@query("run_summaries", f"""WITH {SQL} SELECT run, count(*) AS findings, array_to_string(list_sort(list(DISTINCT concat(severity, '=', n))), ',') AS by_severity, array_to_string(list_sort(list(DISTINCT analyzer)), ', ') AS providers
FROM (SELECT *, count(*) OVER (PARTITION BY run, severity) AS n FROM f) GROUP BY run""")
def run_summaries(spark, sf_dir):
    return coverage.summarize(findings(spark, sf_dir), "run", "analyzer")
