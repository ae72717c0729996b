"""Queries over batches, windows, claims, passes, figures and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanline.functions import formats
from gleanline.functions import text as T
from gleanline.operators import batches, greedy
from gleanline.plans.evaluations import _LIKE, _WORDS
from gleanline.plans.facts import RANK, SQL, findings, table
from gleanline.plans.registry import query

_STEP = "SELECT {c}, k, n, 0::BIGINT AS part, 1::BIGINT AS held, n AS used FROM o WHERE k = 1 UNION ALL SELECT {oc}, o.k, o.n, r.part + CASE WHEN {full} THEN 1 ELSE 0 END, CASE WHEN {full} THEN 1 ELSE r.held + 1 END, CASE WHEN {full} THEN o.n ELSE r.used + o.n END FROM r JOIN o ON o.run = r.run AND o.k = r.k + 1"


@query("critique_batches", f"""WITH RECURSIVE {SQL}, q AS (SELECT run, id, 100 + part % 900 AS n, row_number() OVER (PARTITION BY run ORDER BY file, id) AS k FROM f),
r AS ({_STEP.format(c='run, id', oc='o.run, o.id', full='r.held >= 8 OR r.used + o.n > 3000').replace('FROM o', 'FROM q').replace('JOIN o', 'JOIN q o')}) SELECT run, id, part AS batch FROM r""")
def critique_batches(spark, sf_dir):
    """Findings by file in batches of at most eight and a budget of prompt."""
    rows = findings(spark, sf_dir).select("run", "file", "id", F.expr("100 + part % 900").alias("n"))
    return batches.batches(rows, ["run"], "n", ["file", "id"], 3000, 8).select("run", "id", "batch")


_PARTS = "o AS (SELECT p_type AS run, concat(p_brand, '/', p_size % 5, '/f', p_partkey) AS file, 50 + p_partkey % 400 AS n, {order} AS k FROM part)"


@query("directory_groups", f"WITH RECURSIVE {_PARTS.format(order='''row_number() OVER (PARTITION BY p_type ORDER BY concat(p_brand, '/', p_size % 5), concat(p_brand, '/', p_size % 5, '/f', p_partkey))''')}, r AS ({_STEP.format(c='run, file', oc='o.run, o.file', full='r.used + o.n > 2000')}) SELECT run, file, part AS chunk FROM r")
def directory_groups(spark, sf_dir):
    """Files in the order of directories, filled into chunks."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("run"), F.expr("concat(p_brand, '/', string(p_size % 5))").alias("dir"), F.expr("concat(p_brand, '/', string(p_size % 5), '/f', string(p_partkey))").alias("file"), F.expr("50 + p_partkey % 400").alias("n"))
    return greedy.reset_fill(rows, ["run"], "n", ["dir", "file"], 2000).select("run", "file", "chunk")


@query("file_groups", """WITH RECURSIVE o AS (SELECT conv_id AS run, turn, length(coalesce(text, ''))::BIGINT AS n, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) AS k, turn // 4 AS file FROM conversations),
r AS (SELECT run, file, turn, k, 0::BIGINT AS part, n AS used FROM o WHERE k = 1 UNION ALL SELECT o.run, o.file, o.turn, o.k, r.part + CASE WHEN r.used + o.n > 700 THEN 1 ELSE 0 END, CASE WHEN r.used + o.n > 700 THEN o.n ELSE r.used + o.n END FROM r JOIN o ON o.run = r.run AND o.file = r.file AND o.k = r.k + 1)
SELECT run, turn, dense_rank() OVER (PARTITION BY run ORDER BY file, part) - 1 AS chunk FROM r""")
def file_groups(spark, sf_dir):
    """A chunk or more for each file, never two files in one: four turns of a conversation are a file."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.expr("turn div 4").alias("file"), "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    filled = greedy.reset_fill(rows, ["run", "file"], "n", ["turn"], 700)
    return filled.select("run", "turn", (F.dense_rank().over(Window.partitionBy("run").orderBy("file", "chunk")) - 1).cast("long").alias("chunk"))


@query("sweep_parts", """WITH RECURSIVE b AS (SELECT l_suppkey AS run, l_orderkey AS chunk, min(50 + l_partkey % 300) AS n FROM lineitem GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY chunk) AS k FROM b),
r AS (SELECT run, chunk, k, 0::BIGINT AS part, n AS used FROM o WHERE k = 1 UNION ALL SELECT o.run, o.chunk, o.k, r.part + CASE WHEN r.used + o.n > 4000 THEN 1 ELSE 0 END, CASE WHEN r.used + o.n > 4000 THEN o.n ELSE r.used + o.n END FROM r JOIN o ON o.run = r.run AND o.k = r.k + 1) SELECT run, chunk, part FROM r""")
def sweep_parts(spark, sf_dir):
    """Every chunk once, however many passes read it, filled into calls."""
    once = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("chunk")).agg(F.min(F.expr("50 + l_partkey % 300")).alias("n"))
    filled = greedy.reset_fill(once.withColumnRenamed("chunk", "item"), ["run"], "n", ["item"], 4000)
    return filled.select("run", F.col("item").alias("chunk"), F.col("chunk").alias("part"))


@query("file_windows", """WITH l AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 40) / 25.0), 0)::BIGINT + 1)) AS k FROM l)
SELECT doc_id, k + 1 AS part, 25 * k + 1 AS first, least(25 * k + 40, n) AS last FROM p""")
def file_windows(spark, sf_dir):
    """Long texts in windows of forty lines that share fifteen with the next."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = rows.select("doc_id", (F.col("pos") + 1).alias("at"), F.lit(10).alias("n"))
    return batches.windows(lines, ["doc_id"], "at", "n", 409)


@query("balanced_parts", """WITH RECURSIVE o AS (SELECT p_type AS run, p_brand AS g, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, g) AS k FROM o),
r AS (SELECT run, g, k, 1 AS place, [n, 0, 0, 0]::BIGINT[] AS load FROM s WHERE k = 1 UNION ALL SELECT s.run, s.g, s.k, list_position(load, list_min(load)), list_transform(range(1, 5), lambda j: load[j] + CASE WHEN j = list_position(load, list_min(load)) THEN s.n ELSE 0 END) FROM r JOIN s ON s.run = r.run AND s.k = r.k + 1) SELECT run, g, place - 1 AS part FROM r""")
def balanced_parts(spark, sf_dir):
    """Groups dealt to four parts, the largest first, each to the part that holds least."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("run"), F.col("p_brand").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return batches.balanced(rows, ["run"], "n", "g", 4).select("run", "g", "part")


@query("claimed_hints", f"""WITH {SQL}, h AS (SELECT run AS chunk, concat('H', row_number() OVER (PARTITION BY run ORDER BY id)) AS hint_id, file, start, "end" AS e, analyzer, rule_id, non_rejectable FROM f WHERE supp % 2 = 0)
SELECT f.id, h.analyzer AS tool_analyzer, h.rule_id AS tool_rule, coalesce(h.non_rejectable, false) AS must_report FROM f LEFT JOIN h ON h.chunk = f.run AND h.hint_id = concat('H', 1 + f.part % 6) AND h.file = f.file AND f.start <= h.e + 3 AND f."end" >= h.start - 3 WHERE supp % 2 = 1""")
def claimed_hints(spark, sf_dir):
    rows = findings(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("run").orderBy("id"))
    hints = rows.filter("supp % 2 = 0").withColumn("hint_id", F.concat(F.lit("H"), number.cast("string"))).withColumnRenamed("run", "chunk")
    told = rows.filter("supp % 2 = 1").select("id", F.col("run").alias("chunk"), F.expr("concat('H', string(1 + part % 6))").alias("hint"), "file", "start", "end")
    return batches.claims(told, hints).select("id", "tool_analyzer", "tool_rule", "must_report")


@query("second_pass", f"""WITH {SQL}, a AS (SELECT *, {_WORDS.format('title')} AS w FROM f WHERE supp % 2 = 0), b AS (SELECT *, {_WORDS.format('title')} AS w FROM f WHERE supp % 2 = 1),
t AS (SELECT b.id AS id_b, min(a.id) AS id FROM a JOIN b ON a.file = b.file AND a.start <= b."end" AND b.start <= a."end" AND {_LIKE.format(a='a.w', b='b.w')} >= 0.5 GROUP BY b.id)
SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 2 ELSE 1 END AS passes FROM a UNION ALL SELECT id, 1 FROM b WHERE id NOT IN (SELECT id_b FROM t)""")
def second_pass(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return batches.both_passes(rows.filter("supp % 2 = 0"), rows.filter("supp % 2 = 1"))


@query("chunk_hits", f"WITH {SQL}, c AS (SELECT DISTINCT run AS chunk, file FROM f WHERE part % 5 <> 0) SELECT f.id FROM f WHERE EXISTS (SELECT 1 FROM c WHERE c.file = f.file AND c.chunk = f.run)")
def chunk_hits(spark, sf_dir):
    """The hits in files that a chunk holds."""
    rows = findings(spark, sf_dir)
    held = rows.filter("part % 5 <> 0").select("run", "file")
    return rows.join(held, ["run", "file"], "left_semi").select("id")


@query("schedule", f"WITH {SQL}, c AS (SELECT run, count(*) AS tokens FROM f GROUP BY run) SELECT run, row_number() OVER (PARTITION BY run % 7 ORDER BY tokens DESC, run) AS place FROM c")
def schedule(spark, sf_dir):
    """Chunks by size, the largest first."""
    rows = findings(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("tokens"))
    return rows.select("run", F.row_number().over(Window.partitionBy(F.expr("run % 7")).orderBy(F.desc("tokens"), "run")).alias("place"))


@query("state_marker", f"WITH {SQL}, k AS (SELECT run % 20 AS run, part % 4000 AS fp, severity, start, row_number() OVER (PARTITION BY run % 20 ORDER BY {RANK}, start, id) AS n FROM f) SELECT run, fp, severity, start FROM k WHERE n <= 100")
def state_marker(spark, sf_dir):
    """What a review remembers of itself: its hundred worst findings."""
    rows = findings(spark, sf_dir).withColumn("run", F.expr("run % 20"))
    n = F.row_number().over(Window.partitionBy("run").orderBy(T.severity_rank(F.col("severity")), "start", "id"))
    return rows.withColumn("n", n).filter("n <= 100").select("run", F.expr("part % 4000").alias("fp"), "severity", "start")


@query("context_files", """WITH c AS (SELECT DISTINCT p_partkey % 40 AS chunk, p_partkey AS file FROM part), i AS (SELECT DISTINCT p_partkey AS a, p_partkey * 7 % 151 AS b FROM part WHERE p_partkey <> p_partkey * 7 % 151 AND p_partkey * 7 % 151 IN (SELECT p_partkey FROM part)),
s AS (SELECT chunk, other, sum(u) AS uses, sum(d) AS used_by FROM (SELECT chunk, b AS other, 1 AS u, 0 AS d FROM c JOIN i ON a = file UNION ALL SELECT chunk, a, 0, 1 FROM c JOIN i ON b = file) GROUP BY ALL),
k AS (SELECT chunk, other AS file, row_number() OVER (PARTITION BY chunk ORDER BY uses > 0 DESC, uses + used_by DESC, other) AS place FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chunk = s.chunk AND c.file = s.other)) SELECT chunk, file, place FROM k WHERE place <= 4""")
def context_files(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    chunks = part.select(F.expr("p_partkey % 40").alias("chunk"), F.col("p_partkey").alias("file"))
    imports = part.select(F.col("p_partkey").alias("a"), F.expr("p_partkey * 7 % 151").alias("b"))
    return batches.context_files(chunks, imports, 1350).select("chunk", "file", "place")


@query("context_shares", """WITH RECURSIVE c AS (SELECT DISTINCT p_partkey % 40 AS chunk, p_partkey AS file FROM part), i AS (SELECT DISTINCT p_partkey AS a, p_partkey * 7 % 151 AS b FROM part WHERE p_partkey <> p_partkey * 7 % 151 AND p_partkey * 7 % 151 IN (SELECT p_partkey FROM part)),
s AS (SELECT chunk, other, sum(u) AS uses, sum(d) AS used_by FROM (SELECT chunk, b AS other, 1 AS u, 0 AS d FROM c JOIN i ON a = file UNION ALL SELECT chunk, a, 0, 1 FROM c JOIN i ON b = file) GROUP BY ALL),
k AS (SELECT chunk, other AS file, row_number() OVER (PARTITION BY chunk ORDER BY uses > 0 DESC, uses + used_by DESC, other) AS place FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chunk = s.chunk AND c.file = s.other)),
n AS (SELECT chunk, file, place, 12 * p_size + length(p_name) AS need, count(*) OVER (PARTITION BY chunk) AS m FROM k JOIN part ON p_partkey = file WHERE place <= 4),
r AS (SELECT chunk, file, place, need, m, least(need, greatest(300, 1350 // m), 1350) AS share, 1350 - least(need, greatest(300, 1350 // m), 1350) AS rest FROM n WHERE place = 1
  UNION ALL SELECT n.chunk, n.file, n.place, n.need, n.m, CASE WHEN rest >= 300 THEN least(n.need, greatest(300, rest // (n.m - n.place + 1)), rest) END, rest - CASE WHEN rest >= 300 THEN least(n.need, greatest(300, rest // (n.m - n.place + 1)), rest) ELSE 0 END FROM r JOIN n ON n.chunk = r.chunk AND n.place = r.place + 1)
SELECT chunk, file, place, need::BIGINT AS tokens, share::BIGINT AS share FROM r WHERE share IS NOT NULL""")
def context_shares(spark, sf_dir):
    """What each file of a chunk's context gets of the room: equal parts, short files leave theirs to the next."""
    part = table(spark, sf_dir, "part")
    chunks = part.select(F.expr("p_partkey % 40").alias("chunk"), F.col("p_partkey").alias("file"))
    imports = part.select(F.col("p_partkey").alias("a"), F.expr("p_partkey * 7 % 151").alias("b"))
    sizes = part.select(F.col("p_partkey").alias("file"), F.expr("12 * p_size + length(p_name)").alias("tokens"))
    return batches.share_context(batches.context_files(chunks, imports, 1350).join(sizes, "file"), 1350)


@query("figures", """WITH e AS (SELECT event_id, event_id % 977 AS k, CASE event_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'CHF' END AS c, CASE WHEN event_id % 11 <> 0 THEN event_id * event_id % 9000000 END AS ms FROM events),
m AS (SELECT *, CASE WHEN k % 4 = 0 THEN k ELSE 0 END AS whole, floor(coalesce(ms, 0) / 1000.0 + 0.5)::BIGINT AS s FROM e), n AS (SELECT *, floor(s / 60.0 + 0.5)::BIGINT AS mi FROM m)
SELECT event_id, concat(CASE c WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' ELSE '' END, whole, '.00', CASE c WHEN 'CHF' THEN ' CHF' ELSE '' END) AS money,
  CASE WHEN ms IS NULL THEN '—' WHEN ms < 1000 THEN concat(ms, 'ms') WHEN ms < 10000 THEN concat(ms // 1000, '.', ms // 100 % 10, 's') WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm ', lpad((s % 60)::VARCHAR, 2, '0'), 's') ELSE concat(mi // 60, 'h ', lpad((mi % 60)::VARCHAR, 2, '0'), 'm') END AS took,
  CASE WHEN k * 100 < 1000 THEN (k * 100)::VARCHAR WHEN k * 100 < 10000 THEN concat(k // 10, CASE WHEN k % 10 = 0 THEN '' ELSE concat('.', k % 10) END, 'k') ELSE concat((k + 5) // 10, 'k') END AS tokens FROM n""")
def figures(spark, sf_dir):
    k, ms = F.expr("event_id % 977"), F.expr("if(event_id % 11 <> 0, event_id * event_id % 9000000, null)")
    amount, currency = F.when(k % 4 == 0, k).otherwise(0).cast("double"), F.expr("case event_id % 3 when 0 then 'USD' when 1 then 'EUR' else 'CHF' end")
    return table(spark, sf_dir, "events").select("event_id", formats.money(amount, currency).alias("money"), formats.duration(ms).alias("took"), formats.token_count(k * 100).alias("tokens"))


_VERSIONS = [("node", "lts/iron", "20"), ("node", "v22.{k}", "22.{k}"), ("node", "stable", None), ("python", "pypy3.{k}-7.3", "3.{k}"), ("python", "cpython@3.{k}", "3.{k}"), ("java", "VERSION_1_8", "8"), ("java", "17.0.{k}", "17.0.{k}"), ("tfm", "net{k}.0-windows", "{k}.0"), ("tfm", "net472", "4.7.2"), ("tfm", "netstandard2.0", None), ("image", "docker.io/a/node:22.{k}-alpine@sha256:ab", "22.{k}"), ("image", "node:jod-slim", "22"), ("image", "host:5000/x", None), ("arg", "node:${V:-9}-${W}", "node:{k}-w"), ("arg", "$NONE:1", None)]


@query("ecosystem_versions", f"SELECT p_partkey, CASE p_partkey % {len(_VERSIONS)} " + " ".join(f"WHEN {i} THEN replace('{w}', '{{k}}', (p_partkey % 90)::VARCHAR)" for i, (_, _, w) in enumerate(_VERSIONS) if w) + " END AS version FROM part")
def ecosystem_versions(spark, sf_dir):
    """Versions as Node, Python, Java, .NET and image files write them."""
    k = F.expr("string(p_partkey % 90)")
    args = F.create_map(F.lit("V"), k, F.lit("W"), F.lit("w"))
    readers = {"node": formats.node_version, "python": formats.python_version, "java": formats.java_version, "tfm": formats.framework_version, "image": formats.image_version, "arg": lambda t: formats.substituted(t, args)}
    found = F.coalesce(*(F.when(F.expr(f"p_partkey % {len(_VERSIONS)}") == i, readers[kind](F.replace(F.lit(text), F.lit("{k}"), k))) for i, (kind, text, _) in enumerate(_VERSIONS)))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("version"))


@query("valid_reports", "SELECT user_id, count(*) FILTER (event_id % 4 <> 0 AND event_id % 9 <> 5) AS valid, count(*) FILTER (event_id % 4 = 0 OR event_id % 9 = 5) AS invalid FROM events GROUP BY user_id")
def valid_reports(spark, sf_dir):
    """Reported findings against their schema: those that fit stay, the others are counted."""
    raw = F.when(F.expr("event_id % 9 = 5"), F.lit('{"title": "no lines"')).otherwise(F.to_json(F.struct(F.when(F.expr("event_id % 4 <> 0"), F.lit("major")).otherwise("huge").alias("severity"), F.expr("1 + event_id % 50").alias("startLine"), F.lit("a title").alias("title"))))
    rows = table(spark, sf_dir, "events").select("user_id", F.from_json(raw, "severity string, startLine long, title string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    fits = F.coalesce(F.col("r.broken").isNull() & F.col("r.severity").isin(*T.SEVERITIES) & (F.col("r.startLine") >= 1) & (F.length("r.title") > 0), F.lit(False))
    return rows.groupBy("user_id").agg(F.count_if(fits).alias("valid"), F.count_if(~fits).alias("invalid"))


@query("run_sets", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber = 2) SELECT 'both' AS what, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def run_sets(spark, sf_dir):
    """What two runs share, and what each has alone, in one aggregation by key."""
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber IN (1, 2)").groupBy("l_partkey").agg(F.bool_or(F.col("l_linenumber") == 1).alias("a"), F.bool_or(F.col("l_linenumber") == 2).alias("b"))
    kinds = F.explode(F.array_compact(F.array(F.lit("any"), F.when(F.expr("a AND b"), "both"), F.when(F.expr("a AND NOT b"), "removed"), F.when(F.expr("b AND NOT a"), "added"))))
    return rows.select(kinds.alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query("tool_calls", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, array_to_string(list(concat(event_type, '=', n) ORDER BY event_type), ',') AS calls, strftime(to_timestamp(1700000000 + user_id * 86399), '%Y-%m-%dT%H:%M:%SZ') AS at FROM c GROUP BY user_id")
def tool_calls(spark, sf_dir):
    """Counters of two halves added as maps, and a moment written as ISO."""
    rows = table(spark, sf_dir, "events")

    def half(k: int):
        counts = rows.filter(F.expr(f"event_id % 2 = {k}")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(f"m{k}"))

    none = F.create_map().cast("map<string,bigint>")
    both = half(0).join(half(1), "user_id", "full")
    added = F.map_zip_with(F.coalesce("m0", none), F.coalesce("m1", none), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(added)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    at = F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("user_id") * 86399), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return both.select("user_id", text.alias("calls"), at.alias("at"))


# Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom; beyond that 1.96.
T_95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]


@query("recall_interval", f"""WITH c AS (SELECT l_suppkey % 12 AS cluster, count(*)::DOUBLE AS n, (count(*) FILTER (l_partkey % 3 = 0) - count(*) FILTER (l_partkey % 4 = 0))::DOUBLE AS d FROM lineitem GROUP BY ALL), s AS (SELECT sum(d) / sum(n) AS delta, count(*) AS m, sum(n) AS total FROM c),
e AS (SELECT delta, m, sqrt((SELECT sum((d - delta * n) ** 2) FROM c) * m / (m - 1)) / total AS se FROM s) SELECT m AS clusters, floor(delta * 1e8 + 0.5) / 1e8 AS delta, floor((delta - se * {T_95}[m - 1]) * 1e8 + 0.5) / 1e8 AS low, floor((delta + se * {T_95}[m - 1]) * 1e8 + 0.5) / 1e8 AS high FROM e""")
def recall_interval(spark, sf_dir):
    """The paired difference of two recalls with a t interval over clusters, by closed sums."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_suppkey % 12").alias("cluster")).agg(F.count(F.lit(1)).cast("double").alias("n"), (F.count_if(F.expr("l_partkey % 3 = 0")) - F.count_if(F.expr("l_partkey % 4 = 0"))).cast("double").alias("d"))
    s = rows.agg(F.count(F.lit(1)).alias("m"), F.sum("d").alias("d"), F.sum("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("d") * F.col("n")).alias("dn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    delta, m = F.col("d") / F.col("n"), F.col("m")
    se = F.sqrt((F.col("dd") - 2 * delta * F.col("dn") + delta * delta * F.col("nn")) * m / (m - 1)) / F.col("n")
    t = F.coalesce(F.get(F.array(*map(F.lit, T_95)), (m - 2).cast("int")), F.lit(1.96))
    return s.select(m.alias("clusters"), T.half_up(delta, 8).alias("delta"), T.half_up(delta - se * t, 8).alias("low"), T.half_up(delta + se * t, 8).alias("high"))
