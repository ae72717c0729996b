"""Queries over facts: cost, budgets, affinity graphs, sessions, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.operators import graph, intervals, ledger, resampling
from gleanline.plans.facts import tasks
from gleanline.plans.registry import query
from gleanline.plans.reviews import table

#: Seconds of silence that end a session; spend a user may reach; sizes a cache may hold.
GAP, SPEND, CACHE = 3600, 500, 50_000
_TS = "epoch_us(ts) // 1000000"


def seconds():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


@query("usage_cost", "SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(p_retailprice AS DECIMAL(12,2)))::DOUBLE AS cost, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(12,2)) * CAST(p_retailprice AS DECIMAL(12,2)) ELSE 0 END)::DOUBLE AS batch_cost, count(*) FILTER (p_retailprice IS NULL) AS unpriced FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def usage_cost(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey", "left")
    cost = F.col("l_quantity").cast("decimal(12,2)") * F.col("p_retailprice").cast("decimal(12,2)")
    return rows.groupBy("l_suppkey").agg(F.sum(cost).cast("double").alias("cost"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", cost)), F.lit(0)).cast("double").alias("batch_cost"), F.count_if(F.col("p_retailprice").isNull()).alias("unpriced"))


@query("spend_gate", f"SELECT event_id, user_id FROM (SELECT event_id, user_id, sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent < {SPEND}")
def spend_gate(spark, sf_dir):
    spent = F.sum(F.col("value").cast("decimal(18,6)")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", "user_id", spent.alias("spent")).filter(F.col("spent") < SPEND).select("event_id", "user_id")


@query("usage_totals", "SELECT user_id, count(*) AS requests, bool_or(event_type = 'purchase') AS any_purchase, bool_and(value >= 0) AS all_positive, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def usage_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.bool_and(F.col("value") >= 0).alias("all_positive"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("event_pairs", f"WITH e AS (SELECT event_id, user_id, event_type, {_TS} AS s FROM events) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.event_type = 'click' AND b.event_type <> 'click' AND abs(a.s - b.s) <= 600")
def event_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds().alias("s"))
    a = rows.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("s").alias("start"), F.col("s").alias("end"))
    b = rows.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("b"), F.col("s").alias("start_b"), F.col("s").alias("end_b"))
    return intervals.overlap_join(a, b, ["user_id"], 600, 3600).filter("a <> b").select("a", "b")


@query("sessions", f"WITH e AS (SELECT user_id, event_id, {_TS} AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER w > {GAP} THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, k::BIGINT AS session, count(*) AS n, max(s)::BIGINT - min(s)::BIGINT AS seconds FROM n GROUP BY user_id, k")
def sessions(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("s", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", seconds().alias("s"))
    fresh = F.coalesce((F.col("s") - F.lag("s").over(order) > GAP).cast("int"), F.lit(0))
    marked = rows.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("s") - F.min("s")).alias("seconds"))


@query("noisy_or", "WITH m AS (SELECT user_id, event_type, max(value) AS w FROM events GROUP BY user_id, event_type), s AS (SELECT user_id, count(*) AS signals, list(w ORDER BY event_type) AS ws FROM m GROUP BY user_id) SELECT user_id, signals, floor((1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(ws, lambda w: 1 - least(greatest(w / 1000, 0), 0.999))), lambda a, b: a * b)) * 1000000 + 0.5) / 1000000 AS score FROM s")
def noisy_or(spark, sf_dir):
    strongest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("w"))
    ordered = strongest.groupBy("user_id").agg(F.count(F.lit(1)).alias("signals"), F.array_sort(F.collect_list(F.struct("event_type", "w"))).alias("ws"))
    left = F.aggregate("ws", F.lit(1.0), lambda a, x: a * (1 - F.least(F.greatest(x["w"] / 1000, F.lit(0.0)), F.lit(0.999))))
    return ordered.select("user_id", "signals", T.half_up(1 - left, 6).alias("score"))


@query("top_lines", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) <= 2")
def top_lines(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").withColumn("n", n).filter("n <= 2").select("l_orderkey", "l_linenumber", "l_partkey")


_COCHANGE = """c AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS i FROM lineitem), s AS (SELECT * FROM c WHERE c IN (SELECT c FROM c GROUP BY c HAVING count(*) <= 30)),
r AS (SELECT i, count(*) AS n FROM s GROUP BY i), p AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM s a JOIN s b ON a.c = b.c AND a.i < b.i GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT p.*, p.n::DOUBLE / least(x.n, y.n) AS coupling FROM p JOIN r x ON x.i = p.a JOIN r y ON y.i = p.b)"""


@query("cochange", f"WITH {_COCHANGE} SELECT a, b, n, coupling, 0.5 * least(1.0, coupling) AS weight FROM k WHERE coupling >= 0.03")
def cochange(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return graph.cochange(lines, "l_orderkey", "l_suppkey", min_coupling=0.03, tasks=tasks(lines))


@query("affinity_components", f"WITH RECURSIVE {_COCHANGE}, e AS (SELECT a, b FROM k WHERE coupling >= 0.05), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(v, w) AS (SELECT a, a FROM u UNION SELECT u.b, reach.w FROM reach JOIN u ON u.a = reach.v) SELECT v, min(w) AS component FROM reach GROUP BY v")
def affinity_components(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return graph.components(graph.cochange(lines, "l_orderkey", "l_suppkey", min_coupling=0.05, tasks=tasks(lines)))


_DIRS = "SELECT page_id, string_split(url, '/') AS p FROM pages"


@query("longest_prefix", f"WITH s AS ({_DIRS}), d AS (SELECT DISTINCT array_to_string(p[1:3 + (page_id % 3)::INT], '/') AS dir FROM s WHERE page_id % 4 <> 0) SELECT page_id, arg_max(dir, length(dir)) AS root FROM pages JOIN d ON url = dir OR starts_with(url, concat(dir, '/')) GROUP BY page_id")
def longest_prefix(spark, sf_dir):
    """Each page's nearest declared ancestor, of declarations at three depths: its ancestors are exploded and joined by equality."""
    parts = F.split("url", "/", -1)
    pages = table(spark, sf_dir, "pages").select("page_id", parts.alias("p"))
    up_to = lambda k: F.array_join(F.slice("p", 1, k), "/")
    declared = pages.filter("page_id % 4 <> 0").select(up_to((3 + F.col("page_id") % 3).cast("int")).alias("dir")).distinct()
    up = pages.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), up_to)).alias("dir"))
    return up.join(declared, "dir").groupBy("page_id").agg(F.max_by("dir", F.length("dir")).alias("root"))


@query("dominant_owner", "SELECT c_nationkey, c_mktsegment AS owner, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment DESC) = 1")
def dominant_owner(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("c_nationkey").agg(F.max(F.struct("n", "c_mktsegment")).alias("m")).select("c_nationkey", F.col("m.c_mktsegment").alias("owner"), F.col("m.n").alias("n"))


@query("cache_prune", f"SELECT doc_id, n_chars FROM (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM documents) WHERE held > {CACHE}")
def cache_prune(spark, sf_dir):
    """Entries beyond a source's share of the cache, newest first."""
    return ledger.running_sum(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", "held").filter(F.col("held") > CACHE).select("doc_id", "n_chars")


@query("cache_stats", "SELECT source, count(*) AS entries, sum(n_chars)::BIGINT AS bytes, min(doc_id) AS oldest, max(doc_id) AS newest, count(*) FILTER (doc_id < 100) AS expired FROM documents GROUP BY source")
def cache_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum("n_chars").alias("bytes"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"), F.count_if(F.col("doc_id") < 100).alias("expired"))


@query("version_order", "WITH v AS (SELECT p_partkey, concat(p_size, '.', p_partkey % 10) AS version FROM part), k AS (SELECT *, list_transform(string_split(version, '.'), lambda x: x::INT) AS key FROM v) SELECT p_partkey, version, (key[1] > 10 OR (key[1] = 10 AND key[2] >= 5)) AND key[1] < 30 AS satisfied FROM k")
def version_order(spark, sf_dir):
    """Whether a version lies in the range >= 10.5 < 30, by numbers and not by letters."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string")).alias("version"))
    key = T.version_key(F.col("version"))
    return rows.select("p_partkey", "version", ((key >= T.version_key(F.lit("10.5"))) & (key < T.version_key(F.lit("30")))).alias("satisfied"))


@query("props_sum", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def props_sum(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"))


@query("length_stats", "SELECT lang, count(*) AS n, median(n_chars)::DOUBLE AS median_chars, count(*) FILTER (n_chars < 100)::DOUBLE / count(*) AS short_share FROM documents GROUP BY lang")
def length_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median_chars"), T.ratio(F.count_if(F.col("n_chars") < 100), F.count(F.lit(1))).alias("short_share"))


@query("clustered_difference", "WITH d AS (SELECT source, sum(quality - toxic)::DOUBLE AS d, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), m AS (SELECT sum(d) / sum(n) AS mean, count(*) AS g FROM d) SELECT g AS clusters, floor(mean * 1e8 + 0.5) / 1e8 AS mean, floor(sqrt((SELECT sum((d - mean * n) ** 2) FROM d) * g / nullif(g - 1, 0)) / (SELECT sum(n) FROM d) * 1e8 + 0.5) / 1e8 AS se FROM m")
def clustered_difference(spark, sf_dir):
    """Mean paired difference with a standard error over clusters: closed sums, the squares expanded."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    c = rows.groupBy("source").agg(F.sum(F.col("quality") - F.col("toxic")).cast("double").alias("d"), F.count(F.lit(1)).cast("double").alias("n"))
    s = c.agg(F.count(F.lit(1)).alias("clusters"), F.sum("d").alias("d"), F.sum("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("d") * F.col("n")).alias("dn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.try_divide("d", "n")
    squares = F.col("dd") - 2 * mean * F.col("dn") + mean * mean * F.col("nn")
    se = F.try_divide(F.sqrt(F.try_divide(squares * F.col("clusters"), F.col("clusters") - 1)), F.col("n"))
    return s.select("clusters", T.half_up(mean, 8).alias("mean"), T.half_up(se, 8).alias("se"))


_HASHED = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _drawn(clusters: str, key: str, draws: int) -> str:
    """p: the clusters by their place, x: how often each of the draws takes them, draw -1 once."""
    at = _HASHED.format(f"({key})::VARCHAR")
    slot = _HASHED.format("concat(draw, ':', slot)")
    return f"""p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {at}, {key}) - 1 AS pos FROM {clusters}), z AS (SELECT count(*) AS n FROM p),
x AS (SELECT p.*, draw, times FROM (SELECT draw, {slot} % n AS pos, count(*) AS times FROM (SELECT draw, unnest(range(n)) AS slot, n FROM range({draws}) t(draw), z) GROUP BY ALL) JOIN p USING (pos) UNION ALL SELECT *, -1, 1 FROM p)"""


_ENDS = "list_sort(list({v}) FILTER (draw >= 0))[{k}]"


@query("bootstrap_interval", f"""WITH c AS (SELECT doc_id, quality - toxic AS d FROM labels), {_drawn('c', 'doc_id', 200)}, m AS (SELECT draw, sum(times * d)::DOUBLE / sum(times) AS mean FROM x GROUP BY draw)
SELECT {_ENDS.format(v='mean', k=6)} AS low, {_ENDS.format(v='mean', k=196)} AS high, (count(*) FILTER (draw >= 0 AND mean > 0))::DOUBLE / count(*) FILTER (draw >= 0) AS p_positive FROM m""")
def bootstrap_interval(spark, sf_dir, draws: int = 200):
    """Percentile interval of the mean paired difference; sums of each draw are all that is gathered."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("d"))
    per_draw = resampling.resampled(rows, "doc_id", draws).groupBy("draw").agg(F.try_divide(F.sum(F.col("times") * F.col("d")).cast("double"), F.sum("times").cast("double")).alias("mean"))
    return resampling.interval(per_draw, "mean").drop("observed")


_CLUSTERS = """c AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 1) AS atp, count(*) FILTER (quality = 0 AND toxic = 1) AS afp, count(*) FILTER (quality = 1 AND toxic = 0) AS afn,
count(*) FILTER (quality = 1 AND n_chars < 900) AS btp, count(*) FILTER (quality = 0 AND n_chars < 900) AS bfp, count(*) FILTER (quality = 1 AND n_chars >= 900) AS bfn FROM labels JOIN documents USING (doc_id) GROUP BY source)"""


_F1 = "coalesce(2 * sum(times * {n}tp)::DOUBLE / nullif(sum(times * (2 * {n}tp + {n}fp + {n}fn)), 0), 0)"


@query("f1_difference", f"""WITH {_CLUSTERS}, {_drawn('c', 'source', 400)}, s AS (SELECT draw, {_F1.format(n='a')} - {_F1.format(n='b')} AS d FROM x GROUP BY draw)
SELECT max(d) FILTER (draw = -1) AS difference, {_ENDS.format(v='d', k=11)} AS low, {_ENDS.format(v='d', k=391)} AS high, (count(*) FILTER (draw >= 0 AND d > 0))::DOUBLE / count(*) FILTER (draw >= 0) AS p_positive FROM s""")
def f1_difference(spark, sf_dir, draws: int = 400):
    """F1 of two detectors of good texts and a paired bootstrap of their difference over sources: both are drawn alike. Counts by source come first, so a draw reads a few rows."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    good, a, b = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars") < 900
    counts = {f"{n}{k}": F.count_if(test) for n, x in (("a", a), ("b", b)) for k, test in (("tp", good & x), ("fp", (F.col("quality") == 0) & x), ("fn", good & ~x))}
    clusters = rows.groupBy("source").agg(*(c.alias(n) for n, c in counts.items()))
    f1 = lambda n: F.coalesce(F.try_divide(2 * F.sum(F.col("times") * F.col(f"{n}tp")).cast("double"), F.sum(F.col("times") * (2 * F.col(f"{n}tp") + F.col(f"{n}fp") + F.col(f"{n}fn"))).cast("double")), F.lit(0.0))
    per_draw = resampling.resampled(clusters, "source", draws).groupBy("draw").agg((f1("a") - f1("b")).alias("d"))
    return resampling.interval(per_draw, "d").withColumnRenamed("observed", "difference")
