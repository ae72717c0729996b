"""Rules for the lines of plain texts: a few regular expressions in one pass, capped by rule and reduced to one hit a spot and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions.text import severity_rank

#: Rules whose hits count as one spot's; a rule without a key is a key of its own. A rule that is firm is not capped.
KEYS = {"hex-token": "number", "long-number": "number"}
FIRM = ["hex-token"]
#: (rule, pattern, severity, category, confidence). Patterns keep to what Java and RE2 read alike.
RULES: list[tuple[str, str, str, str, float]] = [
    ("hex-token", r"[0-9a-f]{40}", "critical", "security", 0.9),
    ("credential-word", r"(?i)(password|secret|token|api_key)[ ]*[=:]", "major", "security", 0.75),
    ("mail-address", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+[.][A-Za-z]", "minor", "privacy", 0.7),
    ("licence-line", r"(?i)(licen[cs]e|copyright)", "info", "legal", 0.6),
    ("symbol-run", r"[#*$%&|<>]{3,}", "minor", "style", 0.5),
    ("long-number", r"[0-9]{9,}", "minor", "privacy", 0.45),
    ("shouting", r"[A-Z]{12,}", "info", "style", 0.4),
    ("bare-url", r"https?://[A-Za-z0-9.-]+", "info", "link", 0.5),
]
PER_RULE = 10


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, content): the lines of each text, from 1."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("at", "content")).select(key, (F.col("at") + 1).alias("line"), "content")


def scan(lines: DataFrame, key: str = "doc_id", rules: list[tuple[str, str, str, str, float]] = RULES) -> DataFrame:
    """(key, line, rule_id, severity, category, confidence) of all matches: all rules in one pass over the lines."""
    found = F.array(*(F.when(F.col("content").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.lit(w).alias("confidence"))) for r, p, s, c, w in rules))
    return lines.select(key, "line", F.explode(F.array_compact(found)).alias("hit")).select(key, "line", "hit.*")


def spot_key(rule: Column) -> Column:
    return F.coalesce(*(F.when(rule == r, F.lit(k)) for r, k in KEYS.items()), rule)


def capped(hits: DataFrame, key: str = "doc_id", per_rule: int = PER_RULE) -> Column:
    """Whether a hit is within its rule's cap: the first lines of a file, all of a firm rule."""
    return F.col("rule_id").isin(*FIRM) | (F.row_number().over(Window.partitionBy(key, "rule_id").orderBy("line")) <= per_rule)


def finalize(hits: DataFrame, key: str = "doc_id", per_rule: int = PER_RULE) -> DataFrame:
    """At most per_rule hits of a rule in a file; of those on one line that share a key only the strongest."""
    few = hits.withColumn("_c", capped(hits, key, per_rule)).filter("_c")
    strong = Window.partitionBy(key, "line", spot_key(F.col("rule_id"))).orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "rule_id")
    return few.withColumn("_n", F.row_number().over(strong)).filter("_n = 1").drop("_n", "_c")


def scan_sql(table: str = "documents") -> str:
    """The same as a WITH list that ends in `hits` and `final`."""
    cases = "\n UNION ALL ".join(f"SELECT doc_id, line, '{r}' AS rule_id, '{s}' AS severity, '{c}' AS category, {w}::DOUBLE AS confidence FROM lines WHERE regexp_matches(content, '{p}')" for r, p, s, c, w in RULES)
    return f"""lines AS (SELECT doc_id, unnest(ls) AS content, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table})),
hits AS ({cases}),
capped AS (SELECT *, CASE WHEN rule_id IN ('hex-token', 'long-number') THEN 'number' ELSE rule_id END AS spot FROM hits QUALIFY rule_id = 'hex-token' OR row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line) <= {PER_RULE}),
final AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY doc_id, line, spot ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, confidence DESC, rule_id) = 1)"""
