"""Queries whose results depend on an order of choices; their twins step through the choices by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.operators import greedy
from gleanline.plans.evaluations import _LIKE, _WORDS
from gleanline.plans.facts import SQL, findings
from gleanline.plans.registry import query


@query("deduped_findings", f"""WITH RECURSIVE {SQL}, n AS (SELECT file, id, start, "end" AS e, category, {_WORDS.format('title')} AS w, CASE part % 3 WHEN 0 THEN analyzer END AS tool, non_rejectable, supp % 5 AS chunk, part % 6 AS skill,
  row_number() OVER (PARTITION BY file ORDER BY confidence DESC, start, "end", title, id) AS k FROM f),
p AS (SELECT a.file, a.k, list(b.k ORDER BY b.k) AS xs FROM n a JOIN n b ON a.file = b.file AND b.k < a.k AND a.start <= b.e + 2 AND a.e >= b.start - 2 AND {_LIKE.format(a='a.w', b='b.w')} >= CASE WHEN a.start = b.start AND a.e = b.e AND a.category = b.category THEN 0.15 ELSE 0.5 END GROUP BY a.file, a.k),
q AS (SELECT n.file, n.k, coalesce(xs, []::BIGINT[]) AS xs FROM n LEFT JOIN p USING (file, k)),
r AS (SELECT file, k, [k] AS kept, k AS into_ FROM q WHERE k = 1 UNION ALL
  SELECT q.file, q.k, CASE WHEN list_has_any(r.kept, q.xs) THEN r.kept ELSE list_append(r.kept, q.k) END, coalesce(list_min(list_intersect(r.kept, q.xs)), q.k) FROM r JOIN q ON q.file = r.file AND q.k = r.k + 1),
m AS (SELECT n.*, into_ FROM r JOIN n USING (file, k))
SELECT file, arg_min(id, k) AS id, count(*) AS merged, bool_or(non_rejectable) AS non_rejectable, arg_min(tool, k) FILTER (tool IS NOT NULL) AS tool, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunks, array_to_string(list_sort(list(DISTINCT skill)), ',') AS skills FROM m GROUP BY file, into_""")
def deduped_findings(spark, sf_dir):
    """Findings of a file without repeats of a surer one, which takes over what they knew."""
    rows = findings(spark, sf_dir).select("file", "id", "start", "end", "category", "title", "confidence", "non_rejectable", F.array(F.expr("supp % 5")).alias("chunks"), F.array(F.expr("part % 6")).alias("skills"), F.expr("if(part % 3 = 0, analyzer, null)").alias("tool"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return greedy.dedupe(rows, ["file"]).select("file", "id", "merged", "non_rejectable", "tool", joined("chunks"), joined("skills"))
