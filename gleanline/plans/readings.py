"""Queries over the files of repositories that are read, made from the driver's orders: a repository for each priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.operators import candidates
from gleanline.plans.facts import table
from gleanline.plans.registry import query

_PATH = "concat(CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/b/c/d/e/f/' WHEN 2 THEN 'app/' ELSE 'x/y/' END, 'd', CAST(o_orderkey AS {s}), '/', CASE o_orderkey % 6 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'seed.sql' WHEN 3 THEN 'Dockerfile' WHEN 4 THEN 'README.md' ELSE 'pom.xml' END)"


@query("read_candidates", f"""WITH RECURSIVE f AS (SELECT o_orderpriority AS run, {_PATH.replace("{s}", "VARCHAR")} AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE o_orderkey % 6 WHEN 0 THEN 'npm' WHEN 1 THEN 'gomod' WHEN 2 THEN 'sql' WHEN 3 THEN 'dockerfile' WHEN 5 THEN 'pom' END AS kind FROM orders),
c AS (SELECT *, len(string_split(path, '/')) - 1 AS depth, CASE kind WHEN 'dockerfile' THEN 4 WHEN 'sql' THEN 5 ELSE 1 END AS place, CASE kind WHEN 'npm' THEN 60 WHEN 'sql' THEN 5 WHEN 'dockerfile' THEN 10 ELSE 20 END AS share FROM f WHERE kind IS NOT NULL AND size <= 262144),
s AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY depth, path) > share AS spare FROM c WHERE depth <= 6),
o AS (SELECT run, path, kind, size, row_number() OVER (PARTITION BY run ORDER BY spare, place, depth, path) AS k FROM s WHERE NOT spare OR place = 1),
r AS (SELECT run, '' AS path, '' AS kind, 0::BIGINT AS k, false AS taken, 0::BIGINT AS n, 0::BIGINT AS held FROM o GROUP BY run UNION ALL
SELECT run, path, kind, k, fits, n + CAST(fits AS BIGINT), held + CASE WHEN fits THEN size ELSE 0 END FROM (SELECT o.*, r.n, r.held, r.n < 300 AND r.held + o.size <= 16777216 AS fits FROM r JOIN o ON o.run = r.run AND o.k = r.k + 1))
SELECT run, path, kind FROM r WHERE taken""")
def read_candidates(spark, sf_dir):
    """The files of each repository that are read within 300 files and 16 MiB: shares by kind, then spare manifests."""
    orders = table(spark, sf_dir, "orders")
    files = orders.select(F.col("o_orderpriority").alias("run"), F.expr(_PATH.replace("{s}", "STRING")).alias("path"), F.floor("o_totalprice").alias("size"))
    return candidates.pick(files, "run")
