"""Technologies of repositories whose files are made from documents; the twin says by hand what each template of a file proves."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.functions.text import half_up
from gleanline.operators import detection
from gleanline.operators.graph import cut
from gleanline.plans.facts import table
from gleanline.plans.registry import query

#: (path, content): {lang} is the document's language, {n} and {m} its size in characters modulo 7 and itself, {text} the beginning of its text.
TEMPLATES = [
    ("{lang}/app{n}/package.json", '{"name": "app", "dependencies": {"next": "^14.1", "left-pad": "1"}, "devDependencies": {"typescript": "5", "express": "4"}}'),
    ("{lang}/docker/Dockerfile", "ARG V=16\n# {text}\nFROM --platform=linux/amd64 docker.io/library/postgres:${V}\nRUN x\nFROM ${BASE:-node:22}-slim AS b"),
    (".env.example", "# {text}\nDATABASE_URL=postgresql+asyncpg://u@h/db\nexport VITE_SUPABASE_KEY=x\nCACHE=\"rediss://h\"\nDB_CONNECTION=mysql\nNOTE=none"),
    ("docker-compose.yml", "services:\n  # {text}\n  db:\n    image: \"mcr.example:5000/mssql/server:2022\"\n  q:\n    image: rabbitmq@sha256:0abc\n    environment: [U=amqp://q]"),
    ("{lang}/infra/main.tf", 'provider "aws" {\n  # {text}\n}\nprovider "google-beta" {}'),
    ("examples/{lang}/schema.prisma", 'datasource db {\n  provider = "mongodb"\n  // {text}\n}'),
    ("py/{lang}/src/f{m}.py", "# {text}\nimport os"),
    ("py/{lang}/requirements.txt", "# {text}\nopenai>=1\nkubernetes[x] ; python_version > '3'\nansible"),
    (".github/workflows/w{n}.yml", "jobs:\n  # {text}\n  t:\n    services:\n      - image: redis:7"),
    ("deploy/{lang}/k8s/web.yaml", "containers:\n- image: quay.example/team/kafka:3\n  # {text}"),
    ("py/{lang}/app/settings.py", "DATABASES = {'default': {'ENGINE': 'django.db.backends.sqlite3'}}\n# {text}"),
    ("go/{lang}/go.mod", "module example.com/{lang}\n\nrequire k8s.io/client-go v0.29.0\n// {text}"),
    ("docs/{lang}/Chart.yaml", "name: {text}"),
]
# By hand: (template, technology, signal, weight, for the whole repository if at the root). Sample directories count 0.3 of it.
PROVES = [
    (0, "framework.nextjs", "dep next", 0.95, 0), (0, "runtime.node", "dep next", 0.6, 0), (0, "lang.typescript", "dep typescript", 0.7, 0), (0, "framework.express", "dep express", 0.5, 0), (0, "runtime.node", "dep express", 0.5, 0),
    (1, "infra.docker", "Dockerfile", 0.9, 1), (1, "db.postgresql", "image 0.5", 0.5, 1), (1, "runtime.node", "image 0.5", 0.5, 1),
    (2, "db.postgresql", "scheme 0.7", 0.7, 1), (2, "db.redis", "scheme 0.7", 0.7, 1), (2, "cloud.supabase", "env", 0.5, 1), (2, "db.mysql", "DB_CONNECTION", 0.9, 1),
    (3, "infra.docker", "compose", 0.8, 1), (3, "db.sqlserver", "image 0.8", 0.8, 1), (3, "tool.rabbitmq", "image 0.8", 0.8, 1), (3, "tool.rabbitmq", "scheme 0.6", 0.6, 1),
    (4, "infra.terraform", ".tf", 0.9, 1), (4, "cloud.aws", "provider", 0.8, 1), (4, "cloud.gcp", "provider", 0.8, 1), (5, "orm.prisma", ".prisma", 0.9, 0), (5, "db.mongodb", "provider", 0.95, 0),
    (7, "lang.python", "requirements", 0.7, 0), (7, "ai.llm", "dep openai", 0.9, 0), (7, "infra.kubernetes", "dep kubernetes", 0.6, 0), (7, "infra.ansible", "dep ansible", 0.8, 0), (8, "ci.github-actions", "directory", 0.95, 1), (8, "db.redis", "image 0.6", 0.6, 1),
    (9, "infra.kubernetes", "directory", 0.6, 1), (9, "tool.kafka", "image 0.5", 0.5, 1), (10, "db.sqlite", "engine", 0.95, 0), (11, "lang.go", "go.mod", 0.9, 0), (11, "infra.kubernetes", "dep client-go", 0.7, 0), (12, "infra.helm", "Chart", 0.95, 1),
]
_N = len(TEMPLATES)
_text = lambda s: "'" + s.replace("'", "''") + "'"


def _filled(template: str) -> str:
    """A template's SQL in DuckDB."""
    out = _text(template)
    for mark, value in (("{lang}", "lang"), ("{n}", "n"), ("{m}", "m")):
        out = f"replace({out}, '{mark}', {value})"
    return out


#: d: a document as a file, r: the files' paths, k: each with its package (manifests lie in app*/, py/{lang} and go/{lang}); s: scores before implications.
_SQL = f"""WITH d AS (SELECT DISTINCT source AS repo, lang, (n_chars % 7)::VARCHAR AS n, n_chars::VARCHAR AS m, n_chars % {_N} AS t FROM documents WHERE n_chars IS NOT NULL),
r AS (SELECT DISTINCT repo, lang, t, CASE t {' '.join(f'WHEN {k} THEN {_filled(p)}' for k, (p, _) in enumerate(TEMPLATES))} END AS file FROM d),
k AS (SELECT *, CASE WHEN t IN (0, 11) OR (t IN (6, 7, 10) AND EXISTS (SELECT 1 FROM r x WHERE x.repo = r.repo AND x.lang = r.lang AND x.t = 7)) THEN CASE WHEN t = 0 THEN regexp_replace(file, '/[^/]*$', '') WHEN t = 11 THEN concat('go/', lang) ELSE concat('py/', lang) END ELSE '.' END AS package,
  CASE WHEN t IN (5, 12) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS damp FROM r),
v(t, tech, signal, w, wide) AS (VALUES {', '.join(f"({t}, '{tech}', '{s}', {w}::DOUBLE, {bool(g)})" for t, tech, s, w, g in PROVES)}),
py AS (SELECT repo, package, count(*) AS n FROM k WHERE t IN (6, 10) GROUP BY ALL),
e AS (SELECT repo, package, tech, signal, max(w * damp) AS w, wide AND package = '.' AS wide FROM k JOIN v USING (t) GROUP BY ALL
  UNION ALL SELECT repo, package, 'lang.python', 'files', CASE WHEN n >= 10 THEN 0.9::DOUBLE WHEN n >= 2 THEN 0.75::DOUBLE ELSE 0.45::DOUBLE END, false FROM py)"""
_SCORED = f"""{_SQL}, p AS (SELECT DISTINCT repo, package FROM k UNION SELECT repo, '.' FROM k), a AS (SELECT repo, package, tech, signal, w FROM e WHERE NOT wide UNION ALL SELECT e.repo, p.package, tech, signal, w FROM e JOIN p USING (repo) WHERE wide),
m AS (SELECT repo, package, tech, signal, max(w) AS w FROM a GROUP BY ALL), s AS (SELECT repo, package, tech, 1 - list_reduce(list_prepend(1.0::DOUBLE, list(1 - least(w, 0.999) ORDER BY signal)), lambda x, y: x * y) AS score FROM m GROUP BY ALL),
i(tech, implies) AS (VALUES ('framework.nextjs', 'framework.react'), ('cloud.supabase', 'db.postgresql'), ('infra.helm', 'infra.kubernetes')),
f AS (SELECT repo, package, tech, floor(max(score) * 1000 + 0.5) / 1000 AS score FROM (SELECT * FROM s UNION ALL SELECT repo, package, implies, score FROM s JOIN i USING (tech)) GROUP BY ALL)"""


def repositories(spark, sf_dir):
    """(repo, file, content): a document is a file of the repository its source names; its size picks the template, its text is part of the content."""
    docs = table(spark, sf_dir, "documents").filter("n_chars IS NOT NULL").withColumn("_t", F.expr(f"n_chars % {_N}"))
    beginning = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), r"[^\p{L} .,]", " ")

    def filled(template):
        out = F.lit(template)
        for mark, value in (("{lang}", F.col("lang")), ("{n}", F.expr("string(n_chars % 7)")), ("{m}", F.col("n_chars").cast("string")), ("{text}", beginning)):
            out = F.replace(out, F.lit(mark), value)
        return out

    choose = lambda k: F.coalesce(*(F.when(F.col("_t") == n, filled(t[k])) for n, t in enumerate(TEMPLATES)))
    # documents that make the same path are one file; the table is cut, as it is read by name, by content and by language
    return cut(docs.select(F.col("source").alias("repo"), choose(0).alias("file"), choose(1).alias("content")).groupBy("repo", "file").agg(F.min("content").alias("content")))


@query("stack_evidence", f"{_SQL} SELECT repo, package, tech, count(*) AS signals, floor(max(w) * 1e9 + 0.5) / 1e9 AS strongest, bool_or(wide) AS wide FROM e GROUP BY repo, package, tech")
def stack_evidence(spark, sf_dir):
    """How many signals speak for each technology of each package, and how strongly, read from the files' names and contents."""
    found = detection.evidence(repositories(spark, sf_dir))
    return found.groupBy("repo", "package", "tech").agg(F.count(F.lit(1)).alias("signals"), half_up(F.max("weight"), 9).alias("strongest"), F.bool_or("wide").alias("wide"))


@query("detected_stack", f"{_SCORED} SELECT repo, package, tech, score, score >= 0.6 AS active FROM f WHERE score >= 0.3")
def detected_stack(spark, sf_dir):
    """From file contents to the technologies of each package: tokens, evidence, noisy-or, implications."""
    return detection.detect(repositories(spark, sf_dir))
