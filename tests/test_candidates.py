"""Candidate files against a plain loop, and the allow-list of kinds."""

import random

from pyspark.sql import functions as F

from gleanline.operators import candidates
from gleanline.operators.candidates import KINDS, Limits

NAMES = ["package.json", "go.mod", "Gemfile", "schema.prisma", "a.sql", "b.sql", "Dockerfile", "x.py", "pnpm-workspace.yaml", "Pipfile"]


def plain(files, limits):
    place, share = {row[0]: row[1] for row in KINDS}, {row[0]: row[2] for row in KINDS}
    rows = sorted((place[k], path.count("/"), path, k, size) for path, k, size in files if k and path.count("/") <= limits.depth and size <= limits.file_bytes)
    seen, own, spare = {}, [], []
    for row in rows:
        seen[row[3]] = seen.get(row[3], 0) + 1
        if seen[row[3]] <= share[row[3]]:
            own.append(row)
        elif row[0] <= candidates.MANIFESTS:
            spare.append(row)
    taken, held = set(), 0
    for _, _, path, kind, size in own + spare:
        if len(taken) < limits.files and held + size <= limits.bytes:
            taken.add((path, kind))
            held += size
    return taken


def test_picks_as_a_plain_loop_does(spark):
    rng = random.Random(7)
    rows = {}
    for run, (n, sizes) in enumerate([(400, 50), (900, 4000), (3, 10), (700, 0), (1500, 900)]):
        for _ in range(n):
            path = "/".join([rng.choice("abcdefgh") for _ in range(rng.randrange(8))] + [rng.choice(NAMES)])
            rows[run, path] = rng.randrange(sizes + 1)
    falling = {(9, f"m{i:04}/package.json"): 2000 - i for i in range(1500)}  # no row is no larger than a later one
    rows |= falling
    rows = {(None if run == 0 else run, p): s for (run, p), s in rows.items()}
    files = spark.createDataFrame([(r, p, s) for (r, p), s in rows.items()] + [(0, None, 5)], "run long, path string, size long").withColumn("more", F.lit("x"))
    kinds = {r.path: r.kind for r in files.filter("path IS NOT NULL").select("path", candidates.kind_of(F.col("path")).alias("kind")).distinct().collect()}
    for limits in (Limits(40, 10**6, 10**6, 5), Limits(300, 60_000, 3000, 6), Limits(100, 100, 40, 9), Limits(70, 1999 * 62 + 7, 10**6, 9)):
        found = {(r.run, r.path, r.kind) for r in candidates.pick(files.repartition(5), "run", limits).collect()}
        want = {(run, *x) for run in {r for r, _ in rows} for x in plain([(p, kinds[p], s) for (r, p), s in rows.items() if r == run], limits)}
        assert found == want, limits


def test_thinning_keeps_little_of_a_hot_repository(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("run"), F.concat(F.lit("p"), "id", F.lit("/go.mod")).alias("path"), F.lit("gomod").alias("kind"), F.expr("id * 7919 % 1000").alias("_size"), F.lit(1).alias("_priority"), F.lit(1).alias("_depth"), F.lit(1).alias("_spare"))
    assert candidates.may_be_taken(rows, ["run"], Limits(files=20), parts=8).count() < 8 * 20 * 10
    assert candidates.may_be_taken(rows.withColumn("_size", F.lit(0).cast("long")), ["run"], Limits(files=20), parts=8).count() == 8 * 20


def test_empty_null_sizes_and_repeats(spark):
    kind = "run string, path string, size long"
    assert candidates.pick(spark.createDataFrame([], kind), "run").collect() == []
    rows = spark.createDataFrame([("a", "go.mod", None), ("a", "go.mod", 3), (None, "go.mod", 1), ("a", "", 1), ("a", "big/go.mod", 10**9), ("a", "1/2/3/4/5/6/7/go.mod", 1)], kind)
    assert {tuple(r) for r in candidates.pick(rows, "run").collect()} == {("a", "go.mod", "gomod"), (None, "go.mod", "gomod")}


def test_kinds_of_paths(spark):
    cases = {
        "gitattributes": ".gitattributes", "npm": "a/package.json", "requirements": "requirements.txt dev-requirements.in a/requirements-ci.txt requirements/base.txt", "version-file": "requirements/runtime.txt rust-toolchain .python-versions", "csproj": "a/B.CSPROJ x.vbproj", "nuget-props": "Directory.Build.props",
        "gradle": "build.gradle app/build.gradle.kts", "github-workflow": ".github/workflows/ci.yml", "ci": ".circleci/config.yml .gitlab-ci.yml", "compose": "compose.yaml x/docker-compose.dev.yml", "sam": "k8s/template.yaml", "django-settings": "a/settings/prod.py settings.py", "rails-db": "config/database.yml",
        "sequelize": "api/config/config.json", "dotnet-code": "AppContext.cs src/Program.cs", "spring-config": "application-dev.yml bootstrap.properties", "typeorm": "ormconfig.prod.ts ormconfig.json data-source.ts", "drizzle": "drizzle.config.ts drizzle.config.json", "knex": "knexfile.cjs", "prisma": "a.prisma",
        "terraform": "main.tf Dockerfile.tf", "env": ".env.example .env.local.sample env.template", "dockerfile": "Containerfile Dockerfile.dev web.Dockerfile", "k8s": "deploy/a/b.yml charts/x.YAML", "appsettings": "appsettings.Development.json", "sql": "db/a.SQL",
        None: "a/.gitattributes package.json.bak .prisma config.yml sub/.github/workflows/ci.yml config/x/database.yml .env my-package.json ormconfig.prod.json requirements.md",
    }
    paths = [(p, k) for k, ps in cases.items() for p in ps.split()]
    got = spark.createDataFrame(paths, "path string, want string").select("*", candidates.kind_of(F.col("path")).alias("got"))
    assert [tuple(r) for r in got.filter("NOT want <=> got").collect()] == []
