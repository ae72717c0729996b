"""Technologies out of file names and contents: what each kind of token proves, and what must not."""

from __future__ import annotations

import pytest

from gleanline.operators import detection

FILES = [
    ("r", "web/package.json", '{"dependencies": {"next": "14", "@kubernetes/client-node": "1"}, "devDependencies": {"vue": "3"}}'),
    ("r", "web/src/a.tsx", None), ("r", "web/src/b.ts", None), ("r", "web/next.config.mjs", None), ("r", "web/vite.config.ts", None),
    ("r", "web/examples/package.json", '{"dependencies": {"koa": "2"}}'),
    ("r", ".env", "export NEXT_PUBLIC_MONGODB_URI=mongodb+srv://x\n# REDIS_URL=redis://no\nPATH=postgres_x\n"),
    ("r", "Dockerfile", "ARG BASE=node\nARG TAG=22\nFROM registry.example:5000/library/${BASE}:${TAG} AS a\nFROM ${OTHER:-oven/bun}:1\nFROM a\n"),
    ("r", "ops/requirements/dev.txt", "Django_Thing==1"), ("r", "ops/app.py", None),
    ("r", "web/prisma/migrations/1/m.sql", None), ("r", "web/schema.prisma", 'provider = "cockroachdb"\n provider = "nothing"'),
    ("s", "only.go", None), ("s", "other.go", None), ("s", "README", "postgres://user@h"), ("s", "x/config/database.yml", "adapter: mysql2\nurl: neo4j://h"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = detection.evidence(spark.createDataFrame(FILES, "repo string, file string, content string")).collect()
    return {(r.repo, r.package, r.tech, r.signal): (round(r.weight, 6), r.wide) for r in rows}


def test_evidence(found):
    want = {
        ("r", "web", "framework.nextjs", "dep:npm:next"): (0.95, False), ("r", "web", "runtime.node", "dep:npm:next"): (0.6, False), ("r", "web", "infra.kubernetes", "dep:npm:@kubernetes/client-node"): (0.6, False), ("r", "web", "framework.vue", "dep:npm:vue"): (0.5, False),
        ("r", "web", "framework.react", "ext:.tsx"): (0.35, False), ("r", "web", "framework.nextjs", r"pattern:^next\.config\.(?:js|mjs|cjs|ts|mts)$"): (0.7, False), ("r", "web", "lang.typescript", "lang"): (0.75, False),
        ("r", "web/examples", "runtime.node", "dep:npm:koa"): (0.255, False), ("r", "web/examples", "framework.koa", "dep:npm:koa"): (0.27, False),
        ("r", ".", "db.mongodb", "scheme@0.7"): (0.7, True), ("r", ".", "db.mongodb", "env"): (0.4, True), ("r", ".", "infra.docker", "file:Dockerfile"): (0.9, True), ("r", ".", "runtime.node", "image@0.5"): (0.5, True), ("r", ".", "runtime.bun", "image@0.5"): (0.5, True),
        ("r", "ops", "lang.python", "lang"): (0.45, False), ("r", "web", "orm.prisma", "dir:(?:^|/)prisma/migrations$"): (0.6, False), ("r", "web", "orm.prisma", "ext:.prisma"): (0.9, False), ("r", "web", "db.cockroachdb", "setting:prisma-provider"): (0.95, False), ("r", "web", "lang.sql", "lang"): (0.45, False),
        ("s", ".", "lang.go", "lang"): (0.75, False), ("s", ".", "db.mysql", "setting:rails-adapter"): (0.95, False), ("s", ".", "db.neo4j", "scheme@0.8"): (0.8, True),
    }
    assert found == want


def test_scores_of_packages(spark):
    rows = {(r.repo, r.package, r.tech): (r.score, r.active) for r in detection.detect(spark.createDataFrame(FILES, "repo string, file string, content string")).collect()}
    assert rows["r", "web", "framework.nextjs"] == (round(1 - 0.05 * 0.3, 3), True) and rows["r", "web", "framework.react"] == rows["r", "web", "framework.nextjs"]  # implied beyond its own 0.35
    assert rows["r", "ops", "db.mongodb"] == (0.82, True) and ("s", ".", "db.mongodb") not in rows  # wide within its repository only
    assert ("r", "web/examples", "framework.koa") not in rows and rows["r", "web", "framework.vue"] == (0.5, False)


def test_further_signals_and_no_files(spark):
    more = detection.Signals(more=(("ext", ".zig", "lang.zig", "ext:.zig", 0.9, None),))
    assert [(r.tech, r.score) for r in detection.detect(spark.createDataFrame([("r", "a/b.zig", None)], "repo string, file string, content string"), more).collect()] == [("lang.zig", 0.9)]
    assert detection.detect(spark.createDataFrame([], "repo string, file string, content string")).collect() == []


@pytest.mark.parametrize(("ref", "name"), [("Postgres:16", "postgres"), ("a.b:5000/library/redis@sha256:0f", "redis"), ("localhost/x/y:1", "x/y"), ("library/mysql", "mysql"), ("team/kafka", "team/kafka")])
def test_image_names(spark, ref, name):
    assert spark.range(1).select(detection.image_name(detection.F.lit(ref))).first()[0] == name
