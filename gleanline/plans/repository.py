"""Queries over repository readers: imports, resolution, manifests, calls, JSON in replies, windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.plans.facts import table
from gleanline.plans.registry import query
from gleanline.sources import code
from gleanline.streaming import events

_K = "{k}"
#: language, text of a file, what it imports; {k} is the file's number.
SOURCES = [
    ("typescript", "import a, { b } from './x{k}'\nconst q = require(\"lib{k}\")\nexport * from '../y'\nawait import('./dyn')\n// from 'nothing'\njest.mock('./m{k}')", ["./x{k}", "lib{k}", "../y", "./dyn", "./m{k}"]),
    ("python", "from pkg.m{k} import a as b, c\nimport os, sys as s  # all\n  from . import z\nimportant = 1", ["pkg.m{k}", "os", "sys", "."]),
    ("go", "import (\n\t\"fmt\"\n\tal \"a/b{k}\"\n)\nimport \"net/http\"\n", ["fmt", "a/b{k}", "net/http"]),
    ("java", "import java.util.List;\nimport static a.B{k}.c;\nimport x.y.*;", ["java.util.List", "a.B{k}.c", "x.y"]),
    ("scala", "import a.b.{C{k}, D => E, _}", ["a.b.C{k}", "a.b.D", "a.b"]),
    ("csharp", "global using System.Text;\nusing static My.Tools{k};\nusing var x = 1;", ["System.Text", "My.Tools{k}"]),
    ("php", "use App\\Models\\User{k} as U, App\\B;\nuse function a\\b;\nrequire_once __DIR__ . '/c{k}.php';", ["App\\Models\\User{k}", "App\\B", "/c{k}.php"]),
    ("ruby", "require 'json'\nrequire_relative \"lib/a{k}\"", ["json", "lib/a{k}"]),
    ("rust", "mod parser;\npub use crate::a{k}::{b, self};\nuse std::io as i;", ["parser", "crate::a{k}::b", "crate::a{k}", "std::io"]),
    ("c", "#include <stdio.h>\n  #  include \"a{k}.h\"", ["stdio.h", "a{k}.h"]),
    ("dart", "import 'package:a/b{k}.dart';\npart of 'c.dart';", ["package:a/b{k}.dart", "c.dart"]),
    ("text", "import 'nothing'", []),
]
_N = len(SOURCES)
_q = lambda s: "'" + s.replace("'", "''") + "'"
_filled = lambda s: "replace(" + _q(s) + ", '{k}', p_partkey::VARCHAR)"


@query("imported", f"SELECT p_partkey, unnest(CASE p_partkey % {_N} " + " ".join(f"WHEN {k} THEN [{', '.join(map(_filled, s))}]::VARCHAR[]" for k, (_, _, s) in enumerate(SOURCES)) + " END) AS specifier FROM part")
def imported(spark, sf_dir):
    """The imports of files in eleven languages."""
    k = F.expr(f"p_partkey % {_N}")
    pick = lambda j: F.element_at(F.array(*(F.lit(s[j]) for s in SOURCES)), (k + 1).cast("int"))
    files = table(spark, sf_dir, "part").select("p_partkey", pick(0).alias("language"), F.replace(pick(1), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("content"))
    return code.imports(files).select("p_partkey", F.explode("imports").alias("specifier"))


@query("resolved_imports", """WITH f AS (SELECT DISTINCT concat('src/', p_size % 10, '/m', p_partkey % 60, CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END) AS file FROM part), w AS (SELECT DISTINCT concat('src/', p_size % 10, '/m', p_partkey % 60, '.ts') AS file, concat('../', p_partkey % 10, '/m', p_partkey % 71) AS specifier, concat('src/', p_partkey % 10, '/m', p_partkey % 71) AS stem FROM part WHERE p_partkey % 3 = 0)
SELECT w.file, specifier, f.file AS target FROM w JOIN f ON f.file IN (concat(stem, '.ts'), concat(stem, '.js'), concat(stem, '/index.ts')) QUALIFY row_number() OVER (PARTITION BY w.file, specifier ORDER BY CASE WHEN f.file = concat(stem, '.ts') THEN 0 WHEN f.file = concat(stem, '.js') THEN 1 ELSE 2 END) = 1""")
def resolved_imports(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    files = part.select(F.expr("concat('src/', string(p_size % 10), '/m', string(p_partkey % 60), case p_partkey % 3 when 0 then '.ts' when 1 then '.js' else '/index.ts' end)").alias("file"))
    wanted = part.filter("p_partkey % 3 = 0").select(F.expr("concat('src/', string(p_size % 10), '/m', string(p_partkey % 60), '.ts')").alias("file"), F.expr("concat('../', string(p_partkey % 10), '/m', string(p_partkey % 71))").alias("specifier")).distinct()
    return code.resolve(wanted, files)


MANIFESTS = [
    ("package.json", '{"name": "x", "dependencies": {"react": "^{k}.1"}, "devDependencies": {"jest": "~29"}}', [("react", "^{k}.1"), ("jest", "~29")]),
    ("requirements-dev.txt", "# all\nDjango_Rest[extra] >={k},<99 ; python_version > '3'\nflask\n", [("django-rest", ">={k},<99"), ("flask", "")]),
    ("go.mod", "module a/b\n\ngo 1.22\n\nrequire x.y/z v1.{k}.0\nrequire (\n\tq.r/s v0.2.0 // indirect\n)\n", [("x.y/z", "v1.{k}.0"), ("q.r/s", "v0.2.0")]),
    ("Gemfile", "source 'https://rubygems.org'\ngem 'rails', '~> {k}.1'\n  gem \"pg\"\n", [("rails", "~> {k}.1"), ("pg", "")]),
    ("Cargo.toml", "[package]\nname = \"p\"\nversion = \"1.0\"\n[dependencies]\nserde = \"1.{k}\"\ntokio = { version = \"1.2\", features = [\"full\"] }\n[features]\na = \"b\"\n", [("serde", "1.{k}"), ("tokio", "1.2")]),
    ("composer.json", '{"require": {"php": ">=8.{k}"}, "require-dev": {"phpunit/phpunit": "^10"}}', [("php", ">=8.{k}"), ("phpunit/phpunit", "^10")]),
    ("pubspec.yaml", "name: a\ndependencies:\n  http: ^1.{k}\ndev_dependencies:\n  test: any\n", [("http", "^1.{k}"), ("test", "any")]),
    ("mix.exs", 'defp deps do\n [{:phoenix, "~> 1.{k}"}, {:jason, ">= 1.0.0", only: :dev}]\nend', [("phoenix", "~> 1.{k}"), ("jason", ">= 1.0.0")]),
    ("App.csproj", '<Project><ItemGroup><PackageReference Include="Dapper" Version="2.{k}" /></ItemGroup></Project>', [("Dapper", "2.{k}")]),
    ("build.gradle.kts", "dependencies {\n  implementation(\"a.b:c:{k}.0\")\n  testImplementation 'd.e:f:1'\n}", [("a.b:c", "{k}.0"), ("d.e:f", "1")]),
    ("pom.xml", "<dependencies><dependency><groupId>g</groupId><artifactId>core</artifactId><version>{k}.5</version></dependency></dependencies>", [("core", "{k}.5")]),
    ("notes.md", "gem 'none'", []),
]


@query("manifest_dependencies", f"WITH e AS (SELECT p_partkey, unnest(CASE p_partkey % {len(MANIFESTS)} " + " ".join(f"WHEN {k} THEN [{', '.join('{' + chr(39) + 'n' + chr(39) + ': ' + _filled(n) + ', ' + chr(39) + 's' + chr(39) + ': ' + _filled(s) + '}' for n, s in d)}]" for k, (_, _, d) in enumerate(MANIFESTS) if d) + " END) AS d FROM part) SELECT p_partkey, d.n AS name, d.s AS spec FROM e")
def manifest_dependencies(spark, sf_dir):
    """The dependencies of eleven kinds of manifests."""
    k = F.expr(f"p_partkey % {len(MANIFESTS)}")
    pick = lambda j: F.element_at(F.array(*(F.lit(s[j]) for s in MANIFESTS)), (k + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit("/"), pick(0)).alias("file"), F.replace(pick(1), F.lit("{k}"), key).alias("content"))
    return code.dependencies(files).select(F.regexp_extract("file", "^p([0-9]+)/", 1).cast("long").alias("p_partkey"), "name", "spec")


@query("called_names", "WITH l AS (SELECT doc_id, unnest([concat('x = alpha', doc_id % 5, '(beta(1), if (y))'), 'return (z)', 'alpha_two (q)']) AS line FROM documents), c AS (SELECT doc_id, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1)) AS name FROM l) SELECT name, count(DISTINCT doc_id) AS files FROM c WHERE length(name) >= 3 AND name <> 'return' GROUP BY name")
def called_names(spark, sf_dir):
    lines = F.array(F.concat(F.lit("x = alpha"), F.expr("string(doc_id % 5)"), F.lit("(beta(1), if (y))")), F.lit("return (z)"), F.lit("alpha_two (q)"))
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(code.calls(lines)).alias("name"))
    return each.groupBy("name").agg(F.countDistinct("doc_id").alias("files"))


@query("reply_json", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('{"a":', event_id, '}') WHEN 1 THEN concat('[1,', event_id, ']') WHEN 2 THEN concat('{"b":"}","k":', event_id, '}') WHEN 3 THEN NULL ELSE concat('{"last":', event_id, '}') END AS found FROM events""")
def reply_json(spark, sf_dir):
    """Replies with a fenced block, a trailing comma, brackets in text, no JSON, and several blocks."""
    k = F.col("event_id").cast("string")
    texts = [("Sure:\n```json\n{{\"a\": {}}}\n```\nBye [1]"), ("See [1, {},] and {{x}}"), ("It says \"odd {{ and then {{\"k\": {}, \"b\": \"}}\"}}"), ("none {} ]"), ("```\n{{\"first\": 1}}\n```\n```json\n{{\"last\": {}}}\n```\n```\nbroken {{\n```")]
    parts = [t.format("\0").split("\0") for t in texts]
    text = F.coalesce(*(F.when(F.expr("event_id % 5") == i, F.concat(F.lit(p[0]), k, F.lit(p[1]))) for i, p in enumerate(parts)))
    return table(spark, sf_dir, "events").select("event_id", code.extract_json(text).alias("found"))


@query("file_units", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'excluded' WHEN doc_id % 7 = 1 THEN 'too large' WHEN doc_id % 5 = 2 THEN 'binary' END AS skipped, CASE WHEN NOT (doc_id % 9 = 0 OR doc_id % 7 = 1 OR doc_id % 5 = 2) THEN 'python' END AS language FROM documents")
def file_units(spark, sf_dir):
    path = F.concat(F.expr("if(doc_id % 9 = 0, 'vendor/', 'src/')"), F.col("doc_id").cast("string"), F.lit(".py"))
    body = F.concat(F.lit("x"), F.expr("if(doc_id % 5 = 2, '\\0', '')"), F.coalesce("text", F.lit("")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.expr("if(doc_id % 7 = 1, 600000L, 10L)").alias("length"), F.encode(body, "UTF-8").alias("content"))
    return code.units(files.drop("doc_id"), ["vendor/**"]).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), "skipped", "language")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Counts by hour and type: the batch form of the stream."""
    rows = events.window_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "10 minutes", measures=[F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")])
    return rows.select("start", "event_type", "n", "total")
