"""Imports of files that documents make, resolved in seven languages; the twin names each specifier's targets by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.operators import resolution
from gleanline.operators.graph import cut
from gleanline.plans.facts import table
from gleanline.plans.registry import query

#: The files that stand in every (source, language): path and, for configurations, content. {L} is the language.
TREE = [
    ("web/tsconfig.json", '{\n  // aliases\n  "extends": "./tsconfig.base",\n  "compilerOptions": {"baseUrl": "src",},\n}'),
    ("web/tsconfig.base.json", '{"compilerOptions": {"baseUrl": "nowhere", "paths": {"@/*": ["../src/*", "../gen/*"], "@/lib/*": ["../src/deep/*"], "exact": ["a.ts"], "~*.css": ["../styles/*.css"]}}}'),
    ("web/src/a.ts", None), ("web/src/lib/index.tsx", None), ("web/src/c.ts", None), ("web/src/c.js", None), ("web/src/t.d.ts", None), ("web/gen/only.ts", None), ("web/src/deep/x.ts", None), ("web/src/deep/index.js", None), ("web/styles/m.css", None), ("web/src/index.ts", None),
    ("pkgs/ui/package.json", '{"name": "@{L}/ui", "main": "dist/main.js", "exports": {".": {"types": "./dist/types.d.ts", "default": "./dist/main.js"}, "./icons/*": "./lib/icons/*.tsx"}}'), ("pkgs/ui/src/main.ts", None), ("pkgs/ui/src/icons/star.tsx", None), ("pkgs/ui/src/util.ts", None),
    ("go/go.mod", "module example.com/{L}\n\ngo 1.22\n"), ("go/main.go", None), ("go/pkg/store/s.go", None), ("go/pkg/store/s_test.go", None), ("go/pkg/store/t.go", None), ("go/tools/go.mod", 'module "example.com/{L}/tools"'), ("go/tools/gen/g.go", None), ("go/pkg/tools/gen/wrong.go", None),
    ("py/app/core/__init__.py", None), ("py/app/core/db.py", None), ("py/app/util.py", None), ("py/app/util/__init__.py", None), ("py/src/shared_{L}/log.py", None), ("py/other/shared_{L}/log.py", None), ("py/deep/lone_{L}/mod.pyi", None), ("py/__init__.py", None),
    ("php/composer.json", '{"autoload": {"psr-4": {"App{L}\\\\": "src/", "App{L}\\\\Deep\\\\": ["lib/a", "lib/b"]}}}'), ("php/src/User.php", None), ("php/src/Deep/Both.php", None), ("php/lib/b/Both.php", None), ("php/src/Deep/Only.php", None),
    ("dart/pubspec.yaml", "name: d{L}\n"), ("dart/lib/x/y.dart", None), ("c/include/api.h", None), ("c/src/api.h", None), ("c/src/own.h", None),
]
# By hand: (importer, specifier, imported names, targets), all seen from the tree's top.
CASES = [
    ("web/src/sub/f{m}.ts", "../c.js", "", ["web/src/c.js"]), ("web/src/sub/f{m}.ts", "../lib", "", ["web/src/lib/index.tsx"]), ("web/src/sub/f{m}.ts", "../t?raw", "", ["web/src/t.d.ts"]), ("web/src/sub/f{m}.ts", "..", "", ["web/src/index.ts"]), ("web/src/sub/f{m}.ts", "../deep/", "", ["web/src/deep/index.js"]), ("web/src/sub/f{m}.ts", "../../../../../../../out", "", []),
    ("web/src/sub/f{m}.ts", "@/a", "", ["web/src/a.ts"]), ("web/src/sub/f{m}.ts", "@/only", "", ["web/gen/only.ts"]), ("web/src/sub/f{m}.ts", "@/lib/x", "", ["web/src/deep/x.ts"]), ("web/src/sub/f{m}.ts", "@/lib/index", "", ["web/src/deep/index.js"]), ("web/src/sub/f{m}.ts", "exact", "", ["web/src/a.ts"]), ("web/src/sub/f{m}.ts", "~m.css", "", ["web/styles/m.css"]), ("web/src/sub/f{m}.ts", "deep/x.js", "", ["web/src/deep/x.ts"]),
    ("web/src/sub/f{m}.ts", "@/nothing", "", []), ("web/src/sub/f{m}.ts", "node:fs", "", []), ("web/src/sub/f{m}.ts", "react", "", []), ("pkgs/ui/f{m}.tsx", "@/a", "", []), ("pkgs/ui/f{m}.tsx", "./src/util", "", ["pkgs/ui/src/util.ts"]),
    ("web/src/sub/f{m}.ts", "@{L}/ui", "", ["pkgs/ui/src/main.ts"]), ("web/src/sub/f{m}.ts", "@{L}/ui/icons/star", "", ["pkgs/ui/src/icons/star.tsx"]), ("web/src/sub/f{m}.ts", "@{L}/ui/util", "", ["pkgs/ui/src/util.ts"]), ("web/src/sub/f{m}.ts", "@{L}/uix", "", []),
    ("go/cmd/f{m}.go", "example.com/{L}/pkg/store", "", ["go/pkg/store/s.go", "go/pkg/store/t.go"]), ("go/cmd/f{m}.go", "example.com/{L}/tools/gen", "", ["go/tools/gen/g.go"]), ("go/cmd/f{m}.go", "example.com/{L}", "", ["go/main.go"]), ("go/cmd/f{m}.go", "fmt", "", []), ("go/cmd/f{m}.go", "example.com/{L}x/pkg/store", "", []),
    ("py/app/web/f{m}.py", "..core", "db missing", ["py/app/core/__init__.py", "py/app/core/db.py"]), ("py/app/web/f{m}.py", "..util", "", ["py/app/util.py"]), ("py/app/web/f{m}.py", "...", "", ["py/__init__.py"]), ("py/app/web/f{m}.py", "core.db", "", ["py/app/core/db.py"]), ("py/app/web/f{m}.py", "util", "", ["py/app/util.py"]),
    ("py/app/web/f{m}.py", "shared_{L}.log", "", ["py/src/shared_{L}/log.py"]), ("py/app/web/f{m}.py", "lone_{L}", "mod", ["py/deep/lone_{L}/mod.pyi"]), ("py/app/web/f{m}.py", "os.path", "", []), ("py/app/web/f{m}.py", ".nothing", "a", []),
    ("php/f{m}.php", "App{L}\\User", "", ["php/src/User.php"]), ("php/f{m}.php", "\\App{L}\\Deep\\Both", "", ["php/lib/b/Both.php"]), ("php/f{m}.php", "App{L}\\Deep\\Only", "", ["php/src/Deep/Only.php"]), ("php/f{m}.php", "Other\\User", "", []),
    ("dart/bin/f{m}.dart", "package:d{L}/x/y.dart", "", ["dart/lib/x/y.dart"]), ("dart/bin/f{m}.dart", "../lib/x/y.dart", "", ["dart/lib/x/y.dart"]), ("dart/bin/f{m}.dart", "dart:io", "", []), ("c/src/f{m}.c", "api.h", "", ["c/src/api.h"]), ("c/src/f{m}.c", "../include/api.h", "", ["c/include/api.h"]), ("c/src/f{m}.c", "stdio.h", "", []),
]
_text = lambda s: "'" + s.replace("'", "''") + "'"
_each = lambda s: f"replace(replace({s}, '{{L}}', lang), '{{m}}', m)"
_TARGETS = ", ".join(f"({_text(f)}, {_text(s)}, {_text(t)})" for f, s, _, ts in CASES for t in ts)


def tree(spark, sf_dir):
    """(repo, file, content): the tree of each language of a source, on top of it the files that import, one a document's size."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), "lang", F.col("n_chars").cast("string").alias("m"))
    fill = lambda c: F.replace(F.replace(c, F.lit("{L}"), F.col("lang")), F.lit("{m}"), F.col("m"))
    standing = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(c).cast("string").alias("c")) for p, c in TREE))
    importers = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(None).cast("string").alias("c")) for p in dict.fromkeys(f for f, *_ in CASES)))
    rows = docs.select("repo", "lang").distinct().withColumn("m", F.lit("")).select("repo", "lang", "m", F.explode(standing).alias("x")).unionByName(docs.distinct().select("repo", "lang", "m", F.explode(importers).alias("x")))
    return cut(rows.select("repo", F.concat_ws("/", "lang", fill(F.col("x.p"))).alias("file"), fill(F.col("x.c")).alias("content")).distinct())


@query("import_resolution", f"""WITH d AS (SELECT DISTINCT source AS repo, lang, n_chars::VARCHAR AS m FROM documents), c(f, s, t) AS (VALUES {_TARGETS})
SELECT DISTINCT repo, concat(lang, '/', {_each('f')}) AS file, {_each('s')} AS specifier, concat(lang, '/', {_each('t')}) AS target FROM d, c""")
def import_resolution(spark, sf_dir):
    """What files import, in seven languages: relative paths, aliases, workspaces, modules, source roots, namespaces; misses and ambiguous names included."""
    files = tree(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), "lang", F.col("n_chars").cast("string").alias("m")).distinct()
    fill = lambda c: F.replace(F.replace(c, F.lit("{L}"), F.col("lang")), F.lit("{m}"), F.col("m"))
    cases = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(s).alias("s"), F.lit(n).alias("n")) for f, s, n, _ in CASES))
    wanted = docs.select("repo", "lang", "m", F.explode(cases).alias("x")).select("repo", F.concat_ws("/", "lang", fill(F.col("x.f"))).alias("file"), fill(F.col("x.s")).alias("specifier"), F.when(F.col("x.n") != "", F.split("x.n", " ")).alias("names"))
    return resolution.resolve(wanted, files.select("repo", "file"), files.filter("content IS NOT NULL"))
