"""Import resolution beyond the query's cases: inherited aliases, repositories without modules, other repositories, empty tables."""

from __future__ import annotations

from gleanline.operators import resolution

WANTED, FILES, CONFIGS = "repo string, file string, specifier string, names array<string>", "repo string, file string", "repo string, file string, content string"


def resolved(spark, wanted, files, configs=()):
    rows = [("r", f, s, n) for f, s, n in wanted]
    found = resolution.resolve(spark.createDataFrame(rows, WANTED), spark.createDataFrame([("r", f) for f in files] + [("other", "src/only.ts")], FILES), spark.createDataFrame([("r", f, c) for f, c in configs], CONFIGS))
    return {(r.file, r.specifier, r.target) for r in found.collect()}


def test_aliases_are_inherited_and_the_nearest_configuration_counts(spark):
    configs = [("base.json", "{}"), ("cfg/tsconfig.shared.json", '{"extends": "../tsconfig.root.json", "compilerOptions": {"paths": {"#x/*": ["./lib/*"]}}}'), ("tsconfig.root.json", '{"compilerOptions": {"baseUrl": "src"}}'), ("app/tsconfig.json", '{"extends": ["nope", "../cfg/tsconfig.shared"]}'), ("jsconfig.json", '{"compilerOptions": {"paths": {"y": ["${configDir}/src/y"]}}}')]
    files = ["src/lib/a.ts", "src/y.vue", "cfg/lib/a.ts", "app/deep/f.ts", "z/f.ts", "src/only.d.ts"]
    wanted = [("app/deep/f.ts", "#x/a", None), ("app/deep/f.ts", "y", None), ("z/f.ts", "y", None), ("z/f.ts", "#x/a", None), ("z/f.ts", "../src/only", None), ("z/f.ts", "./f", None)]
    # targets of paths start from the inherited baseUrl; a file that imports itself is no target
    assert resolved(spark, wanted, files, configs) == {("app/deep/f.ts", "#x/a", "src/lib/a.ts"), ("app/deep/f.ts", "y", "src/y.vue"), ("z/f.ts", "y", "src/y.vue"), ("z/f.ts", "../src/only", "src/only.d.ts")}


def test_go_without_modules_takes_the_only_directory_of_a_trailing_path(spark):
    files = ["a/store/x.go", "b/pkg/store/y.go", "b/pkg/store/y_test.go", "c/log/z.go", "d/log/z.go", "main.go"]
    wanted = [("main.go", "host.example/team/pkg/store", None), ("main.go", "host.example/x/log", None), ("main.go", "pkg/store", None), ("main.go", "host.example/team/c/log", None)]
    assert resolved(spark, wanted, files) == {("main.go", "host.example/team/pkg/store", "b/pkg/store/y.go"), ("main.go", "host.example/team/c/log", "c/log/z.go")}


def test_python_names_and_ambiguity(spark):
    files = ["pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "x/dup/m.py", "y/dup/m.py", "app/conf.py", "z/conf.py", "top.py", "src/top.py"]
    wanted = [("pkg/sub/b.py", "..", ["a", "nothing"]), ("pkg/a.py", "pkg.sub", ["b"]), ("pkg/a.py", "dup.m", None), ("pkg/a.py", "conf", None), ("pkg/a.py", "top", None), ("pkg/a.py", "....x", None)]
    assert resolved(spark, wanted, files) == {("pkg/sub/b.py", "..", "pkg/__init__.py"), ("pkg/sub/b.py", "..", "pkg/a.py"), ("pkg/a.py", "pkg.sub", "pkg/sub/b.py"), ("pkg/a.py", "conf", "app/conf.py"), ("pkg/a.py", "top", "top.py")}


def test_empty_tables(spark):
    assert resolved(spark, [], []) == set() and resolved(spark, [("a.ts", "./only", None)], []) == set()


def test_a_directory_is_resolved_once_for_all_its_files(spark, monkeypatch):
    asked, plain = [], resolution.script_candidates
    monkeypatch.setattr(resolution, "script_candidates", lambda wanted, configs: asked.append(wanted) or plain(wanted, configs))
    wanted = [(f"src/f{k}.ts", "./x", None) for k in range(5)] + [("src/x.ts", "./x", None), ("top.ts", "./src/x", None), ("top2.ts", "./src/x", None)]
    assert resolved(spark, wanted, ["src/x.ts"]) == {(f, s, "src/x.ts") for f, s, _ in wanted if f != "src/x.ts"}
    assert asked[0].count() == 2


def test_two_imports_of_one_module_keep_their_names_apart(spark):
    wanted = [("pkg/a.py", "lib", ["x"]), ("pkg/a.py", "lib", ["y"]), ("pkg/b.py", "lib", ["y"])]
    assert resolved(spark, wanted, ["lib/x.py", "lib/y.py"]) == {("pkg/a.py", "lib", "lib/x.py"), ("pkg/a.py", "lib", "lib/y.py"), ("pkg/b.py", "lib", "lib/y.py")}
