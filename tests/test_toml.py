"""The TOML reader against Python's own, and the readers of version and lock files."""

from __future__ import annotations

import tomllib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gleanline.sources import toml

HARD = '''# a comment [not a table
title = "a # b [ ] \\" { }"   # behind
'single' = 'C:\\dir'
[project]
name = "x"
requires-python = ">=3.10,<4"
dependencies = [  # opened
  "Django_Rest[argon2]>=5.0 ; python_version > '3.9'",  # why ]
  'flask',
  "at @ https://x/y.whl",
]
[project.optional-dependencies]
test = ["pytest (>=8)", "x[y]~=1.0 --hash=sha256:1"]
[ tool . "poetry" . dependencies ]
python = "^3.11"
requests = { version = "^2.0", extras = ["a]", "b = 1"] }
deep.version = "1.5"
local = { path = "../x", version = 3 }
[tool.poetry.group.docs.dependencies.sphinx]
version = "7"
[[tool.uv.index]]
url = "u1"
[[tool.uv.index]]
url = "u2"
[tool.uv]
dev-dependencies = []
text = """
one = "two"
[three]
"""
'''


def read(spark, *files):
    return spark.createDataFrame(list(files), "file string, content string")


def test_python_manifests(spark):
    rows = {tuple(r)[2:] for r in toml.dependencies(read(spark, ("a/pyproject.toml", HARD))).collect()}
    assert rows == {("django-rest", ">=5.0", False), ("flask", None, False), ("at", None, False), ("pytest", ">=8", True), ("x", "~=1.0", True), ("requests", "^2.0", False), ("deep", "1.5", False), ("local", None, False), ("sphinx", "7", True)}
    versions = {tuple(r) for r in toml.toml_versions(read(spark, ("a/pyproject.toml", HARD), ("Pipfile", '[requires]\npython_version = "3.12"\n'), ("Cargo.toml", '[package]\nrust-version = "1.70"\n'))).collect()}
    assert versions == {("a/pyproject.toml", "lang.python", "3.10", "requires-python"), ("a/pyproject.toml", "lang.python", "3.11", "tool.poetry python"), ("Pipfile", "lang.python", "3.12", "Pipfile python_version"), ("Cargo.toml", "lang.rust", "1.70", "rust-version")}


def test_crates_and_catalogs(spark):
    cargo = '[dependencies]\nserde = { version = "1", features = ["derive", "rc"] }\nmine = { package = "real", version = "2" }\ngit = { git = "https://x" }\n[target."cfg(unix)".dev-dependencies]\nnix = "0.2"\n[features]\na = ["b"]\n'
    catalog = '[versions]\nk = "1.9"\nr = { strictly = "3" }\n[libraries]\na = "g:a:1"\nb = { module = "g:b", version.ref = "k" }\nc = { group = "g", name = "c", version = { ref = "r" } }\nd = { module = "g:d", version = { require = "4" } }\ne = { module = "g:e", version.ref = "none" }\n[plugins]\np = { id = "x.y", version.ref = "k" }\nq = "z:7"\n'
    got = {tuple(r) for r in toml.dependencies(read(spark, ("Cargo.toml", cargo), ("gradle/libs.versions.toml", catalog))).drop("file").collect()}
    crates = {("serde", "1", False), ("serde[derive]", None, False), ("serde[rc]", None, False), ("real", "2", False), ("git", None, False), ("nix", "0.2", True)}
    jars = {("g:a", "1"), ("g:b", "1.9"), ("g:c", "3"), ("g:d", "4"), ("g:e", None), ("plugin:x.y", "1.9"), ("plugin:z", "7")}
    assert got == {("cargo", *c) for c in crates} | {("maven", *j, False) for j in jars}


def test_tables_and_broken_files(spark):
    rows = toml.entries(read(spark, ("t", HARD), ("open", "a = [1, 2\nb = 1"), ("closed", "a = 1]\n"), ("quote", 'a = "x\nb = "y"'), ("word", "a = 1\nb\n"), ("header", "[a b]\nc = 1"), ("empty", ""), ("none", None), ("crlf", "[a]\r\nb = 'c'\r\n"))).collect()
    assert {r.file for r in rows} == {"t", "crlf"}
    assert [(r.element, r.value) for r in rows if r.path[-1] == "url"] == [(1, "u1"), (2, "u2")]
    assert next(r.value for r in rows if r.path == ["tool", "uv", "text"]) == 'one = "two"\n[three]\n'
    assert next(r.value for r in rows if r.path == ["title"]) == 'a # b [ ] " { }'
    assert next(r["items"] for r in rows if r.path[-1] == "extras") == ["a]", "b = 1"]


def test_long_files(spark):
    many = "[dependencies]\n" + "".join(f'c{k} = {{ version = "{k}" }} # {"[" * 20}\n' for k in range(4000)) + 'd = "' + "x\\\\" * 30000 + '"\n[t]\nlist = [' + '"y", \n' * 20000 + "]\n"
    assert toml.dependencies(read(spark, ("Cargo.toml", many))).count() == 4001
    assert [len(r["items"]) for r in toml.entries(read(spark, ("x", many))).filter("path[1] = 'list'").collect()] == [20000]


names = st.from_regex(r"[a-z][a-z0-9_-]{0,5}", fullmatch=True)
texts = st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=12)
quoted = st.builds(lambda t: ('"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'), texts) | st.builds(lambda t: "'" + t.replace("'", "") + "'", texts)
arrays = st.builds(lambda xs, sep: "[" + sep.join(xs) + "]", st.lists(quoted, max_size=4), st.sampled_from([", ", ",\n  ", ", # [ \"\n"]))
values = quoted | arrays | st.integers(0, 99).map(str) | st.builds(lambda d: "{ " + ", ".join(f"{k} = {v}" for k, v in d.items()) + " }", st.dictionaries(names, quoted | st.integers(0, 9).map(str), min_size=1, max_size=3))
tables = st.dictionaries(names, st.dictionaries(names, values, max_size=4), max_size=4)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(tables, min_size=30, max_size=40))
def test_like_pythons_reader(spark, docs):
    sources = ["".join(f"[{t}] # {t}\n" + "".join(f"{k} = {v}\n" for k, v in d.items()) for t, d in doc.items()) for doc in docs]

    def leaves(value, path):
        if isinstance(value, dict):
            return [x for k, v in value.items() for x in leaves(v, (*path, k))]
        return [(path, value if isinstance(value, str) else None, tuple(value) if isinstance(value, list) else None)]

    rows = toml.entries(read(spark, *((str(k), s) for k, s in enumerate(sources)))).filter("NOT startswith(raw, '{')").collect()
    got = sorted(((r.file, tuple(r.path), r.value, tuple(r["items"]) if r["items"] is not None else None) for r in rows), key=repr)
    want = sorted(((str(k), *x) for k, s in enumerate(sources) for x in leaves(tomllib.loads(s), ())), key=repr)
    assert got == want


def test_version_files_and_locks(spark):
    files = [(".nvmrc", "# x\nlts/iron\n"), ("a/.node-version", "v22.1.0"), (".python-version", "3.12.4\ncpython@3.11\npypy3.10-7.3\n"), ("runtime.txt", "python-3.9.1"), (".ruby-version", "ruby-3.3.5"), ("rust-toolchain.toml", '[toolchain]\nchannel = "1.81.0"\n'), ("rust-toolchain", "nightly-2024"), (".tool-versions", "nodejs 20.1 system # c\njava temurin-21.0.4+7\nelixir 1.15-otp\nother 1\n"), ("b/.nvmrc", "node"), (".bun-version", None)]
    got = {(r.file, r.tech, r.version) for r in toml.file_versions(read(spark, *files)).collect()}
    assert got == {(".nvmrc", "runtime.node", "20"), ("a/.node-version", "runtime.node", "22.1.0"), (".python-version", "lang.python", "3.12.4"), (".python-version", "lang.python", "3.11"), (".python-version", "lang.python", "3.10"), ("runtime.txt", "lang.python", "3.9.1"), (".ruby-version", "lang.ruby", "3.3.5"), ("rust-toolchain.toml", "lang.rust", "1.81.0"), (".tool-versions", "runtime.node", "20.1"), (".tool-versions", "lang.java", "21.0.4"), (".tool-versions", "lang.elixir", "1.15")}
    lock = "GEM\n  remote: https://rubygems.org/\n  specs:\n    Rails (7.1.0)\n      rack (>= 2)\n    nio4r (2.5.9-x86)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n    odd (1.0)\n\nPATH\n  remote: .\n  specs:\n    mine (0.1)\n"
    assert {tuple(r)[1:] for r in toml.locked(read(spark, ("x/Gemfile.lock", lock), ("y.lock", lock))).collect()} == {("rails", "7.1.0"), ("nio4r", "2.5.9-x86"), ("mine", "0.1")}


def test_files_are_read_where_they_lie(spark):
    files = read(spark, ("Cargo.toml", '[dependencies]\nserde = "1"\n'))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(toml.entries(files)) and plan(toml.dependencies(files)).count("Exchange") == 1
    # versions need no shuffle, so a task holds no sorted pieces (declared_versions)
    assert "Exchange" not in plan(toml.toml_versions(files)) and "Window" not in plan(toml.toml_versions(files))
