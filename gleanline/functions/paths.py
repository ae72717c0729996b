"""Paths as column expressions: languages, tests, globs, completion, safety."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The language of a file by its name, else by its extension.
BY_NAME = {"Rakefile": "ruby", "Gemfile": "ruby", "Dockerfile": "dockerfile", "Makefile": "makefile", "Jenkinsfile": "groovy"}
BY_EXTENSION = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "vue": "vue", "svelte": "svelte", "python": "py", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts", "scala": "scala sc", "csharp": "cs",
    "ruby": "rb rake ru gemspec", "php": "php", "swift": "swift", "objective-c": "m", "c": "c h", "cpp": "cc cpp cxx c++ hpp hh hxx ipp inl tpp cppm ixx cu cuh", "sql": "sql", "shell": "sh bash zsh ksh bats ps1 psm1", "terraform": "tf",
    "yaml": "yaml yml", "json": "json", "toml": "toml", "markdown": "md", "html": "html", "css": "css", "scss": "scss", "graphql": "graphql gql", "protobuf": "proto", "dart": "dart", "elixir": "ex exs",
}
TEST_PATH = r"(?i)(?:^|/)(?:tests?|__tests__|specs?|fixtures?|testdata|test-data|examples?|samples?|mocks?|__mocks__|e2e)/|[._-](?:test|spec|tests|fixture|mock)\.[^/]+$|_test\.(?:go|py|rb|exs?)$|(?:^|/)test_[^/]+\.py$|(?:^|/)conftest\.py$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def directory(path: Column) -> Column:
    """The directory of a file, '.' at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def ancestors(of: Column) -> Column:
    """A directory's ancestors and itself, the root left out."""
    parts = F.split(of, "/", -1)
    return F.when(of != ".", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def inside(base: Column, relative: Column) -> Column:
    """relative, seen from a directory, as a path of the repository; null where it leads out of it."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/", -1), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    walk = F.aggregate(parts, none, lambda out, p: F.when(out.isNull() | ((p == "..") & (F.size(out) == 0)), None).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.when(relative.isNotNull(), F.when(F.size(walk) > 0, F.array_join(walk, "/")).when(walk.isNotNull(), "."))


def language(path: Column) -> Column:
    """The language of a file: by its whole name, by 'Dockerfile...', by its extension; else text."""
    base = base_name(path)
    table = {e: lang for lang, extensions in BY_EXTENSION.items() for e in extensions.split()}
    names = F.create_map(*(F.lit(x) for pair in BY_NAME.items() for x in pair))
    kinds = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    extension = F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))
    return F.coalesce(F.try_element_at(names, base), F.when(F.startswith(base, F.lit("Dockerfile")), "dockerfile"), F.try_element_at(kinds, extension), F.lit("text"))


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for whole paths: * within a name, ** over directories, ?, [...] and {a,b}; one without a slash means names."""
    text = glob if "/" in glob else f"**/{glob}"
    out, k, depth = "", 0, 0
    while k < len(text):
        if text.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
            continue
        if text.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        c = text[k]
        if c == "[" and "]" in text[k + 2 :]:
            end = text.index("]", k + 2)
            inner = text[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
            continue
        depth += (c == "{") - (c == "}")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        k += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path fits any of the globs: one regular expression for all of them."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def complete(reported: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """reported (keys, path) with `file`: the one file of its keys that is the path or ends with it; where none or several do, the path as it is.

    Files are dealt by every tail of their path, so that a tail is found by equality.
    """
    parts = F.split("file", "/", -1)
    tails = files.select(*keys, "file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("path"))
    of_tail = tails.groupBy(*keys, "path").agg(F.count_distinct("file").alias("_n"), F.max("file").alias("_file"), F.max(F.col("file") == F.col("path")).alias("_same"))
    rows = reported.join(of_tail, [*keys, "path"], "left")
    return rows.withColumn("file", F.when(F.col("_same"), F.col("path")).when(F.col("_n") == 1, F.col("_file")).otherwise(F.col("path"))).drop("_n", "_file", "_same")


def safe(path: Column) -> Column:
    """A path within a repository with forward slashes, or null: no drive, no root, no empty, '.' or '..' part."""
    from gleanline.functions.redaction import strip_unsafe

    p = F.regexp_replace(strip_unsafe(path), r"\\", "/")
    bad = (p == "") | (F.length(p) > 4096) | F.startswith(p, F.lit("/")) | p.rlike("^[a-zA-Z]:") | F.exists(F.split(p, "/", -1), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, p)
