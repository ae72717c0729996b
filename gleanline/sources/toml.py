"""TOML files as rows, and the dependencies and versions that TOML manifests, version files and lock files declare.

A file is cut into lexical pieces (strings, comments, brackets, line ends, the rest) by one pattern.
The bracket depth gives the statements: a line's end at depth 0 ends one, so arrays and inline tables
may span lines and strings may hold anything. A file is read where it lies, in Arrow batches, and is
bounded (sources.code.MAX_FILE); what its entries say of one thing is gathered by Spark.

Edge cases: a null or empty text and a file without entries give no rows; a file whose brackets or
quotes don't close, or that holds a statement that is neither a header nor `key = value`, is invalid
and gives no rows; a key given twice in a table gives both rows. Files are told apart by `file`, which
must name a row of its own. Dates, numbers and booleans stay as written, in `raw`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from gleanline.functions.formats import java_version, node_version, python_version
from gleanline.functions.versions import least_of

# every alternative but the first two ends on its own line; none loops over groups, so long texts need no deep stack
_PIECE = r'"""[\s\S]*?(?<!\\)"""|\'\'\'[\s\S]*?\'\'\'|"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"|\'[^\'\n]*\'|#[^\n]*|[\[\]{}\n]|[^"\'#\[\]{}\n]+|["\']'
_STRING = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"|\'[^\'\n]*\''
_NAME = r'"[^"\n]*"|\'[^\'\n]*\'|[A-Za-z0-9_-]+'
_PATH = rf"(?:{_NAME})(?:[ \t]*\.[ \t]*(?:{_NAME}))*+"
_ENTRY = rf"^({_PATH})[ \t]*=[ \t]*(\S[\s\S]*)$"
#: A header's path by its brackets.
_HEADER = rf"^\[\[?[ \t]*({_PATH})[ \t]*\]\]?$"
#: An entry of an inline table: values are taken whole, so nothing inside a string or an array is read as a key.
_INNER = rf"({_PATH})\s*=\s*({_STRING}|\[(?:{_STRING}|[^\]\"'])*+\]|\{{(?:{_STRING}|\[(?:{_STRING}|[^\]\"'])*+\]|[^{{}}\"'\[\]])*+\}}|[^,\[\]{{}}\"'\s][^,\[\]{{}}\"'\n]*)"

_PIECES, _ENTRIES, _HEADERS, _INNERS, _STRINGS = (re.compile(p, re.ASCII) for p in (_PIECE, _ENTRY, _HEADER, _INNER, _STRING))
_EACH_NAME, _BARE, _QUOTES = re.compile(_NAME), re.compile(r"[A-Za-z0-9_.-]+"), re.compile("^[\"']|[\"']$")
_OPTIONS, _AROUND = re.compile(r"\s-.*$", re.ASCII), re.compile(r"^\(|\)$|\\$")
_REQUIREMENT = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?([^;]*)", re.ASCII)


def _unquoted(literal: str) -> str | None:
    """The text of a string as it is written; null for other values."""
    if literal.startswith(('"""', "'''")):
        return literal[3:-3].removeprefix("\n")
    if literal.startswith('"') and "\\" in literal:
        try:
            return json.loads(f"[{literal}]")[0].encode("utf-8", "replace").decode()
        except ValueError:
            pass
    return literal[1:-1] if literal.startswith(('"', "'")) else None


def _names(path: str) -> list[str]:
    if _BARE.fullmatch(path):
        return path.split(".")
    return [_QUOTES.sub("", n) for n in _EACH_NAME.findall(path)]


def _inner(path: list[str], raw: str) -> list[tuple[list[str], str]]:
    """An entry (path, raw), and behind it those of its inline table."""
    pairs = _INNERS.findall(raw) if raw.startswith("{") else ()
    return [(path, raw), *((path + _names(k), v.strip(" ")) for k, v in pairs)]


def statements(text: str) -> list[tuple[int, str]]:
    """A text's statements with their numbers, without comments, each on one line (strings keep theirs); none if a bracket or quote doesn't close."""
    depth, number, parts, out = 0, 0, [], []
    for piece in _PIECES.findall(text.replace("\r\n", "\n").replace("\r", "\n")):
        if piece == "\n":
            if depth == 0:
                out.append((number, "".join(parts)))
                number, parts = number + 1, []
            else:
                parts.append(" ")
        elif piece[0] != "#":
            if piece in "[{":
                depth += 1
            elif piece in "]}":
                depth -= 1
            if depth < 0 or piece in ('"', "'"):
                return []
            parts.append(piece)
    out.append((number, "".join(parts)))
    tidy = ((n, t.replace("\t", " ").strip(" ")) for n, t in out)
    return [(n, t) for n, t in tidy if t] if depth == 0 else []


def read(text: str | None) -> list[tuple]:
    """(statement, element, path, raw, value, items) of a text's entries, see entries(); none if a statement can't be read."""
    top, element, met, out = [], None, {}, []
    for number, line in statements(text or ""):
        header = line.startswith("[")
        found = (_HEADERS if header else _ENTRIES).match(line)
        if not found:
            return []
        if header:
            # the n-th header of its name, counted within the file
            top, element = _names(found[1]), None
            if line.startswith("[["):
                element = met[tuple(top)] = met.get(tuple(top), 0) + 1
            continue
        first, *within = _inner(top + _names(found[1]), found[2].strip(" "))
        for path, raw in (first, *(x for w in within for x in _inner(*w))):
            out.append((number, element, path, raw, _unquoted(raw), [_unquoted(x) for x in _STRINGS.findall(raw)] if raw.startswith("[") else None))
    return out


def _each_file(files: DataFrame, of: Callable[[str, str | None], Iterable[tuple]], schema: pa.Schema) -> DataFrame:
    """The rows that of(file, content) gives of each file, in Arrow batches."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [row for file, text in zip(batch["file"].to_pylist(), batch["content"].to_pylist(), strict=True) for row in of(file, text)]
            columns = zip(*rows, strict=True) if rows else ([],) * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("file", "content").mapInArrow(batches, from_arrow_schema(schema))


_LIST = pa.list_(pa.string())
_ROWS = pa.schema([("file", pa.string()), ("statement", pa.int64()), ("element", pa.int64()), ("path", _LIST), ("raw", pa.string()), ("value", pa.string()), ("items", _LIST)])


def entries(files: DataFrame) -> DataFrame:
    """(file, statement, element, path, raw, value, items) of each key and of each key in an inline table.

    path: the table's and the key's names; element: which of the tables of a `[[header]]`, from 1, else
    null; value: a string's text; items: the strings of an array; raw: the value as written.
    """
    return _each_file(files, lambda file, text: ((file, *e) for e in read(text)), _ROWS)


def _requirement(line: str) -> tuple[str, str | None]:
    """(name, spec) of a Python requirement, spec null for one without versions or at an address."""
    found = _REQUIREMENT.match(line)
    if not found:
        return "", None
    rest = _OPTIONS.sub("", found[2]).strip(" ")
    bare = _AROUND.sub("", rest).strip(" ")
    return found[1], bare if bare and not rest.startswith("@") else None


#: (kind of file, tables whose keys are dependencies, ecosystem, for development); '*' is any one name.
_TABLES = [
    ("pyproject", "tool.poetry.dependencies", "pypi", False), ("pyproject", "tool.poetry.dev-dependencies", "pypi", True), ("pyproject", "tool.poetry.group.*.dependencies", "pypi", True),
    ("pipfile", "packages", "pypi", False), ("pipfile", "dev-packages", "pypi", True),
    ("cargo", "dependencies", "cargo", False), ("cargo", "build-dependencies", "cargo", False), ("cargo", "dev-dependencies", "cargo", True), ("cargo", "workspace.dependencies", "cargo", False),
    ("cargo", "target.*.dependencies", "cargo", False), ("cargo", "target.*.dev-dependencies", "cargo", True),
    ("catalog", "libraries", "maven", False), ("catalog", "plugins", "maven", False),
]
#: Likewise for arrays of requirements.
_LISTS = [("pyproject", "project.dependencies", False), ("pyproject", "project.optional-dependencies.*", True), ("pyproject", "dependency-groups.*", True), ("pyproject", "tool.uv.dev-dependencies", True), ("pyproject", "tool.pdm.dev-dependencies", True)]
#: Both by kind; a catalog's shared versions are gathered like dependencies of no ecosystem.
_PLACES = {kind: [(p.split("."), eco, dev) for k, p, eco, dev in [*_TABLES, ("catalog", "versions", "", False)] if k == kind] for kind in ("pyproject", "pipfile", "cargo", "catalog")}
_LISTED = {"pyproject": [(p.split("."), dev) for _, p, dev in _LISTS]}
#: (kind, path, technology, what it is called) of the versions of a language.
_VERSIONS = [
    ("pyproject", "project.requires-python", "lang.python", "requires-python"), ("pyproject", "tool.poetry.dependencies.python", "lang.python", "tool.poetry python"), ("pyproject", "tool.poetry.dependencies.python.version", "lang.python", "tool.poetry python"),
    ("pipfile", "requires.python_version", "lang.python", "Pipfile python_version"), ("pipfile", "requires.python_full_version", "lang.python", "Pipfile python_full_version"),
    ("cargo", "package.rust-version", "lang.rust", "rust-version"), ("cargo", "workspace.package.rust-version", "lang.rust", "workspace rust-version"),
]


def _kind(file: str) -> str | None:
    base = file.rpartition("/")[2]
    return {"pyproject.toml": "pyproject", "Pipfile": "pipfile", "Cargo.toml": "cargo"}.get(base) or ("catalog" if base.endswith(".versions.toml") else None)


def _lies(path: list[str], names: list[str]) -> bool:
    """Whether a path begins with the names of a pattern."""
    for name, own in zip(names, path, strict=False):
        if name != own and name != "*":
            return False
    return len(path) >= len(names)


_CLAIMS = pa.schema([("file", pa.string()), ("kind", pa.string()), ("_s", pa.int64()), ("n", pa.int64()), ("at", _LIST), ("eco", pa.string()), ("dev", pa.bool_()), ("inner", pa.string()), ("value", pa.string()), ("items", _LIST)])


def _claims(file: str, text: str | None) -> Iterator[tuple]:
    """What a manifest says of one thing: a requirement's line is one by itself, a table's keys are gathered by the place of their thing."""
    kind = _kind(file)
    tables, lists = _PLACES.get(kind, ()), _LISTED.get(kind, ())
    for statement, _, path, _, value, items in read(text) if kind else ():
        place = next((t for t in tables if len(path) > len(t[0]) and _lies(path, t[0])), None)
        if place:
            names, eco, dev = place
            n = len(names)
            yield file, kind, 0, 0, path[: n + 1], eco, dev, ".".join(path[n + 1 :]), value, items
            continue
        dev = next((dev for names, dev in lists if len(path) == len(names) and _lies(path, names)), None)
        if dev is not None:
            for k, (name, spec) in enumerate(map(_requirement, items or ())):
                yield file, kind, statement, k + 1, [*path, name], "pypi", dev, "", spec, None


def dependencies(files: DataFrame) -> DataFrame:
    """(file, eco, name, spec, dev) of pyproject.toml, Pipfile, Cargo.toml and *.versions.toml. files: file, content.

    A dependency's version is its string, its table's `version`, or what a catalog's `ref` points at;
    `package` gives a crate's real name and its features follow as name[feature].
    """
    said = _each_file(files, _claims, _CLAIMS).repartition("file")
    of = lambda *names: F.coalesce(*(F.max(F.when(F.col("inner") == n, F.col("value"))) for n in names))
    wide = said.groupBy("file", "kind", "_s", "n", "at", "eco", "dev").agg(of("").alias("own"), of("version", "version.require", "version.strictly", "version.prefer").alias("version"), of("require", "strictly", "prefer").alias("rich"), of("version.ref").alias("ref"), of("package").alias("package"), of("module").alias("module"), of("group").alias("group"), of("name").alias("artifact"), of("id").alias("id"), F.max(F.when(F.col("inner") == "features", F.col("items"))).alias("features"))
    # a shared version and those that point at it lie side by side
    shared = F.col("eco") == ""
    near = Window.partitionBy("file", F.when(shared, F.element_at("at", -1)).otherwise(F.col("ref")))
    full = wide.withColumn("pointed", F.when(F.col("ref").isNotNull(), F.max(F.when(shared, F.coalesce("own", "rich"))).over(near)))
    full = full.filter(~shared & (F.element_at("at", -1) != "") & ~((F.col("kind") == "pyproject") & (F.col("n") == 0) & (F.lower(F.element_at("at", -1)) == "python")))

    key, plugin = F.element_at("at", -1), F.element_at("at", 1) == "plugins"
    parts = F.split("own", ":", -1)
    library = F.when(F.col("own").isNotNull(), F.when((F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""), F.concat_ws(":", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))).otherwise(F.coalesce("module", F.concat(F.col("group"), F.lit(":"), F.col("artifact"))))
    id_ = F.coalesce(F.when(F.get(parts, F.lit(0)) != "", F.get(parts, F.lit(0))), F.when(F.col("own").isNull(), F.col("id")))
    name = F.when(F.col("kind") != "catalog", F.coalesce("package", key)).when(plugin, F.concat(F.lit("plugin:"), id_)).otherwise(library)
    spec = F.when(F.col("kind") != "catalog", F.coalesce("own", "version")).otherwise(F.coalesce(F.when(plugin, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))), "version", "pointed"))
    # a crate's features are rows of their own before its name is put together, which would else be written out at each use
    own_and_features = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.when(F.col("kind") == "cargo", F.col("features")), F.array().cast("array<string>")))
    each = full.withColumn("_feature", F.explode(own_and_features))
    called = each.select("file", "eco", name.alias("name"), F.trim(F.when(F.col("_feature").isNull(), spec)).alias("spec"), "dev", "_feature").filter("name IS NOT NULL")
    plain = F.concat("name", F.coalesce(F.concat(F.lit("["), "_feature", F.lit("]")), F.lit("")))
    return called.select("file", "eco", F.when(F.col("eco") == "pypi", F.lower(F.regexp_replace("name", "[-_.]+", "-"))).otherwise(plain).alias("name"), F.when(F.col("spec") != "", F.col("spec")).alias("spec"), "dev")


def _leading(text: Column) -> Column:
    found = F.regexp_extract(F.trim(text), r"^v?([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when((found != "") & found.rlike("[1-9]"), found)


def toml_versions(files: DataFrame) -> DataFrame:
    """(file, tech, version, what): the language versions that pyproject.toml, Pipfile and Cargo.toml declare."""
    base = F.regexp_extract("file", "([^/]*)$", 1)
    named = {"pyproject": "pyproject.toml", "pipfile": "Pipfile", "cargo": "Cargo.toml"}
    kind = F.coalesce(*(F.when(base == name, F.lit(k)) for k, name in named.items()))
    rows = entries(files.filter(base.isin(*named.values()))).filter("value IS NOT NULL").withColumn("kind", kind).withColumn("_at", F.array_join("path", "."))
    which = F.coalesce(*(F.when((F.col("kind") == kind) & (F.col("_at") == at), F.struct(F.lit(tech).alias("tech"), F.lit(what).alias("what"))) for kind, at, tech, what in _VERSIONS))
    version = F.when(F.col("kind") == "pyproject", least_of(F.col("value"))).otherwise(_leading(F.col("value")))
    return rows.select("file", which.alias("w"), version.alias("version")).filter("w IS NOT NULL AND version IS NOT NULL").select("file", "w.tech", "version", "w.what")


# The tools of .tool-versions and what they stand for.
TOOLS = {"nodejs": "runtime.node", "node": "runtime.node", "deno": "runtime.deno", "bun": "runtime.bun", "python": "lang.python", "ruby": "lang.ruby", "java": "lang.java", "php": "lang.php", "rust": "lang.rust", "elixir": "lang.elixir", "kotlin": "lang.kotlin", "dart": "lang.dart", "flutter": "framework.flutter"}
#: (names of the file, technology, how the first value is read).
_VERSION_FILES = [
    (".nvmrc .node-version", "runtime.node", node_version),
    ("runtime.txt", "lang.python", lambda v: F.when(F.startswith(v, F.lit("python-")), _leading(F.substring(v, 8, 2**31 - 1)))),
    (".ruby-version", "lang.ruby", lambda v: _leading(F.regexp_replace(v, "^ruby-", ""))),
    (".bun-version", "runtime.bun", lambda v: _leading(F.regexp_replace(v, "^bun-", ""))),
    (".swift-version", "lang.swift", lambda v: _leading(F.regexp_replace(v, "^swift-", ""))),
]
#: The most values of one .python-version, of one tool, and the most lines of one .tool-versions: rules of the formats' readers.
MAX_VALUES, MAX_TOOL_VALUES, MAX_TOOL_LINES = 20, 5, 500


def file_versions(files: DataFrame) -> DataFrame:
    """(file, tech, version, what) of version files: .nvmrc and its like, .python-version (every value), rust-toolchain, .tool-versions."""
    base = F.regexp_extract("file", "([^/]*)$", 1)
    lines = F.split("content", r"\r?\n", -1)
    bare = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: (x != "") & ~F.contains(x, F.lit("=")))
    one = lambda tech, version, what: F.struct(F.lit(tech).alias("tech"), version.alias("version"), what.alias("what"))
    channel = F.regexp_extract("content", r"(?m)^[ \t]*channel[ \t]*=[ \t]*['\"]([^'\"\n]{1,60})['\"]", 1)
    rust = F.when(channel != "", channel).otherwise(F.when(base == "rust-toolchain", F.get(bare, F.lit(0))))
    found = [F.when(base.isin(*names.split()), F.array(one(tech, read(F.get(bare, F.lit(0))), base))) for names, tech, read in _VERSION_FILES]
    found.append(F.when(base.isin(".python-version", ".python-versions"), F.transform(F.slice(bare, 1, MAX_VALUES), lambda v: one("lang.python", F.coalesce(python_version(v), least_of(v)), base))))
    found.append(F.when(base.isin("rust-toolchain", "rust-toolchain.toml"), F.array(one("lang.rust", F.when(F.trim(rust).rlike(r"^[0-9]+\.[0-9]+(?:\.[0-9]+)?$"), _leading(rust)), base))))
    words = F.transform(F.slice(lines, 1, MAX_TOOL_LINES), lambda x: F.filter(F.split(F.regexp_replace(x, "#.*$", ""), r"\s+"), lambda w: w != ""))
    vendorless = lambda v: F.regexp_replace(v, "^(?i:[a-z][a-z0-9]*-)+", "")
    tech_of = lambda tool: F.coalesce(*(F.when(tool == k, F.lit(v)) for k, v in TOOLS.items()))

    def of_tool(line: Column) -> Column:
        tool = F.lower(F.get(line, F.lit(0)))
        tech = tech_of(tool)
        read = lambda v: F.when(tech == "runtime.node", node_version(v)).when(tech == "lang.python", python_version(v)).when(tech == "lang.java", java_version(vendorless(v))).otherwise(_leading(vendorless(v)))
        values = F.filter(F.slice(line, 2, MAX_TOOL_VALUES), lambda v: ~v.rlike("(?i)^(?:ref|path):|^(?:system|latest)$"))
        return F.transform(values, lambda v: F.struct(tech.alias("tech"), read(v).alias("version"), F.concat(F.lit(".tool-versions "), tool).alias("what")))

    found.append(F.when(base == ".tool-versions", F.flatten(F.transform(F.filter(words, lambda w: F.size(w) > 0), of_tool))))
    each = files.select("file", F.explode(F.coalesce(*found)).alias("v"))
    return each.select("file", "v.*").filter("tech IS NOT NULL AND version IS NOT NULL")


def locked(files: DataFrame) -> DataFrame:
    """(file, name, version): the gems of Gemfile.lock, from the specs of its GEM, GIT and PATH sections; a gem's own dependencies stand deeper and are left out."""
    sections = F.filter(F.split(F.regexp_replace("content", "\r\n?", "\n"), r"\n(?=\S)", -1), lambda s: s.rlike(r"^(?:GEM|GIT|PATH)[ \t]*\n"))
    specs = F.filter(F.flatten(F.transform(sections, lambda s: F.split(s, r"\n(?=  \S)", -1))), lambda p: F.startswith(p, F.lit("  specs:")))
    line = r"(?m)^    ([\w.-]+) \(([^)\s]{1,60})\)[ \t]*$"
    pairs = F.flatten(F.transform(specs, lambda p: F.zip_with(F.regexp_extract_all(p, F.lit(line), F.lit(1)), F.regexp_extract_all(p, F.lit(line), F.lit(2)), lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("version")))))
    return files.filter(F.regexp_extract("file", "([^/]*)$", 1) == "Gemfile.lock").select("file", F.explode(pairs).alias("g")).select("file", "g.*")
