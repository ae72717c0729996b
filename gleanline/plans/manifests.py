"""Queries over TOML manifests, version files and lock files: an order is a file, its items are what the file declares."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.plans.facts import table, tasks
from gleanline.plans.registry import query
from gleanline.sources import toml

#: File name, then what stands before the items of each of four sections, and an item's text in a section; {n} is its name, {s} its version.
KINDS = [
    ("pyproject.toml", ["[project] # [not]\nname = 'x # y'\ndependencies = [ # all of ]\n", "]\n[tool.poetry.dependencies]\npython = '^3.9'\n", "[ tool . poetry.group.dev.\"dependencies\" ]\n", ""],
     ["  \"{n}[a,b]>={s} ; python_version < '4'\", # {n} [\"\n", '{n} = "^{s}" # "\n', '{n} = { version = "~{s}", extras = ["x]", "version = 9"], why = "{ version = \\"8\\" }" }\n', ""]),
    ("Pipfile", ["[[source]]\nurl = 'u'\n[packages]\n", "", "[dev-packages]\n", ""],
     ['{n} = ">={s}"\n', '[packages.{n}]\nversion = "^{s}"\n', "{n} = {markers = \"a > 'b', version = '1'\", version = '~{s}'}\n", ""]),
    ("Cargo.toml", ["description = \"\"\"\n[dependencies]\nnone = '1'\n\"\"\"\n[dependencies]\n", "[dev-dependencies]\n", "[target.'cfg(any(unix, x))'.dependencies]\n", "[features]\na = []\n"],
     ['{n} = ">={s}"\n', '{n}.version = "^{s}"\n{n}.features = [\n  "f", # ]\n]\n', 'as_{n} = { package = "{n}", version = "~{s}" }\n', ""]),
    ("libs.versions.toml", ["[libraries]\n", "", "[plugins]\n", "[versions]\n"],
     ['{n} = { module = "g:{n}", version.ref = "v{n}" }\n', '{n} = "g:{n}:^{s}"\n', '{n} = { id = "{n}", version = { strictly = "~{s}" } }\n', 'v{n} = ">={s}"\n']),
]
_N = "concat('Pkg_', CAST(l_partkey AS {t}), '_', CAST(l_suppkey AS {t}), '_', CAST(l_linenumber AS {t}))"
_S = "concat(CAST(l_suppkey % 30 AS {t}), '.', CAST(l_linenumber AS {t}))"
_LINES = "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem"


def _items(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    # an order's rows meet here once: what is grouped by order afterwards is not shuffled again
    rows = rows.repartition(tasks(rows), "l_orderkey").distinct()
    return rows.withColumn("n", F.expr(_N.format(t="string"))).withColumn("s", F.expr(_S.format(t="string")))


def _joined(texts):
    return F.array_join(F.array_sort(F.collect_list(texts)), "")


@query("toml_dependencies", f"""WITH i AS (SELECT l_orderkey, l_orderkey % 4 AS kind, l_linenumber % 3 AS form, {_N.format(t='VARCHAR')} AS n, {_S.format(t='VARCHAR')} AS s FROM ({_LINES})),
d AS (SELECT l_orderkey, kind, form, CASE WHEN kind < 2 THEN replace(lower(n), '_', '-') WHEN kind = 2 THEN n WHEN form = 2 THEN concat('plugin:', n) ELSE concat('g:', n) END AS name, concat(CASE form WHEN 0 THEN '>=' WHEN 1 THEN '^' ELSE '~' END, s) AS spec, CASE kind WHEN 0 THEN form = 2 WHEN 1 THEN form = 2 WHEN 2 THEN form = 1 ELSE false END AS dev FROM i),
a AS (SELECT * FROM d UNION ALL SELECT l_orderkey, kind, form, concat(name, '[f]'), NULL, true FROM d WHERE kind = 2 AND form = 1)
SELECT l_orderkey, CASE kind WHEN 2 THEN 'cargo' WHEN 3 THEN 'maven' ELSE 'pypi' END AS eco, name, spec, dev FROM a""")
def toml_dependencies(spark, sf_dir):
    """Dependencies of four kinds of TOML manifests: nested and inline tables, arrays over lines, brackets in strings and comments, shared versions."""
    kind = F.expr("l_orderkey % 4")
    choose = lambda of: F.coalesce(*(F.when(kind == k, of(x)) for k, x in enumerate(KINDS)))
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("n")), F.lit("{s}"), F.col("s"))
    form = F.expr("l_linenumber % 3")
    rows = _items(spark, sf_dir).select("l_orderkey", *(F.when(form == (j if j < 3 else 0), choose(lambda x, j=j: filled(x[2][j]))).alias(f"t{j}") for j in range(4)))
    sections = rows.groupBy("l_orderkey").agg(*(_joined(F.col(f"t{j}")).alias(f"t{j}") for j in range(4)))
    content = F.concat(*(x for j in range(4) for x in (choose(lambda x, j=j: F.lit(x[1][j])), F.col(f"t{j}"))))
    files = sections.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), choose(lambda x: F.lit(x[0]))).alias("file"), content.alias("content"))
    return toml.dependencies(files).select(F.regexp_extract("file", "^([0-9]+)/", 1).cast("long").alias("l_orderkey"), "eco", "name", "spec", "dev")


@query("locked_gems", f"SELECT l_orderkey, lower({_N.format(t='VARCHAR')}) AS name, {_S.format(t='VARCHAR')} AS version FROM ({_LINES}) WHERE l_linenumber % 3 < 2")
def locked_gems(spark, sf_dir):
    """The gems that lock files fix, in their own and in path sections; what they need themselves and the list of wants are left out."""
    form = F.expr("l_linenumber % 3")
    spec = F.concat(F.lit("    "), "n", F.lit(" ("), "s", F.lit(")\n"))
    own = F.concat(F.lit("      needs"), "n", F.lit(" (1.0)\n"))
    sections = _items(spark, sf_dir).groupBy("l_orderkey").agg(_joined(F.when(form == 0, F.concat(spec, own))).alias("g"), _joined(F.when(form == 1, spec)).alias("p"), _joined(F.when(form == 2, spec)).alias("w"))
    content = F.concat(F.lit("GEM\n  remote: https://x/\n  specs:\n"), "g", F.lit("\nPATH\n  remote: .\n  specs:\n"), "p", F.lit("\nDEPENDENCIES\n"), "w")
    files = sections.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/Gemfile.lock")).alias("file"), content.alias("content"))
    return toml.locked(files).select(F.regexp_extract("file", "^([0-9]+)/", 1).cast("long").alias("l_orderkey"), "name", "version")


#: File name, content and what it declares (technology, version, called); {a} and {b} are numbers of the order.
VERSION_FILES = [
    (".nvmrc", "# {b}\n\n v{a}.{b}  # x\n99\n", [("runtime.node", "{a}.{b}", ".nvmrc")]),
    (".python-version", "3.{a}.{b}\ncpython@3.{b}\npypy3.{a}-7.{b}\n", [("lang.python", "3.{a}.{b}", ".python-version"), ("lang.python", "3.{b}", ".python-version"), ("lang.python", "3.{a}", ".python-version")]),
    (".tool-versions", "nodejs {a}.1 system\n# ruby 9\njava temurin-{b}.0.4+7 1.8\nother {a}\nRuby {a}.{b} # old\n", [("runtime.node", "{a}.1", ".tool-versions nodejs"), ("lang.java", "{b}.0.4", ".tool-versions java"), ("lang.java", "8", ".tool-versions java"), ("lang.ruby", "{a}.{b}", ".tool-versions ruby")]),
    ("rust-toolchain.toml", "[toolchain]\nchannel = \"1.{a}.{b}\"\n", [("lang.rust", "1.{a}.{b}", "rust-toolchain.toml")]),
    ("pyproject.toml", "[project]\nrequires-python = \">=3.{a},<{b}\"\n[tool.poetry.dependencies]\npython = {{ version = \"^3.{b}\", x = 1 }}\n", [("lang.python", "3.{a}", "requires-python"), ("lang.python", "3.{b}", "tool.poetry python")]),
    ("Cargo.toml", "[package]\nname = \"p\" # rust-version = \"9\"\nrust-version = '1.{a}'\n[workspace]\npackage.rust-version = \"1.{b}\"\n", [("lang.rust", "1.{a}", "rust-version"), ("lang.rust", "1.{b}", "workspace rust-version")]),
    ("rust-toolchain", "nightly-{a}\n", []),
]
_A, _B = "{a}", "{b}"


def _pieces(text, quote, number):
    """A concat() in SQL of a text with its two numbers."""
    out = quote(text.replace("{{", "{").replace("}}", "}"))
    return f"replace(replace({out}, '{_A}', CAST(1 + o_custkey % 40 AS {number})), '{_B}', CAST(1 + o_orderkey % 30 AS {number}))"


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


_DECLARED = " UNION ALL ".join(f"SELECT o_orderkey, {_quoted(tech)} AS tech, {_pieces(version, _quoted, 'VARCHAR')} AS version, {_quoted(what)} AS what FROM o WHERE o_orderkey % {len(VERSION_FILES)} = {k}" for k, (_, _, said) in enumerate(VERSION_FILES) for tech, version, what in said)


@query("declared_versions", f"WITH o AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders) {_DECLARED}")
def declared_versions(spark, sf_dir):
    """The versions of languages and runtimes that version files and TOML manifests declare."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # dealt first: few rows are equal, and a split's own distinct rows would all be held before the shuffle
    orders = orders.repartition(tasks(orders), "o_orderkey").distinct()
    choose = lambda of: F.coalesce(*(F.when(F.expr(f"o_orderkey % {len(VERSION_FILES)}") == k, of(x)) for k, x in enumerate(VERSION_FILES)))
    a, b = F.expr("string(1 + o_custkey % 40)"), F.expr("string(1 + o_orderkey % 30)")
    content = choose(lambda x: F.replace(F.replace(F.lit(x[1].replace("{{", "{").replace("}}", "}")), F.lit(_A), a), F.lit(_B), b))
    files = orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), choose(lambda x: F.lit(x[0]))).alias("file"), content.alias("content"))
    found = toml.file_versions(files).unionByName(toml.toml_versions(files))
    return found.select(F.regexp_extract("file", "^([0-9]+)/", 1).cast("long").alias("o_orderkey"), "tech", "version", "what")
