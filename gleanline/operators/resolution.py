"""Import specifiers as files of the repository: aliases by longest prefix, then a ranked ladder of candidate paths.

Every specifier becomes candidate paths with their rank, whatever rule they come from; the candidates
meet the files by equality and the best one that exists is taken. Rules of configurations (path
aliases, workspaces, modules, namespaces, source roots) meet specifiers by equality too: with
exploded prefixes, or as one configuration's list of rules. No step compares a specifier with all files.
What a specifier leads to depends on the importer's directory and language alone, so what the files of a
directory import alike is resolved once and then handed to each of them.

Covered: script files (relative, `paths` and `baseUrl` with `extends`, workspace packages with
`exports`), Python (relative, by source root), Go (modules, or a domain's unique trailing path),
PHP (PSR-4), Dart (packages, relative) and C (beside the file or at the root).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.functions.paths import ancestors, directory, inside, language
from gleanline.operators.graph import cut

# Endings that a script specifier may leave out, in their order, and source endings behind built ones.
ENDINGS = ".ts .tsx .d.ts .js .jsx .mjs .cjs .mts .cts .vue .svelte .json".split()
SOURCES = {".js": [".ts", ".tsx", ".d.ts"], ".jsx": [".tsx"], ".mjs": [".mts", ".d.mts"], ".cjs": [".cts", ".d.cts"]}
BUILT = r"^(?:\./)?(?:dist|build|lib|out|esm|cjs|es|types)/"
PYTHON_ENDINGS, PYTHON_BESIDE = [".py", ".pyi", "/__init__.py", "/__init__.pyi"], [".py", "/__init__.py", ".pyi", "/__init__.pyi"]
PYTHON_ROOTS = "src lib python app source".split()
#: Configurations that one may extend in a row.
EXTENDS = 5
SCRIPTS = ("javascript", "typescript", "vue", "svelte")
_JSON = {"allowComments": "true"}


def _script_paths(path: Column, only_index: Column) -> Column:
    """Where a script module may lie, best first: the file itself, the source of a built file, with an ending, as a directory's index."""
    clean = F.regexp_replace(path, r"[?#].*$", "")
    swaps = F.coalesce(*(F.when(clean.rlike(rf"[^/]\{e}$"), F.array(*(F.concat(F.regexp_replace(clean, rf"\{e}$", ""), F.lit(x)) for x in to))) for e, to in SOURCES.items()), F.array().cast("array<string>"))
    endings = F.array(*map(F.lit, ENDINGS))
    own = F.concat(F.array(clean), swaps, F.transform(endings, lambda e: F.concat(clean, e)))
    stem = F.when(clean == ".", F.lit("index")).otherwise(F.concat(clean, F.lit("/index")))
    index = F.transform(endings, lambda e: F.concat(stem, e))
    return F.when(only_index | (clean == "."), index).otherwise(F.concat(own, index))


def _with(path: Column, endings: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(path, e))


def _json(text: Column, schema: str) -> Column:
    return F.from_json(F.regexp_replace(text, r",(\s*[}\]])", "$1"), schema, _JSON)


def script_settings(configs: DataFrame) -> DataFrame:
    """(repo, dir, at, base, rules): the path aliases in force in each directory with a tsconfig.json or jsconfig.json, what it extends included.

    rules: (pattern, targets), in order; base: where targets start from; own: the configuration's directory; root: baseUrl, if any.
    """
    rows = configs.filter(F.col("file").rlike(r"(?:^|/)[^/]*config[^/]*\.json$"))
    parsed = _json(F.col("content"), "extends string, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")
    listed = F.element_at(F.filter(F.from_json("_e", "array<string>"), lambda e: F.startswith(e, F.lit("."))), -1)
    rows = rows.select("repo", "file", directory(F.col("file")).alias("dir"), parsed.alias("p")).select("repo", "file", "dir", F.col("p.extends").alias("_e"), F.col("p.compilerOptions.baseUrl").alias("_b"), F.map_entries("p.compilerOptions.paths").alias("rules"))
    up = F.when(F.startswith("_e", F.lit("[")), listed).when(F.startswith("_e", F.lit(".")), F.col("_e"))
    rows = rows.withColumn("up", inside(F.col("dir"), F.when(F.endswith(up, F.lit(".json")), up).otherwise(F.concat(up, F.lit(".json"))))).withColumn("root", inside(F.col("dir"), F.regexp_replace("_b", r"^\$\{configDir\}/*", "./")))
    rows = rows.select("repo", "file", "dir", "up", "root", "rules", F.when(F.col("rules").isNotNull(), F.col("dir")).alias("home"))
    parents = rows.select("repo", F.col("file").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("rules").alias("_rules"), F.col("home").alias("_home"))
    found = rows.filter(F.col("file").rlike(r"(?:^|/)[tj]sconfig\.json$"))
    for _ in range(EXTENDS):
        found = found.join(parents, ["repo", "up"], "left").select("repo", "file", "dir", F.col("_up").alias("up"), F.coalesce("root", "_root").alias("root"), F.coalesce("rules", "_rules").alias("rules"), F.coalesce("home", "_home").alias("home"))
    one = found.groupBy("repo", "dir").agg(F.max_by(F.struct("root", "rules", "home"), "file").alias("s"))  # tsconfig before jsconfig
    return one.select("repo", "dir", F.col("s.root").alias("root"), F.col("s.rules").alias("rules"), F.coalesce("s.root", "s.home", "dir").alias("base"))


def _cut_at_star(s: Column) -> tuple[Column, Column]:
    at = F.instr(s, F.lit("*"))
    return F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s))


def _alias(spec: Column) -> Column:
    """The targets of the rule that fits a specifier best (an exact one, else the longest prefix, of equals the first), the star filled in."""

    def fit(rule: Column, i: Column) -> Column:
        starred = F.contains(rule["key"], F.lit("*"))
        before, behind = _cut_at_star(rule["key"])
        ok = F.when(starred, F.startswith(spec, before) & F.endswith(spec, behind) & (F.length(spec) >= F.length(before) + F.length(behind))).otherwise(spec == rule["key"])
        star = F.when(starred, F.substring(spec, F.length(before) + 1, F.length(spec) - F.length(before) - F.length(behind))).otherwise("")
        return F.when(ok, F.struct((~starred).alias("exact"), F.when(starred, F.length(before)).otherwise(0).alias("n"), (-i).alias("i"), star.alias("star"), rule["value"].alias("targets")))

    best = F.array_max(F.transform("rules", fit))

    def filled(target: Column) -> Column:
        before, behind = _cut_at_star(target)
        return F.when(F.contains(target, F.lit("*")), F.concat(before, best["star"], behind)).otherwise(target)

    return F.transform(best["targets"], filled)


def workspaces(configs: DataFrame) -> DataFrame:
    """(repo, name, dir, entries, exports) of the named packages of a repository."""
    rows = configs.filter(F.col("file").rlike(r"(?:^|/)package\.json$")).select("repo", directory(F.col("file")).alias("dir"), _json(F.col("content"), "name string, source string, types string, module string, main string, exports string").alias("p")).filter("p.name IS NOT NULL")
    raw = F.col("p.exports")
    paths = lambda v: F.when(v.rlike(r"^[{\[]"), F.regexp_extract_all(v, F.lit(r'"(\./[^"]+)"(?=\s*[,}\]])'), F.lit(1))).otherwise(F.array(v))
    parts = F.from_json(raw, "map<string,string>", _JSON)
    by_path = F.when(F.exists(F.map_keys(parts), lambda k: F.startswith(k, F.lit("."))), F.transform(F.map_entries(parts), lambda e: F.struct(e["key"].alias("key"), paths(e["value"]).alias("value"))))
    exports = F.coalesce(by_path, F.when(raw.isNotNull(), F.array(F.struct(F.lit(".").alias("key"), paths(raw).alias("value")))), F.array().cast("array<struct<key:string,value:array<string>>>"))
    entries = F.filter(F.array("p.source", "p.types", "p.module", "p.main"), lambda e: e.isNotNull())
    return rows.groupBy("repo", F.col("p.name").alias("name")).agg(F.min_by(F.struct("dir", entries.alias("entries"), exports.alias("exports")), "dir").alias("w")).select("repo", "name", "w.*")


def _ladder(rows: DataFrame, tier: int, paths: Column, probe) -> DataFrame:
    """(repo, file, specifier, slot, rank, path): each of `paths` (an array, best first) with all that probe() makes of it."""
    one = rows.select("repo", "file", "specifier", "slot", F.posexplode(paths).alias("_i", "_p")).filter("_p IS NOT NULL")
    each = one.select("repo", "file", "specifier", "slot", "_i", F.posexplode(probe(F.col("_p"))).alias("_j", "path"))
    return each.select("repo", "file", "specifier", "slot", F.struct(F.lit(tier).alias("tier"), F.col("_i").alias("i"), F.col("_j").alias("j")).alias("rank"), "path")


def script_candidates(wanted: DataFrame, configs: DataFrame) -> list[DataFrame]:
    spec = F.col("specifier")
    relative = spec.rlike(r"^\.\.?(?:/|$)")
    near = wanted.filter(relative)
    folder = spec.rlike(r"(?:^|/)\.\.?$|/$") & spec.rlike(r"^(?:\.\.?)$|/$")
    out = [_ladder(near.filter(~folder), 0, F.array(inside(directory(F.col("file")), spec)), lambda p: _script_paths(p, F.lit(False))), _ladder(near.filter(folder), 0, F.array(inside(directory(F.col("file")), spec)), lambda p: _script_paths(p, F.lit(True)))]
    bare = wanted.filter(~relative & ~spec.rlike(r"^/|^(?i)[a-z][\w+.-]*:")).withColumn("_home", directory(F.col("file")))
    settings = script_settings(configs)
    # the nearest configuration above an importer, for each directory once
    ups = bare.select("repo", "_home").distinct().select("repo", "_home", F.explode(F.concat(F.array(F.lit(".")), ancestors(F.col("_home")))).alias("dir"))
    nearest = ups.join(settings, ["repo", "dir"]).groupBy("repo", "_home").agg(F.max_by(F.struct("dir", "root", "rules", "base"), F.when(F.col("dir") == ".", 0).otherwise(F.length("dir"))).alias("s")).select("repo", "_home", "s.*")
    ruled = bare.join(nearest, ["repo", "_home"])
    target = lambda t: F.when(t.rlike(r"^\$\{configDir\}"), inside(F.col("dir"), F.regexp_replace(t, r"^\$\{configDir\}/*", ""))).otherwise(inside(F.col("base"), t))
    whole = lambda p: _script_paths(p, F.lit(False))
    out.append(_ladder(ruled, 1, F.transform(_alias(spec), target), whole))
    out.append(_ladder(ruled.filter("root IS NOT NULL"), 2, F.array(inside(F.col("root"), spec)), whole))
    named = bare.filter(~F.startswith("specifier", F.lit("#"))).withColumn("name", F.when(F.startswith("specifier", F.lit("@")), F.regexp_extract("specifier", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract("specifier", r"^([^/]+)", 1)))
    packed = named.join(workspaces(configs).withColumnRenamed("dir", "_dir"), ["repo", "name"]).withColumn("_sub", F.regexp_replace(F.substring(spec, F.length("name") + 1, F.length(spec)), "^/", ""))
    key = F.when(F.col("_sub") == "", ".").otherwise(F.concat(F.lit("./"), F.col("_sub")))

    def exported(e: Column) -> Column:
        before, behind = _cut_at_star(e["key"])
        star = F.substring(key, F.length(before) + 1, F.length(key) - F.length(before) - F.length(behind))
        fits = F.contains(e["key"], F.lit("*")) & F.startswith(key, before) & F.endswith(key, behind) & (F.length(key) >= F.length(before) + F.length(behind))
        return F.when(fits, F.transform(e["value"], lambda v: F.replace(v, F.lit("*"), star))).otherwise(F.array().cast("array<string>"))

    exact = F.flatten(F.transform(F.filter("exports", lambda e: e["key"] == key), lambda e: e["value"]))
    targets = F.concat(exact, F.flatten(F.transform("exports", exported)), F.when(F.col("_sub") == "", F.col("entries")).otherwise(F.array().cast("array<string>")))
    # a built file stands for its source
    doubled = F.flatten(F.transform(targets, lambda t: F.when(t.rlike(BUILT), F.array(t, F.regexp_replace(t, BUILT, "src/"))).otherwise(F.array(t))))
    rest = F.when(F.col("_sub") == "", F.array(F.lit("src/index"), F.lit("index"))).otherwise(F.array("_sub", F.concat(F.lit("src/"), "_sub")))
    out.append(_ladder(packed, 3, F.transform(F.concat(doubled, rest), lambda t: inside(F.col("_dir"), t)), whole))
    return out


def python_candidates(wanted: DataFrame, files: DataFrame) -> list[DataFrame]:
    spec, home = F.col("specifier"), directory(F.col("file"))
    # each imported name may be a module of its own
    names = F.coalesce("names", F.array().cast("array<string>"))
    dotted = F.concat(F.array(spec), F.transform(names, lambda n: F.when(spec.rlike(r"^\.*$"), F.concat(spec, n)).otherwise(F.concat(spec, F.lit("."), n))))
    rows = wanted.select("repo", "file", "specifier", F.posexplode(dotted).alias("slot", "_s")).withColumns({"_dots": F.length(F.regexp_extract("_s", r"^(\.*)", 1)), "_rel": F.regexp_replace(F.regexp_extract("_s", r"^\.*(.*)$", 1), r"\.", "/")})
    near = rows.filter("_dots > 0")
    at = inside(home, F.concat(F.repeat(F.lit("../"), F.col("_dots") - 1), "_rel"))
    beside = lambda p: F.when(p == ".", F.array(F.lit("__init__.py"))).otherwise(_with(p, PYTHON_BESIDE))
    far, ups = rows.filter("_dots = 0"), F.reverse(ancestors(home))
    placed = F.concat(F.array(F.col("_rel")), F.transform(ups, lambda d: F.concat(d, F.lit("/"), "_rel")))
    out = [_ladder(near, 0, F.array(at), beside), _ladder(far, 1, placed, lambda p: _with(p, PYTHON_ENDINGS))]
    # modules by every tail of their path: one row a tail, the first in a source root and the only one anywhere
    module = F.regexp_replace(F.regexp_replace("file", r"\.pyi?$", ""), "/__init__$", "")
    parts = F.split("_m", "/", -1)
    tails = files.filter(F.col("file").rlike(r"\.pyi?$")).select("repo", F.col("file").alias("path"), module.alias("_m")).filter("_m <> '__init__'").select("repo", "path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("_rel"), F.element_at(parts, F.greatest(k - 1, F.lit(1))).alias("above")))).alias("t")).select("repo", "path", "t.*").filter("_rel <> ''")
    known = tails.join(far.select("repo", "_rel").distinct(), ["repo", "_rel"], "left_semi").groupBy("repo", "_rel").agg(F.min(F.when(F.col("above").isin(*PYTHON_ROOTS), F.col("path"))).alias("rooted"), F.when(F.count_distinct("path") == 1, F.min("path")).alias("only"))
    # the only one must not stand at the root as well, which the first step finds before
    met = far.join(known, ["repo", "_rel"]).withColumn("only", F.when(F.contains("_rel", F.lit("/")), F.col("only")))
    return [*out, _ladder(met, 2, F.array("rooted", "only"), lambda p: F.array(p))]


def go_targets(wanted: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """(repo, file, specifier, target): all files of a Go package but its tests; modules by their longest path."""
    modules = configs.filter(F.col("file").rlike(r"(?:^|/)go\.mod$")).select("repo", directory(F.col("file")).alias("_dir"), F.regexp_extract("content", r'(?m)^[ \t]*module[ \t]+"?([^\s"]+)"?', 1).alias("module")).filter("module <> ''").groupBy("repo", "module").agg(F.min("_dir").alias("_dir"))
    prefixes = wanted.select("repo", "file", "specifier", F.explode(ancestors(F.col("specifier"))).alias("module")).join(modules, ["repo", "module"])
    best = prefixes.groupBy("repo", "file", "specifier").agg(F.max_by(F.struct("module", "_dir"), F.length("module")).alias("m"))
    at = best.select("repo", "file", "specifier", inside(F.col("m._dir"), F.regexp_replace(F.substring("specifier", F.length("m.module") + 1, F.length("specifier")), "^/", "")).alias("dir"))
    held = files.filter(F.col("file").rlike(r"\.go$") & ~F.col("file").rlike(r"_test\.go$")).select("repo", directory(F.col("file")).alias("dir"), F.col("file").alias("target"))
    # without any module: the longest trailing path (of four to two parts) that only one directory has
    parts, n = F.split("dir", "/", -1), F.size(F.split("dir", "/", -1))
    dirs = files.select("repo", directory(F.col("file")).alias("dir")).distinct()
    tails = dirs.select("repo", "dir", F.explode(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.when(n >= k, F.array_join(F.slice(parts, n - k + 1, k), "/")))).alias("tail")).filter("tail IS NOT NULL").groupBy("repo", "tail").agg(F.min("dir").alias("dir"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    words, size = F.split("specifier", "/", -1), F.size(F.split("specifier", "/", -1))
    lone = wanted.join(modules.select("repo").distinct(), "repo", "left_anti").filter(F.contains(F.element_at(words, 1), F.lit(".")))
    guessed = lone.select("repo", "file", "specifier", F.explode(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.when(size > k, F.struct(k.alias("k"), F.array_join(F.slice(words, size - k + 1, k), "/").alias("tail"))))).alias("t")).filter("t IS NOT NULL").select("repo", "file", "specifier", "t.*").join(tails, ["repo", "tail"]).groupBy("repo", "file", "specifier").agg(F.max_by("dir", "k").alias("dir"))
    return at.unionByName(guessed).join(held, ["repo", "dir"]).select("repo", "file", "specifier", "target")


def php_candidates(wanted: DataFrame, configs: DataFrame) -> DataFrame:
    section = "struct<`psr-4`:map<string,string>>"
    parsed = _json(F.col("content"), f"autoload {section}, `autoload-dev` {section}")
    rules = F.concat(*(F.coalesce(F.map_entries(F.col("p").getField(f).getField("psr-4")), F.array().cast("array<struct<key:string,value:string>>")) for f in ("autoload", "autoload-dev")))
    rows = configs.filter(F.col("file").rlike(r"(?:^|/)composer\.json$")).select("repo", directory(F.col("file")).alias("dir"), parsed.alias("p")).select("repo", "dir", F.explode(rules).alias("r"))
    dirs = F.when(F.startswith("r.value", F.lit("[")), F.from_json("r.value", "array<string>")).otherwise(F.array("r.value"))
    known = rows.select("repo", F.regexp_replace("r.key", r"^\\+", "").alias("prefix"), F.transform(dirs, lambda d: F.when(d == "", F.col("dir")).otherwise(inside(F.col("dir"), d))).alias("dirs"))
    words = F.split("_s", r"\\", -1)
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.concat(F.array_join(F.slice(words, 1, k), "\\"), F.when(k < F.size(words), "\\").otherwise(""))))
    met = wanted.withColumn("_s", F.regexp_replace("specifier", r"^\\", "")).select("repo", "file", "specifier", "slot", "_s", F.explode(prefixes).alias("prefix")).join(known, ["repo", "prefix"])
    rest = F.concat(F.regexp_replace(F.substring("_s", F.length("prefix") + 1, F.length("_s")), r"\\", "/"), F.lit(".php"))
    ranked = met.select("repo", "file", "specifier", "slot", (-F.length("prefix")).alias("_n"), F.posexplode(F.transform("dirs", lambda d: inside(d, rest))).alias("_i", "path"))
    return ranked.select("repo", "file", "specifier", "slot", F.struct(F.col("_n").alias("tier"), F.col("_i").alias("i"), F.lit(0).alias("j")).alias("rank"), "path")


def resolve(wanted: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """(repo, file, specifier, target) of the specifiers that lead to files of their repository.

    wanted: repo, file, specifier, and names (of `from specifier import names`, or null); files: repo, file;
    configs: repo, file, content of the configurations. What leads nowhere, or to the importer, is left out.
    """
    home = directory(F.col("file"))
    # a stand-in for all files of a directory and language that ask for the same
    asking = F.concat_ws("/", F.when(home != ".", home), F.concat_ws("-", "_l", F.md5(F.coalesce(F.to_json("names"), F.lit("")))))
    every = cut(wanted.select("repo", "file", "specifier", "names", language(F.col("file")).alias("_l")).withColumn("_as", asking))
    rows = cut(every.select("repo", F.col("_as").alias("file"), "specifier", "names", F.lit(0).alias("slot"), "_l").distinct())
    of = lambda *names: rows.filter(F.col("_l").isin(*names)).drop("_l")
    spec = F.col("specifier")
    pubspecs = configs.filter(F.col("file").rlike(r"(?:^|/)pubspec\.yaml$")).select("repo", F.regexp_extract("content", r"(?m)^name:[ \t]*['\"]?(\w+)", 1).alias("name"), "file").filter("name <> ''").groupBy("repo", "name").agg(directory(F.min("file")).alias("_dir"))
    dart = of("dart").withColumn("name", F.regexp_extract("specifier", r"^package:(\w+)/", 1))
    plain = lambda p: F.array(p)
    ladders = [
        *script_candidates(of(*SCRIPTS), configs), *python_candidates(of("python"), files), php_candidates(of("php"), configs),
        _ladder(dart.filter(~spec.rlike(r"^\w+:")), 0, F.array(inside(home, spec)), plain), _ladder(dart.join(pubspecs, ["repo", "name"]), 0, F.array(inside(F.concat("_dir", F.lit("/lib")), F.regexp_replace("specifier", r"^package:\w+/", ""))), plain),
        _ladder(of("c", "cpp", "objective-c"), 0, F.array(inside(home, spec), inside(F.lit("."), spec)), plain),
    ]
    candidates = reduce(DataFrame.unionByName, ladders)
    met = candidates.join(files.select("repo", F.col("file").alias("path")).distinct(), ["repo", "path"])
    best = met.groupBy("repo", "file", "specifier", "slot").agg(F.min(F.struct("rank", "path"))["path"].alias("target")).select("repo", "file", "specifier", "target")
    found = best.unionByName(go_targets(of("go").select("repo", "file", "specifier"), files, configs)).distinct().withColumnRenamed("file", "_as")
    return every.select("repo", "_as", "file", "specifier").join(found, ["repo", "_as", "specifier"]).filter("target <> file").select("repo", "file", "specifier", "target").distinct()
