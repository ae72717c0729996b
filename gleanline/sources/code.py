"""Readers of repositories: files, imports, calls, manifests, and JSON in free text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.functions.paths import language, matches_any

MAX_FILE, MAX_REPLY = 512 * 1024, 256 * 1024
# Words that open control flow, expressions or declarations and so are never a name; the least length of a name and the greatest of a line.
KEYWORDS = "if for while switch catch return else do sizeof typeof new await yield function super this throw case when match elif with try delete assert print lambda and or not in is foreach using lock unless until loop defer go select struct class enum interface type const let var val fn func def public private protected static".split()
MIN_NAME, MAX_LINE = 3, 400


def file_units(spark: SparkSession, path: str, excluded: list[str], glob: str = "*") -> DataFrame:
    """(path, language, content, skipped) of a folder's files, recursively: excluded, too large or binary ones are named, not read into text."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return units(rows.select("path", "length", "content"), excluded)


def units(files: DataFrame, excluded: list[str]) -> DataFrame:
    """The same for rows of path, length and binary content."""
    reason = F.when(matches_any(F.col("path"), excluded), "excluded").when(F.col("length") > MAX_FILE, "too large").when(F.instr(F.decode("content", "ISO-8859-1"), F.lit("\u0000")) > 0, "binary")
    rows = files.withColumn("skipped", reason)
    return rows.select("path", F.when(F.col("skipped").isNull(), language(F.col("path"))).alias("language"), F.when(F.col("skipped").isNull(), F.decode("content", "UTF-8")).alias("content"), "skipped")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x != "")


def _parts(text: Column, separator: str = ",") -> Column:
    """The parts of a list, without what is renamed ('a as b' is a) and without spaces around."""
    return F.filter(F.transform(F.split(text, separator, -1), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r" as .*$", "")), lambda x: x != "")


def _each(found: Column, of) -> Column:
    return F.flatten(F.transform(found, of))


def imports(files: DataFrame) -> DataFrame:
    """files (with language and content) with `imports`: the distinct specifiers that a file's import statements name."""
    text = F.col("content")
    quoted = r"['\"]([^'\"\n]+)['\"]"
    # a static statement begins behind a line's end, ';' or '}' and has no quote before its module; its clause is empty or ends in `from`
    static = rf"(?:^|[;\n}}])[ \t]*(?:import|export)\b([^;'\"]*){quoted}"
    statements = F.zip_with(F.regexp_extract_all(text, F.lit(static), F.lit(1)), F.regexp_extract_all(text, F.lit(static), F.lit(2)), lambda clause, module: F.struct(clause.alias("clause"), module.alias("module")))
    called = r"\b(?:import|require|(?:jest|vi)\.(?:mock|doMock|unmock|requireActual|importActual))"
    script = F.concat(F.transform(F.filter(statements, lambda s: s["clause"].rlike(r"^\s*$|(?:^|[\s}*])from\s*$")), lambda s: s["module"]), _all(text, rf"{called}\s*\(\s*{quoted}\s*[,)]"))
    python = F.concat(_all(text, r"(?m)^[ \t]*from[ \t]+(\.*[A-Za-z_][\w.]*|\.+)[ \t]+import\b"), F.filter(_each(_all(text, r"(?m)^[ \t]*import[ \t]+([^\n#;]+)"), lambda x: _parts(x)), lambda m: m.rlike(r"^[A-Za-z_][\w.]*$")))
    go = F.concat(_all(text, r'(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"'), _each(_all(text, r"(?m)^[ \t]*import[ \t]*\(([^)]{0,20000})\)"), lambda b: _all(b, r'(?m)^[ \t]*(?:[\w.]+[ \t]+)?"([^"\n]+)"')))
    raw = _all(text, r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]*\w(?:\.\{[^}\n]*\}|\.\*)?)")
    braced = lambda s: F.transform(_parts(F.regexp_replace(F.regexp_extract(s, r"\.\{([^}]*)\}$", 1), r"\s*=>[^,]*", "")), lambda n: F.when(n == "_", F.regexp_replace(s, r"\.\{.*$", "")).otherwise(F.concat(F.regexp_replace(s, r"\{.*$", ""), n)))
    jvm = _each(raw, lambda s: F.when(s.rlike(r"\.\{"), braced(s)).otherwise(F.array(F.regexp_replace(s, r"\.[*_]$", ""))))
    sharp = _all(text, r"(?m)^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;")
    php = F.concat(F.filter(_each(_all(text, r"(?m)^[ \t]*use[ \t]+(?!function\b|const\b)([\w\\][^;{}]{0,2000});"), lambda x: _parts(x)), lambda n: n.rlike(r"^\\?\w+\\[\w\\]+$")), _all(text, rf"\b(?:require|include)(?:_once)?[ \t(]*(?:__DIR__[ \t]*\.[ \t]*)?{quoted}"))
    ruby = _all(text, rf"(?m)^[ \t]*require(?:_relative)?[ \t(]+{quoted}")
    rust = F.concat(_all(text, r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;"), _each(_all(text, r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?use[ \t]+([^;{}]{0,4000}(?:\{[^{};]{0,2000}\})?);"), lambda b: F.when(F.contains(b, F.lit("{")), F.transform(_parts(F.regexp_extract(b, r"\{([^}]*)\}", 1)), lambda n: F.when(n == "self", F.regexp_replace(b, r"::\{.*$", "")).otherwise(F.concat(F.regexp_replace(b, r"\{.*$", ""), n)))).otherwise(_parts(b))))
    c = _all(text, r"(?m)^[ \t]*#[ \t]*(?:include|import)[ \t]*[<\"]([^>\"\n]+)[>\"]")
    dart = _all(text, rf"(?m)^[ \t]*(?:import|export|part(?:[ \t]+of)?)[ \t]+{quoted}")
    kinds = [(("javascript", "typescript", "vue", "svelte"), script), (("python",), python), (("go",), go), (("java", "kotlin", "scala"), jvm), (("csharp",), sharp), (("php",), php), (("ruby",), ruby), (("rust",), rust), (("c", "cpp", "objective-c"), c), (("dart",), dart)]
    found = F.coalesce(*(F.when(F.col("language").isin(*names), x) for names, x in kinds), F.array().cast("array<string>"))
    return files.withColumn("imports", F.array_distinct(found))


def calls(lines: Column) -> Column:
    """The names that an array of lines calls, once each: what stands before an opening bracket and is no keyword."""
    found = F.flatten(F.transform(F.filter(lines, lambda x: F.length(x) <= MAX_LINE), lambda x: F.regexp_extract_all(x, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1))))
    return F.array_distinct(F.filter(found, lambda n: (F.length(n) >= MIN_NAME) & ~n.isin(*KEYWORDS)))


def resolve(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier, target): relative specifiers of script files as files of the repository; the first of the usual endings that exists.

    wanted: file, specifier; files: file. The candidates are exploded with their rank and joined by equality.
    """
    from gleanline.functions.text import posix_path

    base = F.regexp_replace("file", "[^/]*$", "")
    stem = posix_path(F.concat(base, F.lit("/"), "specifier"))
    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", "/index.ts", "/index.js"]
    options = F.concat(F.transform(F.array(*map(F.lit, endings)), lambda e, k: F.struct(k.alias("rank"), F.concat(stem, e).alias("target"))), F.array(F.struct(F.lit(len(endings)).alias("rank"), F.regexp_replace(stem, r"\.js$", ".ts").alias("target"))))
    each = wanted.filter(F.startswith("specifier", F.lit("."))).select("file", "specifier", F.explode(options).alias("o")).select("file", "specifier", "o.*")
    met = each.join(files.select(F.col("file").alias("target")).distinct(), "target")
    return met.groupBy("file", "specifier").agg(F.min(F.struct("rank", "target"))["target"].alias("target"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """(file, name, spec, scope) of the dependencies that manifests declare, by the file's name. manifests: file, content."""
    return manifests.select("file", F.explode(declared(F.col("file"), F.col("content"))).alias("d")).select("file", "d.*")


def declared(file: Column, text: Column) -> Column:
    """The dependencies (name, spec, scope) that a manifest declares, by the file's name; null for other files."""
    base = F.regexp_extract(file, "([^/]*)$", 1)
    pair = lambda name, spec, scope: F.struct(name.alias("name"), spec.alias("spec"), F.lit(scope).alias("scope"))
    maps = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>, require map<string,string>, `require-dev` map<string,string>"
    parsed = F.from_json(text, maps)
    of_map = lambda field, scope: F.transform(F.map_entries(F.coalesce(parsed.getField(field), F.create_map().cast("map<string,string>"))), lambda e: pair(e["key"], e["value"], scope))
    npm = F.concat(of_map("dependencies", "main"), of_map("devDependencies", "dev"), of_map("peerDependencies", "peer"), of_map("optionalDependencies", "optional"))
    composer = F.concat(of_map("require", "main"), of_map("require-dev", "dev"))

    def by_line(pattern: str, scope: str = "main", of: Column = text) -> Column:
        both = F.zip_with(F.regexp_extract_all(of, F.lit(pattern), F.lit(1)), F.regexp_extract_all(of, F.lit(pattern), F.lit(2)), lambda n, s: pair(n, F.trim(s), scope))
        return F.filter(both, lambda x: x["name"] != "")

    pip = F.transform(by_line(r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*([^\n#;]*)"), lambda x: pair(F.lower(F.regexp_replace(x["name"], "[-_.]+", "-")), x["spec"], "main"))
    go = F.concat(by_line(r"(?m)^[ \t]*require[ \t]+([^\s(]+)[ \t]+(v\S+)"), by_line(r"(?m)^[ \t]+([^\s(/][^\s(]*)[ \t]+(v[0-9]\S*)"))
    gems = by_line(r"(?m)^[ \t]*gem[ \t(]+['\"]([^'\"\n]+)['\"](?:[ \t]*,[ \t]*['\"]([^'\"\n]+)['\"])?")
    cargo_part = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^\[(?:workspace\.)?(?:dev-|build-)?dependencies\][ \t]*\n((?:(?!\[)[^\n]*\n?)*)"), F.lit(1)), "\n")
    cargo = by_line(r"(?m)^([A-Za-z0-9_-]+)[ \t]*=[ \t]*(?:\"|\{[^\n}]*version[ \t]*=[ \t]*\")([^\"\n]+)\"", of=cargo_part)
    pub_part = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^(?:dev_)?dependencies:[ \t]*\n((?:[ \t]+[^\n]*\n?)*)"), F.lit(1)), "\n")
    pub = by_line(r"(?m)^  ([A-Za-z0-9_]+):[ \t]*(\S[^\n]*)", of=pub_part)
    mix = by_line(r"\{:([a-z0-9_]+),[ \t]*\"([^\"\n]+)\"")
    csproj = by_line(r"<PackageReference[^>]*\bInclude=\"([^\"]+)\"[^>]*\bVersion=\"([^\"]+)\"")
    pom = by_line(r"<dependency>(?:(?!</dependency>)[\s\S])*?<artifactId>([^<]+)</artifactId>(?:(?!</dependency>)[\s\S])*?(?:<version>([^<]+)</version>)?\s*(?:<scope>[^<]*</scope>\s*)?</dependency>")
    gradle = by_line(r"(?m)^[ \t]*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt)[ \t(]+['\"]([^:'\"\n]+:[^:'\"\n]+):([^'\"\n]+)['\"]")
    kinds = [(base == "package.json", npm), (base == "composer.json", composer), (base.rlike(r"^requirements[^/]*\.txt$"), pip), (base == "go.mod", go), (base == "Gemfile", gems), (base == "Cargo.toml", cargo), (base == "pubspec.yaml", pub), (base == "mix.exs", mix), (base.rlike(r"\.csproj$"), csproj), (base == "pom.xml", pom), (base.rlike(r"^build\.gradle(?:\.kts)?$"), gradle)]
    return F.coalesce(*(F.when(test, x) for test, x in kinds))


def extract_json(text: Column) -> Column:
    """The JSON value in a reply, see found_json(): values are tried by a small helper, in Arrow batches."""
    return F.pandas_udf(found_json, "string")(text)


def found_json(texts: pd.Series) -> pd.Series:
    """The JSON value in a reply: that of its last fenced block that holds one, else the longest anywhere; commas before a closing bracket are forgiven. Null without any.

    A decoder is started at each opening bracket that no earlier value covers and says itself where the
    value ends, so brackets in strings and prose need no counting.
    """
    import json
    import re

    decoder, opening = json.JSONDecoder(), re.compile(r"[{\[]")
    spare_comma = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])')

    def values(text: str) -> list[tuple[int, object]]:
        found, at = [], 0
        while m := opening.search(text, at):
            try:
                value, at = decoder.raw_decode(text, m.start())
                found.append((at - m.start(), value))
            except (ValueError, RecursionError):
                at = m.end()
        return found

    def longest(text: str) -> tuple[int, object] | None:
        forgiven = spare_comma.sub(lambda m: m[1] or "", text)
        return max([*values(text), *(values(forgiven) if forgiven != text else [])], key=lambda v: v[0], default=None)

    def whole(block: str) -> tuple[int, object] | None:
        """The value that a fenced block is."""
        for candidate in (block, spare_comma.sub(lambda m: m[1] or "", block)):
            try:
                return 0, json.loads(candidate)
            except (ValueError, RecursionError):
                continue
        return None

    def one(text: str | None) -> str | None:
        tail = (text or "")[-MAX_REPLY:]
        fences = (part.partition("\n") for part in tail.split("```")[1:-1:2])
        blocks = [body for label, _, body in fences if label.strip().lower() in ("", "json")]
        best = next((v for v in map(whole, reversed(blocks)) if v), None) or longest(tail)
        return best and json.dumps(best[1], separators=(",", ":"), sort_keys=True, ensure_ascii=False)

    return texts.map(one)
