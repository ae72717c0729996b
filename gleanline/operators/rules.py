"""Line rules: a table of regular expressions with scopes, tried on the lines of all files in one pass.

A rule looks at files of its languages or paths, and only where the whole file matches file_if and not
file_not_if. It is tried on each line, or on a line and `window` following ones, of which its match must
begin on the first; comment lines are left out unless it asks for them. Lines are clipped, and of files
with changed ranges only what touches a changed line counts. Patterns keep to what Java and RE2 read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.functions import paths, redaction
from gleanline.operators import findings

MAX_LINE, MAX_MARKER_LINE, MAX_FILE = 1000, 2000, 2_000_000
_SLASH = ["javascript", "typescript", "vue", "svelte", "java", "kotlin", "scala", "groovy", "csharp", "go", "rust", "c", "cpp", "swift", "php", "dart"]
_HASH = ["python", "ruby", "shell", "yaml", "toml", "dockerfile", "terraform", "makefile", "elixir", "php"]
JS = ("javascript", "typescript", "vue", "svelte")


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str
    category: str
    confidence: float
    languages: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    not_if: str | None = None
    file_if: str | None = None
    file_not_if: str | None = None
    window: int = 0
    comments: bool = False
    dedupe_key: str | None = None


_PY, _GO, _JAVA, _RB, _PHP, _SH, _C, _DOCKER, _YAML, _TF, _SQL = ("python",), ("go",), ("java", "kotlin"), ("ruby",), ("php",), ("shell",), ("c", "cpp"), ("dockerfile",), ("yaml",), ("terraform",), ("sql",)
CODE = tuple(dict.fromkeys((*JS, *_PY, *_GO, *_JAVA, *_RB, *_PHP, *_C)))
RULES: list[Rule] = [
    Rule("js-dynamic-code", r"\b(?:eval|Function)\s*\(", "major", "security", 0.6, JS, not_if=r"\.eval\("),
    Rule("js-inner-html", r"\.(?:inner|outer)HTML\s*\+?=", "major", "security", 0.5, JS, not_if=r"sanitize|DOMPurify"),
    Rule("js-document-write", r"\bdocument\.write(?:ln)?\s*\(", "minor", "security", 0.45, JS),
    Rule("js-react-raw", r"dangerouslySetInnerHTML", "major", "security", 0.55, JS),
    Rule("js-exec-shell", r"\bexec(?:Sync)?\(\s*`[^`]{0,200}\$\{", "critical", "security", 0.7, JS, file_if="child_process"),
    Rule("js-loose-null", r"[^=!]==\s*(?:null|undefined)\b", "info", "bug", 0.3, JS),
    Rule("js-async-foreach", r"\.forEach\(\s*async\b", "major", "concurrency", 0.65, JS),
    Rule("js-float-promise", r"^\s*fetch\([^)]{0,200}\);?$", "minor", "concurrency", 0.4, JS),
    Rule("js-empty-catch", r"catch\s*(?:\([^)]{0,80}\))?\s*\{\s*\}", "minor", "error-handling", 0.5, JS, window=2),
    Rule("js-parse-int", r"\bparseInt\(\s*[A-Za-z_.]+\s*\)", "info", "bug", 0.3, JS),
    Rule("js-prototype", r"__proto__", "major", "security", 0.5, JS),
    Rule("js-random-token", r"(?i)(?:token|secret|nonce)\w*\s*=\s*Math\.random", "major", "security", 0.6, JS),
    Rule("js-cors-any", r"(?i)origin\s*:\s*['\"]\*['\"]", "minor", "security", 0.45, JS, file_if="cors"),
    Rule("js-timer-text", r"set(?:Timeout|Interval)\(\s*['\"]", "major", "security", 0.6, JS),
    Rule("js-console", r"\bconsole\.(?:log|debug)\(", "info", "maintainability", 0.3, JS, file_not_if="#!/usr/bin/env node"),
    Rule("py-dynamic-code", r"\b(?:eval|exec)\(", "major", "security", 0.6, _PY, not_if="literal_eval"),
    Rule("py-shell", r"subprocess\.[a-z_]+\([^)]{0,200}shell\s*=\s*True", "critical", "security", 0.7, _PY, window=2),
    Rule("py-system", r"\bos\.(?:system|popen)\(", "major", "security", 0.55, _PY),
    Rule("py-pickle", r"\bpickle\.loads?\(", "major", "security", 0.6, _PY, file_if="import pickle"),
    Rule("py-yaml", r"\byaml\.load\(", "major", "security", 0.6, _PY, not_if="SafeLoader"),
    Rule("py-bare-except", r"^\s*except\s*:", "minor", "error-handling", 0.5, _PY),
    Rule("py-except-pass", r"except[^:]{0,80}:\s*\n\s*pass\b", "minor", "error-handling", 0.5, _PY, window=1),
    Rule("py-mutable-default", r"def\s+\w+\([^)]{0,200}=\s*(?:\[\]|\{\})", "minor", "bug", 0.6, _PY),
    Rule("py-no-verify", r"verify\s*=\s*False", "major", "security", 0.6, _PY),
    Rule("py-debug", r"\bdebug\s*=\s*True", "minor", "security", 0.4, _PY, file_if="(?i)flask"),
    Rule("py-assert", r"^\s*assert\s*\(.{0,100},", "minor", "bug", 0.5, _PY),
    Rule("py-mktemp", r"\btempfile\.mktemp\(", "major", "security", 0.6, _PY),
    Rule("py-is-literal", r"\bis\s+(?:not\s+)?['\"0-9]", "minor", "bug", 0.5, _PY),
    Rule("py-md5", r"hashlib\.(?:md5|sha1)\(", "minor", "security", 0.4, _PY),
    Rule("go-ignored-error", r",\s*_\s*:?=\s*\w+", "minor", "error-handling", 0.4, _GO),
    Rule("go-skip-verify", r"InsecureSkipVerify\s*:\s*true", "major", "security", 0.7, _GO),
    Rule("go-sprintf-sql", r"Sprintf\(\s*\"(?i:select|insert|update|delete)\b", "critical", "security", 0.65, _GO),
    Rule("go-defer-loop", r"^\s*for\b[^\n]{0,200}\{\s*\n\s*defer\b", "major", "resource-leak", 0.55, _GO, window=1),
    Rule("go-panic", r"\bpanic\(", "minor", "error-handling", 0.35, _GO),
    Rule("go-unsafe", r"\bunsafe\.Pointer\b", "minor", "security", 0.4, _GO, file_if='"unsafe"'),
    Rule("go-background", r"context\.(?:Background|TODO)\(\)", "info", "concurrency", 0.3, _GO),
    Rule("java-query", r"createQuery\(\s*\"[^\"]{0,200}\"\s*\+", "critical", "security", 0.65, _JAVA),
    Rule("java-runtime", r"Runtime\.getRuntime\(\)\.exec\(", "major", "security", 0.6, _JAVA),
    Rule("java-swallow", r"catch\s*\([^)]{0,80}\)\s*\{\s*\}", "minor", "error-handling", 0.55, _JAVA, window=1),
    Rule("java-deserialize", r"\.readObject\(\s*\)", "major", "security", 0.5, _JAVA, file_if="ObjectInputStream"),
    Rule("java-xml", r"DocumentBuilderFactory\.newInstance\(", "major", "security", 0.5, _JAVA, file_not_if="disallow-doctype-decl"),
    Rule("java-string-same", r"[A-Za-z_]\w*\s*==\s*\"", "minor", "bug", 0.6, _JAVA),
    Rule("java-print-trace", r"\.printStackTrace\(\)", "info", "error-handling", 0.35, _JAVA),
    Rule("rb-send", r"\.send\(\s*params", "major", "security", 0.6, _RB),
    Rule("rb-html-safe", r"\.html_safe\b|\braw\(", "minor", "security", 0.45, _RB),
    Rule("rb-where-text", r"\.where\(\s*\"[^\"]{0,200}#\{", "critical", "security", 0.7, _RB),
    Rule("rb-rescue-nil", r"\brescue\s+nil\b", "minor", "error-handling", 0.5, _RB),
    Rule("php-superglobal-sql", r"(?i)query\([^)]{0,200}\$_(?:get|post|request)", "critical", "security", 0.75, _PHP),
    Rule("php-unserialize", r"\bunserialize\(", "major", "security", 0.55, _PHP),
    Rule("php-silence", r"(?:^|[\s=(])@\w+\(", "info", "error-handling", 0.35, _PHP),
    Rule("sh-pipe-shell", r"\b(?:curl|wget)\b[^|\n]{0,200}\|\s*(?:ba|z)?sh\b", "major", "security", 0.6, (*_SH, *_DOCKER), dedupe_key="pipe"),
    Rule("sh-rm-variable", r"\brm\s+-[a-z]*r[a-z]*\s+\"?\$", "major", "data-loss", 0.5, _SH),
    Rule("sh-chmod-all", r"\bchmod\s+(?:-R\s+)?0?777\b", "minor", "security", 0.5, (*_SH, *_DOCKER)),
    Rule("c-unbounded", r"\b(?:strcpy|strcat|sprintf|gets)\s*\(", "major", "security", 0.6, _C),
    Rule("c-format", r"\bprintf\s*\(\s*[a-z_]\w*\s*\)", "major", "security", 0.55, _C),
    Rule("c-malloc-mul", r"\bmalloc\([^)\n]{0,80}\*", "minor", "security", 0.4, _C),
    Rule("docker-latest", r"(?i)^FROM\s+\S+:latest\b", "minor", "supply-chain", 0.5, _DOCKER),
    Rule("docker-add-url", r"(?i)^ADD\s+https?://", "minor", "supply-chain", 0.5, _DOCKER),
    Rule("docker-root", r"(?i)^USER\s+root\b", "minor", "security", 0.4, _DOCKER),
    Rule("docker-curl-pipe", r"(?i)^RUN\b[^\n]{0,200}\|\s*(?:ba)?sh\b", "major", "security", 0.55, _DOCKER, dedupe_key="pipe"),
    Rule("yaml-target", r"^\s*pull_request_target\s*:", "major", "security", 0.6, _YAML, ("**/workflows/*",)),
    Rule("yaml-checkout-head", r"ref:\s*\$\{\{\s*github\.event\.pull_request\.head", "critical", "security", 0.7, _YAML, file_if="pull_request_target"),
    Rule("yaml-privileged", r"^\s*privileged\s*:\s*true", "major", "security", 0.6, _YAML),
    Rule("tf-open", r"cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"", "major", "security", 0.6, _TF),
    Rule("tf-public", r"acl\s*=\s*\"public-", "major", "security", 0.65, _TF),
    Rule("sql-no-where", r"(?i)^\s*(?:delete\s+from|update)\s+\w+[^;]{0,200};", "critical", "data-loss", 0.5, _SQL, not_if=r"(?i)\bwhere\b"),
    Rule("sql-drop", r"(?i)^\s*drop\s+(?:table|column)\b", "major", "data-loss", 0.5, _SQL, not_if=r"(?i)if\s+exists"),
    Rule("any-conflict", r"^(?:<{7}|>{7})(?:\s|$)", "critical", "bug", 0.8, CODE, comments=True),
    Rule("any-later", r"\b(?:TODO|FIXME|XXX)\b", "info", "maintainability", 0.3, CODE, comments=True),
    Rule("any-http", r"['\"]http://[a-z0-9.-]+", "info", "security", 0.3, CODE, not_if=r"localhost|127\.0\.0\.1|www\.w3\.org"),
    Rule("any-password", r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*['\"][^'\"\s]{6,}['\"]", "major", "security", 0.55, CODE, dedupe_key="secret"),
    Rule("any-debugger", r"^\s*(?:debugger;?|breakpoint\(\)|binding\.pry)\s*$", "minor", "bug", 0.6, CODE),
]

# The markers by which tools are silenced, and whether they concern security.
MARKERS = {
    "nosemgrep": (r"(?i)\bnosemgrep\b", True),
    "nosec": (r"(?i)(?:#|//|/\*)\s*nosec\b", True),
    "gitleaks-allow": (r"(?i)\bgitleaks:allow\b", True),
    "secretlint-disable": (r"\bsecretlint-disable\b", True),
    "secret-allowlist": (r"(?i)\btrufflehog:ignore\b|\bpragma:\s*allowlist\s+secret\b", True),
    "nosonar": (r"\bNOSONAR\b", True),
    "codeql": (r"\b(?:codeql|lgtm)\[[\w/.-]+\]", True),
    "iac-skip": (r"(?i)\bcheckov:skip=|\btfsec:ignore:|\btrivy:ignore:|\bkics-scan\s+ignore\b", True),
    "noqa": (r"(?i)#\s*noqa\b", False),
    "python-type-ignore": (r"#\s*(?:type|pyright|mypy):\s*ignore\b|#\s*pylint:\s*disable\b", False),
    "eslint-disable": (r"\beslint-disable(?:-next-line|-line)?\b|\b(?:oxlint|biome|deno-lint)-(?:disable|ignore)\b", False),
    "ts-ignore": (r"@ts-(?:ignore|expect-error|nocheck)\b", False),
    "nolint": (r"\bNOLINT(?:NEXTLINE|BEGIN)?\b|//\s*nolint\b", False),
    "rubocop-disable": (r"\brubocop:disable\b", False),
    "phpstan-ignore": (r"@(?:phpstan-ignore|psalm-suppress)\b", False),
    "suppress-warnings": (r"@SuppressWarnings\s*\(|@Suppress\s*\(|#\s*pragma\s+warning\s+disable\b|#!?\[allow\(", False),
    "shellcheck-disable": (r"#\s*shellcheck\s+disable=", False),
    "hadolint-ignore": (r"#\s*hadolint\s+(?:global\s+)?ignore=", False),
}
_FIELDS = ["rule_id", "severity", "category", "confidence", "dedupe_key"]


def is_comment(language: Column, line: Column) -> Column:
    """Whether a line is nothing but a comment in its language."""
    t = F.ltrim(F.regexp_replace(line, r"^\s+", ""))
    slash = language.isin(*_SLASH) & t.rlike(r"^(?://|/\*|\*(?:\s|/|$))")
    hash_ = language.isin(*_HASH) & t.rlike(r"^#(?:[^!\[]|$)")
    other = ((language == "sql") & t.rlike(r"^(?:--|/\*)")) | (language.isin("html", "vue", "svelte", "markdown") & F.startswith(t, F.lit("<!--")))
    return (t != "") & (slash | hash_ | other)


def _touched(first: Column, last: Column) -> Column:
    return F.col("ranges").isNull() | F.exists("ranges", lambda r: (r["a"] <= last) & (r["b"] >= first))


def _file_flags(rules: list[Rule]) -> Column:
    """Numbers of the rules that the whole file bars."""
    bars = []
    for k, r in enumerate(rules):
        if r.file_if or r.file_not_if:
            barred = (~F.col("content").rlike(r.file_if) if r.file_if else F.lit(False)) | (F.col("content").rlike(r.file_not_if) if r.file_not_if else F.lit(False))
            bars.append(F.when(_in_scope(r) & barred, F.lit(k)))
    return F.array_compact(F.array(*bars)) if bars else F.array().cast("array<int>")


def _in_scope(r: Rule) -> Column:
    scope = F.col("language").isin(*r.languages) if r.languages else F.lit(False)
    return scope | paths.matches_any(F.col("path"), list(r.globs)) if r.globs else scope


def _of_language(rules: list[Rule], tried: Callable[[int, Rule], Column]) -> Column:
    """An array of what tried() makes of the rules in a row's scope: a row goes through the list of its own language alone, and through the rules by path."""
    lists: dict[tuple, list[str]] = {}
    for name in dict.fromkeys(n for r in rules for n in r.languages):
        lists.setdefault(tuple((k, name in r.languages) for k, r in enumerate(rules) if name in r.languages or r.globs), []).append(name)
    made = [tried(k, r) for k, r in enumerate(rules)]
    array = lambda ks: F.array(*(made[k] if inside else F.when(paths.matches_any(F.col("path"), list(rules[k].globs)), made[k]) for k, inside in ks))
    by_path = tuple((k, False) for k, r in enumerate(rules) if r.globs)
    return F.coalesce(*(F.when(F.col("language").isin(*names), array(ks)) for ks, names in lists.items()), *([array(by_path)] if by_path else []))


def lines(files: DataFrame, following: int = 0, clip: int = MAX_LINE) -> DataFrame:
    """files without content, with at (from 1), line and `text`: the line and so many following ones. No shuffle: a file's lines are cut within its row."""
    cut = F.transform(F.split("content", "\r?\n", -1), lambda x: F.substring(x, 1, clip))
    kept = [c for c in files.columns if c not in ("content", "_ls")]
    rows = files.withColumn("_ls", cut)
    more = F.transform("_ls", lambda x, i: F.struct((i + 1).alias("at"), x.alias("line"), F.array_join(F.slice("_ls", i + 1, following + 1), "\n").alias("text") if following else x.alias("text")))
    return rows.select(*kept, F.explode(more).alias("_l")).select(*kept, "_l.*")


def scan(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(file, start, end, rule_id, severity, category, confidence, dedupe_key) of all matches. files: file, path, language, content, ranges (null: all lines)."""
    rules = RULES if rules is None else rules
    whole = files.filter((F.length("content") <= MAX_FILE) & (F.instr("content", F.lit("\u0000")) == 0)).select("file", "path", "language", "content", "ranges")
    rows = lines(whole.withColumn("barred", _file_flags(rules)), max((r.window for r in rules), default=0)).filter("line <> ''")
    rows = rows.withColumn("comment", is_comment(F.col("language"), F.col("line")))

    def tried(k: int, r: Rule) -> Column:
        text = F.substring_index("text", "\n", r.window + 1) if r.window else F.col("line")
        here = rf"\A[^\n]*?({r.pattern})" if r.window else None
        hit = (F.lit(True) if r.comments else ~F.col("comment")) & text.rlike(here or r.pattern)
        if r.file_if or r.file_not_if:
            hit = hit & ~F.array_contains("barred", k)
        if r.not_if:
            hit = hit & ~text.rlike(r.not_if)
        last = F.col("at") + (F.size(F.split(F.regexp_extract(text, here, 1), "\n", -1)) - 1 if here else F.lit(0))
        values = (r.id, r.severity, r.category, r.confidence, r.dedupe_key)
        return F.when(hit, F.struct(*(F.lit(v).cast("double" if n == "confidence" else "string").alias(n) for n, v in zip(_FIELDS, values, strict=True)), last.alias("end")))

    hits = rows.select("file", "ranges", F.col("at").alias("start"), F.explode(F.array_compact(_of_language(rules, tried))).alias("h")).select("file", "ranges", "start", "h.*")
    return hits.filter(_touched(F.col("start"), F.col("end"))).select("file", "start", "end", *_FIELDS)


def suppressions(files: DataFrame) -> DataFrame:
    """Markers that silence a tool, on changed lines, as hints of the lowest severity."""
    rows = lines(files.select("file", "content", "ranges"), clip=MAX_MARKER_LINE)
    each = [F.when(F.col("line").rlike(p), F.struct(F.lit(m).alias("rule_id"), F.lit("security" if secure else "bug").alias("category"), F.lit(0.35 if secure else 0.3).alias("confidence"))) for m, (p, secure) in MARKERS.items()]
    hits = rows.filter(_touched(F.col("at"), F.col("at"))).select("file", F.col("at").alias("start"), F.col("at").alias("end"), F.explode(F.array_compact(F.array(*each))).alias("h"))
    return hits.select("file", "start", "end", "h.rule_id", F.lit("info").alias("severity"), "h.category", "h.confidence", F.lit(None).cast("string").alias("dedupe_key"))


def secrets(files: DataFrame) -> DataFrame:
    """Credentials in lines, whatever comments say: critical, not to be dismissed, and masked in the message."""
    rows = lines(files.select("file", "content", "ranges"), clip=MAX_MARKER_LINE)
    hit = F.col("line").rlike(redaction.TOKEN) | F.col("line").rlike("-----BEGIN [A-Z ]*PRIVATE KEY-----")
    kind = F.when(F.col("line").rlike(r"\bgh[pousr]_|github_pat_"), "github").when(F.col("line").rlike("PRIVATE KEY"), "private-key").when(F.col("line").rlike(r"\b(?:A3T[A-Z0-9]|AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}"), "aws").otherwise("token")
    found = rows.filter(_touched(F.col("at"), F.col("at")) & hit)
    message = F.concat(F.lit("Hard-coded secret: "), redaction.clean_message(F.col("line")))
    return found.select("file", F.col("at").alias("start"), F.col("at").alias("end"), kind.alias("rule_id"), F.lit("critical").alias("severity"), F.lit("security").alias("category"), F.lit(0.9).alias("confidence"), F.lit("secret").alias("dedupe_key"), message.alias("message"))


def analyze(files: DataFrame) -> DataFrame:
    """The final hits of all built-in analyzers over files (file, path, language, content, ranges)."""
    none = F.lit(None).cast("string")
    parts = [(scan(files).withColumn("message", none), "patterns", False), (suppressions(files).withColumn("message", none), "suppressions", False), (secrets(files), "secrets", True)]
    hits = None
    for rows, analyzer, firm in parts:
        tagged = rows.withColumn("analyzer", F.lit(analyzer)).withColumn("non_rejectable", F.lit(firm)).withColumn("message", F.coalesce("message", "rule_id"))
        hits = tagged if hits is None else hits.unionByName(tagged)
    n = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.endswith("content", F.lit("\n")), 0).otherwise(1)
    about = files.select("file", F.greatest(n, F.lit(1)).alias("n_lines"), "ranges", paths.is_test(F.col("path")).alias("is_test"))
    return findings.finalize_hits(hits, about)
