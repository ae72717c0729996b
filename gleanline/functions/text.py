"""Scalar functions over review texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["critical", "major", "minor", "info"]


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for info; null for any other."""
    return F.coalesce(*(F.when(severity == s, F.lit(k)) for k, s in enumerate(SEVERITIES)))


def title_words(title: Column) -> Column:
    """The distinct lower-case words of more than two characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


#: White space as JavaScript's \\s has it.
SPACES = "[ \\t\\n\\x0B\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
#: Lines and characters of code that a fingerprint takes in.
MAX_CODE_LINES, MAX_CODE_CHARS = 200, 20000


def normal_code(lines: Column) -> Column:
    """An array of lines with white space collapsed and trimmed, blank ones dropped, joined; at most 20000 characters."""
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    return F.substring(F.array_join(F.filter(tidy, lambda x: x != ""), "\n"), 1, MAX_CODE_CHARS)


def normal_title(title: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(title), SPACES, " ")), 1, 500)


def parts_hash(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts joined by NUL; a null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def finding_fingerprint(file: Column, category: Column, rule: Column, title: Column, start: Column, end: Column, lines: Column, version: str = "1") -> Column:
    """A finding's identity: its file, category, rule and code; where no code can be read, its title instead."""
    first = F.greatest(start, F.lit(1))
    last = F.least(F.greatest(first, end), first + MAX_CODE_LINES - 1)
    code = F.coalesce(normal_code(F.slice(lines, first.cast("int"), (last - first + 1).cast("int"))), F.lit(""))
    by_title = parts_hash(F.lit(version), F.lit("title"), file, category, rule, normal_title(title))
    return F.when(code == "", by_title).otherwise(parts_hash(F.lit(version), F.lit("code"), file, category, rule, code))


def fingerprint(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts joined by a control character, for parts without one; a null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounded by floor(x + 1/2), which both engines compute alike."""
    return F.floor(x * 10**digits + F.lit(0.5)).cast("double") / 10**digits


def redact(text: Column) -> Column:
    """Token shapes replaced: private key blocks, prefixed tokens, long hexadecimal runs."""
    out = F.regexp_replace(text, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "[REDACTED]")
    out = F.regexp_replace(out, "(AKIA|ghp_|xox[bp]-|sk-)[A-Za-z0-9_-]{8,}", "[REDACTED]")
    return F.regexp_replace(out, "[0-9a-f]{32,}", "[REDACTED]")


def version_key(version: Column, parts: int = 3) -> Column:
    """A version as an array of whole numbers, padded with zeros, which compares as versions do."""
    found = F.transform(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.array(*(F.coalesce(F.get(found, F.lit(k)), F.lit(0)) for k in range(parts)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def posix_path(path: Column) -> Column:
    """A path with forward slashes, without empty and '.' parts, and with '..' resolved as far as there is something to leave."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/", -1), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.array_join(up, "/")


def term_filter(key: Column, tags: Column, terms: list[str]) -> Column:
    """Whether any term includes a row (a tag, a glob over the key, the key's beginning; all rows without such terms) and none behind '!' does."""
    from gleanline.functions.paths import glob_regex

    def fits(term: str) -> Column:
        globbed = key.rlike(glob_regex(term)) if any(c in term for c in "*?[{") else F.lit(False)
        return F.array_contains(tags, term) | globbed | F.startswith(key, F.lit(term))

    wanted, barred = [t for t in terms if not t.startswith("!")], [t[1:] for t in terms if t.startswith("!")]
    out = F.lit(not wanted)
    for term in wanted:
        out = out | fits(term)
    for term in barred:
        out = out & ~fits(term)
    return out
