"""Untrusted text as column expressions: secrets masked, control characters removed, long text clipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of credentials, and what a random token looks like.
TOKEN = r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|sk-(?:ant-|proj-)?[A-Za-z0-9_-]{16,}|AIza[0-9A-Za-z_-]{30,}|(?:A3T[A-Z0-9]|AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,})"
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"
LONG, MIN_ENTROPY, MAX_MESSAGE = r"[A-Za-z0-9+/_=-]{32,}", 3.8, 300
MASK = "[REDACTED]"


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    size = F.length(s).cast("double")
    share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / size
    letters = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))


def looks_random(s: Column) -> Column:
    """Letters and digits mixed at a high entropy, and no path made of short parts."""
    path = F.contains(s, F.lit("/")) & F.forall(F.split(s, "/", -1), lambda p: F.length(p) <= 24)
    return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~path & (entropy(s) >= MIN_ENTROPY)


def redact(text: Column) -> Column:
    """A text without credentials: known prefixes, private keys, and long tokens that look random."""
    known = F.regexp_replace(F.regexp_replace(text, TOKEN, MASK.replace("$", "")), KEY_BLOCK, MASK)
    found, gaps = F.regexp_extract_all(known, F.lit(LONG), F.lit(0)), F.split(known, LONG, -1)
    tail = F.transform(found, lambda m: F.when(looks_random(m), MASK).otherwise(m))
    joined = F.array_join(F.flatten(F.zip_with(gaps, tail, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    return F.when(F.size(found) > 0, joined).otherwise(known)


def strip_unsafe(text: Column) -> Column:
    """A text without escape sequences, control characters (but for tab and line breaks) and marks of writing direction."""
    plain = F.regexp_replace(text, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)?|[@-Z\\-_])", "")
    plain = F.regexp_replace(plain, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    return F.regexp_replace(plain, r"[؜‎‏‪-‮⁦-⁩]", "")


def clip(text: Column, most: int) -> Column:
    """At most so many characters; an ellipsis marks a cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…")))


def clean_message(message: Column) -> Column:
    flat = F.regexp_replace(redact(message), r"[\x00-\x1F\x7F]+", " ")
    return clip(F.trim(F.regexp_replace(flat, r"\s+", " ")), MAX_MESSAGE)


def tokens(text: Column) -> Column:
    """An estimate of a text's tokens: four characters each, times a margin; long runs of spaces or of one word count by their length."""
    runs = lambda pattern, each: F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda n, r: n + F.ceil(F.length(r) / each).cast("int"))
    blank, solid = runs(r"\s{256,}", 8), runs(r"\S{256,}", 3)
    rest = F.length(F.regexp_replace(text, r"\s{256,}|\S{256,}", ""))
    return F.when((text == "") | text.isNull(), F.lit(0)).otherwise(F.ceil((F.ceil(rest / 4) + blank + solid) * 1.15)).cast("long")
