"""Figures for readers, and versions as ecosystems write them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The long-term releases of Node by name.
CODENAMES = {"argon": 4, "boron": 6, "carbon": 8, "dubnium": 10, "erbium": 12, "fermium": 14, "gallium": 16, "hydrogen": 18, "iron": 20, "jod": 22, "krypton": 24, "lithium": 26}
_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}


def money(amount: Column, currency: Column) -> Column:
    """$0.420, €1.20, 0.0031 CHF: small amounts keep more digits."""
    value = F.when(amount == 0, F.format_string("%.2f", amount)).when(amount < 0.01, F.format_string("%.4f", amount)).when(amount < 1, F.format_string("%.3f", amount)).otherwise(F.format_string("%.2f", amount))
    symbol = F.coalesce(*(F.when(currency == k, F.lit(v)) for k, v in _SYMBOLS.items()))
    return F.coalesce(F.concat(symbol, value), F.concat_ws(" ", value, currency))


def duration(ms: Column) -> Column:
    """420ms, 3.2s, 38s, 1m 02s, 1h 05m; a dash for a null."""
    v = F.greatest(ms, F.lit(0))
    s = F.floor(v / 1000 + 0.5)
    m = F.floor(s / 60 + 0.5)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.when(v < 1000, F.concat(v.cast("string"), F.lit("ms"))).when(v < 10_000, F.concat(F.format_string("%.1f", F.floor(v / 100) / 10), F.lit("s"))).when(s < 60, F.concat(s.cast("string"), F.lit("s")))
    text = text.when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), two(s % 60), F.lit("s"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), two(m % 60), F.lit("m")))
    return F.coalesce(F.when(ms.isNotNull(), text), F.lit("—"))


def token_count(n: Column) -> Column:
    """950, 4.8k, 48k, 1.2M."""
    short = lambda x, unit: F.concat(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))
    return F.when(n < 1000, n.cast("string")).when(n < 10_000, short(n / 1000, "k")).when(n < 1_000_000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k"))).otherwise(short(n / 1_000_000, "M"))


def _numbers(text: Column) -> Column:
    found = F.regexp_extract(text, r"^v?=?([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(found != "", found)


def _codename(name: Column) -> Column:
    return F.coalesce(*(F.when(name == k, F.lit(str(v))) for k, v in CODENAMES.items()))


def node_version(text: Column) -> Column:
    """The version a Node file names: 22, v22.11.0, lts/iron; null for 'node' or 'stable'."""
    s = F.lower(F.trim(text))
    name = F.regexp_extract(s, r"^(?:lts/)?([a-z]+)$", 1)
    return F.when(name != "", _codename(name)).otherwise(_numbers(s))


def python_version(text: Column) -> Column:
    return _numbers(F.regexp_replace(F.trim(text), r"(?i)^(?:cpython|pypy|graalpy|python)[@-]?", ""))


def java_version(text: Column) -> Column:
    """21, 17.0.2, VERSION_1_8: the old 1.x releases are x."""
    v = _numbers(F.regexp_replace(F.regexp_replace(F.trim(text), "(?i)^version_", ""), "_", "."))
    return F.regexp_replace(v, r"^1\.(?=[1-8](?:\.|$))", "")


def framework_version(text: Column) -> Column:
    """net8.0 and netcoreapp3.1 are 8.0 and 3.1, net472 is 4.7.2; an API set has none."""
    t = F.lower(F.trim(text))
    modern = F.regexp_extract(t, r"^net(?:coreapp)?([0-9]{1,2}\.[0-9]{1,2})", 1)
    old = F.regexp_extract(t, r"^net([0-9]{2,3})$", 1)
    return F.when(modern != "", modern).when(old != "", F.array_join(F.filter(F.split(old, ""), lambda c: c != ""), "."))


def image_tag(ref: Column) -> Column:
    """The tag of an image reference, without its digest."""
    bare = F.regexp_replace(F.trim(ref), "@.*$", "")
    tag = F.regexp_extract(bare, r"^(?:.*/)?[^/:]*:([^/]*)$", 1)
    return F.when((tag != "") & (F.length(tag) <= 128), tag)


def image_version(ref: Column) -> Column:
    """The version in an image's tag, by number or by a Node codename."""
    tag = F.lower(image_tag(ref))
    name = F.regexp_extract(tag, "^([a-z]+)(?:-|$)", 1)
    return F.when(name != "", _codename(name)).otherwise(_numbers(tag))


def substituted(ref: Column, args: Column) -> Column:
    """A reference with ${NAME}, ${NAME:-default} and $NAME filled in from a map; null where a name has no value."""
    tokens = F.regexp_extract_all(ref, F.lit(r"\$\{[A-Za-z_]\w{0,63}(?::?[-+][^}]{0,100})?\}|\$[A-Za-z_]\w{0,63}|[^$]+|\$"), F.lit(0))

    def fill(token: Column) -> Column:
        name = F.regexp_extract(token, r"^\$\{?([A-Za-z_]\w*)", 1)
        sign, word = F.regexp_extract(token, r"^\$\{\w+:?([-+])", 1), F.regexp_extract(token, r"^\$\{\w+:?[-+]([^}]*)\}", 1)
        value = F.try_element_at(args, name)
        some = F.coalesce(value, F.lit("")) != ""
        return F.when(name == "", token).when(sign == "-", F.when(some, value).otherwise(word)).when(sign == "+", F.when(some, word).otherwise("")).otherwise(value)

    parts = F.transform(tokens, fill)
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ""))
