"""String grammar: gated casts, base64url, percent escapes, colours, wildcards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number and boolean grammar of option arguments.
INT_RE = r"^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")


def parse_int(value: Column) -> Column:
    """BIGINT, or NULL where the text is not a plain decimal integer."""
    return F.when(value.rlike(INT_RE), value.try_cast("bigint"))


def parse_float(value: Column) -> Column:
    """DOUBLE, or NULL where the text is not a plain decimal number."""
    return F.when(value.rlike(FLOAT_RE), value.try_cast("double"))


def parse_bool(value: Column) -> Column:
    """Unknown words are false, not an error."""
    return value.isin(*TRUE_WORDS)


def hex_rgb(value: Column) -> Column:
    """Six lower-case hex digits from a 3- or 6-digit colour, else NULL."""
    low = F.lower(value)
    return F.when(low.rlike("^[0-9a-f]{6}$"), low).when(
        low.rlike("^[0-9a-f]{3}$"), F.regexp_replace(low, "(.)", "$1$1")
    )


def b64url_encode(binary: Column) -> Column:
    """URL alphabet, no padding, no line breaks."""
    plain = F.regexp_replace(F.base64(binary), "[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def b64url_decode(text: Column) -> Column:
    """Bytes, or NULL where the text is not unpadded base64url."""
    good = text.rlike("^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1)
    standard = F.translate(text, "-_", "+/")
    padded = F.rpad(standard, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    return F.when(good, F.try_to_binary(padded, F.lit("base64")))


def path_unescape(text: Column) -> Column:
    """Percent-decode; '+' stays; a broken escape gives NULL."""
    whole = ~text.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(whole, F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))))


def wildcard_regex(pattern: str) -> str:
    """A '*' pattern as a regular expression anchored at the start; '*' never crosses '/'."""
    return "^" + "([^/]*)".join(re.escape(part) for part in pattern.split("*"))


def any_wildcard(value: Column, patterns: list[str]) -> Column:
    """True where any pattern matches; an empty list allows all."""
    if not patterns:
        return F.lit(True)
    return value.rlike("|".join(f"(?:{wildcard_regex(p)})" for p in patterns))


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def segment_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


NUMERIC_ENTITY = "&#(?:[0-9]+|[xX][0-9a-fA-F]+);?"


def _entity_char(entity: Column) -> Column:
    """Character of a numeric entity in the ASCII range; others stay as they are."""
    digits = F.regexp_extract(entity, "([0-9a-fA-F]+);?$", 1)
    code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    return F.when(code.between(1, 127), F.char(code)).otherwise(entity)


def html_unescape(text: Column) -> Column:
    """Numeric (ASCII) entities and the named ones that can hide a URL scheme."""
    # Entity -> character.
    named = {
        "&colon;": ":",
        "&Tab;": "\t",
        "&NewLine;": "\n",
        "&lt;": "<",
        "&gt;": ">",
        "&quot;": '"',
        "&amp;": "&",
    }
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC_ENTITY), F.lit(0)))
    # Longest first, so that no entity is replaced inside a longer one.
    ordered = F.array_sort(F.transform(found, lambda e: F.struct((-F.length(e)).alias("n"), e.alias("e"))))
    out = F.aggregate(ordered, text, lambda acc, x: F.replace(acc, x["e"], _entity_char(x["e"])))
    for entity, char in named.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out
