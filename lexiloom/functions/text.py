"""Text helpers with the semantics that the job formats need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_control(value: Column) -> Column:
    """Without leading and trailing characters up to the space."""
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def fields(line: Column) -> Column:
    """Tab-separated fields; empty ones at the end don't count."""
    return F.split(F.regexp_replace(line, r"\t+$", ""), "\t", -1)


def whole_number(value: Column) -> Column:
    """A signed integer without spaces, else null."""
    return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("bigint"))


def six(value: Column) -> Column:
    """A double with six decimals."""
    return F.format_string("%.6f", value)


def escape_html(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def safe_segment(value: Column) -> Column:
    """A path segment; blank becomes ``unknown``."""
    blank = value.isNull() | ~value.rlike(r"[^\p{javaWhitespace}]")
    return F.when(blank, "unknown").otherwise(F.regexp_replace(value, "[^A-Za-z0-9._-]", "_"))


def hash31(value: Column) -> Column:
    """Polynomial hash (31, 32 bits) of the UTF-8 bytes in lower-case hex."""
    raw = F.hex(F.coalesce(value, F.lit("")).cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.floor(F.length(raw) / 2).cast("int")), lambda i: F.conv(F.substr(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, b: (h * 31 + b).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.hex(F.when(F.length(raw) > 0, total).otherwise(F.lit(0).cast("bigint"))))


def is_http(url: Column) -> Column:
    """Whether a well-formed URL's scheme is http or https."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def link_or_text(url: Column, text: Column) -> Column:
    link = F.concat(F.lit("<a href='"), escape_html(url), F.lit("' target='_blank'>"), escape_html(text), F.lit("</a>"))
    return F.when(is_http(url), link).otherwise(escape_html(text))
