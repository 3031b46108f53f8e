"""Scalar functions as Column builders: ids, title and keyword normal forms, set and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The URL namespace of name-based UUIDs (RFC 4122), words that a title's normal form drops.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
TITLE_STOP_WORDS = ["a", "the", "an", "dataset", "corpus", "data"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sha256_hex(x: Column | str) -> Column:
    """SHA-256 of bytes, or of a text's UTF-8 bytes."""
    return F.sha2(_c(x).cast("binary"), 256)


def uuid5_hex(name: Column | str) -> Column:
    """Name-based UUID (version 5, URL namespace) as 32 hex digits; a null name counts as the text 'None'."""
    named = F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.coalesce(_c(name), F.lit("None")), "UTF-8"))
    h = F.sha1(named)
    variant = F.substring(F.lit("89ab"), 1, 4)
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.substr(variant, digit, F.lit(1)), F.substring(h, 18, 15))


def or_none(x: Column | str) -> Column:
    """Null as the text 'None', as it enters ids."""
    return F.coalesce(_c(x), F.lit("None"))


def dataset_id(document: Column | str, title: Column | str) -> Column:
    return uuid5_hex(F.concat(or_none(document), F.lit(":"), or_none(title)))


def task_id(dataset: Column | str, description: Column | str) -> Column:
    return uuid5_hex(F.concat(or_none(dataset), F.lit(":"), or_none(description)))


def low63(hex_id: Column | str) -> Column:
    """The low 63 bits of a 32-digit hex id."""
    return F.conv(F.substring(_c(hex_id), 17, 16), 16, -10).cast("bigint").bitwiseAND(F.lit(9223372036854775807))


def normalize_title(title: Column | str) -> Column:
    """Lower case; word characters, white space and hyphens only; stop words out; single spaces.  Null: empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(_c(title), F.lit(""))), r"(?U)[^\w\s-]", "")
    without = F.regexp_replace(kept, r"(?U)\b(" + "|".join(TITLE_STOP_WORDS) + r")\b", "")
    return F.trim(F.regexp_replace(without, r"(?U)\s+", " "))


def strip(x: Column | str) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def one_line(x: Column | str) -> Column:
    return F.translate(_c(x), "\n", " ")


def extension(path: Column | str) -> Column:
    """The file name's extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(_c(path), r"[^/]+?(\.[^./]*)$", 1))


def parse_keywords(reply: Column | str) -> Column:
    """A comma-separated reply as trimmed, non-empty keywords; one full stop goes from the last.  Empty: none."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(reply), F.lit("")), ","), strip), lambda x: x != "")
    last = F.regexp_replace(F.element_at(parts, -1), r"\.$", "")
    return F.when(F.size(parts) == 0, parts).otherwise(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)))


def keyword_overlap(a: Column | str, b: Column | str) -> Column:
    """Common distinct keywords over those of the smaller set; 0 if either is empty or null."""
    x, y = (F.coalesce(_c(v), F.array().cast("array<string>")) for v in (a, b))
    smaller = F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / smaller)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def json_object(reply: Column | str) -> Column:
    """From the first opening to the last closing brace, across lines; empty if there is none."""
    return F.regexp_extract(F.coalesce(_c(reply), F.lit("")), r"(?s)\{.*\}", 0)
