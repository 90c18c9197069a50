"""Identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_encoded(part: Column) -> Column:
    """As for a part of a URI: letters, digits and -_.!~*'() stay."""
    out = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def node_id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else percent_encoded(p) for p in parts))


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a over the characters' codes (for the basic plane, UTF-16 units)."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(2166136261).cast("long"), step)


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")


def entity_id(prefix: str, label: Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), slug(label), base36(fnv1a(F.concat_ws("|", *parts))))
