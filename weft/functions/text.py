"""Text as Column expressions: lines, labels, names, places of matches."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered_lines(content: Column) -> Column:
    """number, line: generates the lines of a text, from 1. To be used in a select."""
    return F.inline(F.transform(F.split(content, "\r?\n"), lambda line, i: F.struct((i + 1).alias("number"), line.alias("line"))))


def count_lines(content: Column) -> Column:
    """Lines of a text; a line break at the end adds none, and an empty text has none."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(F.length(content) == 0, 0).otherwise(breaks + F.when(content.endswith("\n"), 0).otherwise(1))


def truncated(label: Column, limit: int) -> Column:
    return F.when(F.length(label) > limit, F.concat(F.substring(label, 1, limit - 1), F.lit("…"))).otherwise(label)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def plural(name: Column) -> Column:
    """An English guess."""
    return (
        F.when(name.rlike("[^aeiou]y\\z"), F.regexp_replace(name, "y\\z", "ies"))
        .when(name.rlike("(?:s|x|z|ch|sh)\\z"), F.concat(name, F.lit("es")))
        .otherwise(F.concat(name, F.lit("s")))
    )


def located(content: str, pattern: str, group: int = 1) -> Column:
    """value, line: all matches of a pattern (of Python, over ASCII classes) in column `content`, with the line of the first character of the
    group; null for null. Spark's functions tell no places, so this runs in Python, in time linear in the text and its matches."""

    @F.pandas_udf("array<struct<value:string,line:int>>")
    def find(texts: pd.Series) -> pd.Series:
        search = re.compile(pattern, re.A)

        def one(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            breaks = [m.start() for m in re.finditer("\n", text)]
            return [{"value": m[group].strip(), "line": bisect_right(breaks, m.start(group) - 1) + 1} for m in search.finditer(text)]

        return texts.map(one)

    return find(F.col(content))
