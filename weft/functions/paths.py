"""Paths of a workspace as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*\\z", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """What follows the last dot of the lower-cased name; empty without a dot."""
    return F.lower(F.regexp_extract(basename(path), "\\.([^.]*)\\z", 1))


def stem(path: Column) -> Column:
    """The name without its extension; a name that begins with its only dot stays whole."""
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]*\\z", "")


def normalised(path: Column) -> Column:
    """With / for \\, without empty and `.` parts, and with `..` taken back (above the top it is dropped)."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: ~x.isin("", "."))
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def glob(pattern: str) -> str:
    """A glob as an anchored regular expression: ** over folders, * and ? within one, {a,b} (nested too), [abc], [!abc].

    A pattern that isn't well formed matches nothing.
    """
    out, at, depth = "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at) and (at == 0 or pattern[at - 1] in "/{,"):
            out, at = out + "(?:[^/]+/)*", at + 3
            continue
        if pattern.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "[":
            end = pattern.find("]", at + 2)
            if end < 0:
                return NOTHING
            inside = pattern[at + 1 : end]
            negated = inside.startswith(("!", "^"))
            body = re.sub(r"([\\\[\]^&])", r"\\\1", inside[negated:])
            out, at = out + f"(?!/)[{'^' if negated else ''}{body}]", end + 1
            continue
        if c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        at += 1
    return NOTHING if depth else f"\\A(?:{out})\\z"


NOTHING = "(?!)"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches any of the globs."""
    return path.rlike("|".join(map(glob, patterns))) if patterns else F.lit(False)
