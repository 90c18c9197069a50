"""Fields of a data model as text, and back; names for files and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs between a field's parts, and its flags in order.
STORED, TYPED, FLAGGED = " -> ", ": ", " ["
FLAGS = ("PK", "UNIQUE", "GENERATED", "NOT NULL", "NULL", "RELATION", "INFERRED")


def flags(pk: Column, uniq: Column, nullable: Column, generated: Column | None = None, related: Column | None = None, inferred: Column | None = None) -> Column:
    """The flags that hold, joined by commas."""
    holds = dict(zip(FLAGS, (pk, uniq, generated, ~nullable, nullable, related, inferred)))
    marks = F.array(*(F.when(c, name) for name, c in holds.items() if c is not None))
    return F.array_join(F.array_compact(marks), ", ")


def field_text(name: Column, stored: Column, kind: Column, *marks: Column) -> Column:
    """`name -> stored: type [flags]`, without the parts that are missing; a stored name like the name itself is left out. marks: see flags()."""
    told = flags(*marks)
    own = F.when((stored != "") & (stored != name), F.concat(F.lit(STORED), stored))
    return F.concat(name, F.coalesce(own, F.lit("")), F.when(kind != "", F.concat(F.lit(TYPED), kind)).otherwise(""), F.when(told != "", F.concat(F.lit(FLAGGED), told, F.lit("]"))).otherwise(""))


def parsed_field(value: Column) -> Column:
    """name, stored, type, pk, uniq, nullable, generated, related, inferred of a field's text; nullable is null where it says nothing. Any
    text gives a name at least.

    What stands in brackets at the end are flags if all of it are known ones; the first sign of a type ends the names.
    """
    pieces = F.split(value, "\\Q" + FLAGGED + "\\E", -1)
    tail = F.element_at(pieces, -1)
    listed = F.split(F.rtrim(tail, F.lit("]")), ", ")
    flagged = (F.size(pieces) > 1) & tail.endswith("]") & (F.size(F.array_except(listed, F.array(*map(F.lit, FLAGS)))) == 0)
    marks = F.when(flagged, listed).otherwise(F.array().cast("array<string>"))
    plain = F.when(flagged, F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), FLAGGED)).otherwise(value)
    sides = F.split(plain, TYPED, 2)
    names = F.split(sides[0], STORED, 2)
    has = lambda mark: F.array_contains(marks, mark)
    return F.struct(
        names[0].alias("name"), F.coalesce(F.get(names, F.lit(1)), names[0]).alias("stored"), F.nullif(F.get(sides, F.lit(1)), F.lit("")).alias("type"), has("PK").alias("pk"), has("UNIQUE").alias("uniq"),
        F.when(has("NOT NULL"), False).when(has("NULL"), True).alias("nullable"), has("GENERATED").alias("generated"), has("RELATION").alias("related"), has("INFERRED").alias("inferred"),
    )


def file_name(title: Column, suffix: str = ".md") -> Column:
    """A title as the name of a file."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.concat(F.when(plain == "", "schema").otherwise(plain), F.lit(suffix))


def anchor(title: Column) -> Column:
    """The link target that Markdown readers give a heading."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def mermaid(name: Column) -> Column:
    """A name as a word of a Mermaid diagram."""
    return F.regexp_replace(name, r"\W", "_")


def told(*maps: Column) -> Column:
    """Entries of all maps, later ones over earlier ones, without empty values; `Fields` may be empty."""

    def over(held: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(new, k)), new)

    return F.map_filter(reduce(over, maps), lambda k, v: v.isNotNull() & ((v != "") | (k == "Fields")))
