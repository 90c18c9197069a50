"""Fill-in-the-middle: documents are cut into prefix, middle and suffix at line ends, told apart by hashes of their ids, and put together
around sentinels in one of two orders. Everything is one projection of built-in functions, so rows never meet.

Null ids are hashed as empty ones, null texts are empty; a text of any length, with any number of lines, is cut at two of them, and
repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a line with its end, or what follows the last one.
UNIT = "[^\\n]*\\n|[^\\n]+"
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _draw(digest: Column, nth: int) -> Column:
    """The nth group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * (nth - 1) + 1, 8), 16, 10).cast("long")


def _piece(units: Column, start: Column, stop: Column) -> Column:
    """Units from start (of 0) up to, not including, stop."""
    return F.array_join(F.slice(units, start + 1, stop - start), "")


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and the columns `keep` of docs (doc_id, text).

    n units give n + 1 places to cut. `rate` of a hundred documents are rearranged, `spm` of a hundred of these with the suffix
    first (spm), the others with the prefix first (psm). An empty text, or one that holds a sentinel, stays plain.
    """
    p, s, m = sentinels
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    # Columns to keep travel as one, so that their names clash with none here.
    carried = [F.struct(*(docs[c] for c in keep)).alias("_keep")] if keep else []
    read = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), hashed.alias("digest"), *carried)
    kept = ["_keep"] if keep else []
    n = F.size("units")
    ends = [_draw(F.col("digest"), i) % (n + 1) for i in (1, 2)]
    marked = F.lit(False)
    for sign in sentinels:
        marked = marked | F.contains("text", F.lit(sign))
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 4) % 100 < spm, "spm").otherwise("psm")
    cut = read.select("doc_id", "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(*ends).cast("int").alias("low"), F.greatest(*ends).cast("int").alias("high"), *kept)
    units = F.col("units")
    pieces = F.struct(_piece(units, F.lit(0), F.col("low")).alias("prefix"), _piece(units, F.col("low"), F.col("high")).alias("middle"), _piece(units, F.col("high"), n).alias("suffix"))
    split = cut.select("doc_id", "text", "n", "form", F.when(F.col("form") != "plain", pieces).alias("_p"), *kept)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(p), "_p.prefix", F.lit(s), "_p.suffix", F.lit(m), "_p.middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(s), "_p.suffix", F.lit(p), "_p.prefix", F.lit(m), "_p.middle"))
        .otherwise(F.col("text"))
    )
    chars = lambda part: F.length(f"_p.{part}").cast("long").alias(f"{part}_chars")
    made = split.select("doc_id", "n", "form", chars("prefix"), chars("middle"), output.alias("output"), *kept)
    return made.select(*(c for c in made.columns if c != "_keep"), "_keep.*") if keep else made


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of fill_in_middle() was made of. No piece holds a sentinel, and none ends in a part of one that a
    sentinel behind it would complete, so they are where the output is split."""
    parts = F.split(output, "|".join("\\Q" + s + "\\E" for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def with_digests(made: DataFrame) -> DataFrame:
    """made with output_sha256 and restored_sha256 for its output."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select(*(c for c in made.columns if c != "output"), digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))
