"""How quality filters interact: for each order in which they may be applied, what each step removes, and what it would have removed.

Words are rows: exploded, counted by document and word, then by document for totals and distincts. Other flags come from a second,
narrow pass, and an outer join brings both together (a text without words has no row among the words). Each part's documents are then
counted by which of the five filters they fail, as 32 conditional sums, from which all orders follow without another pass.

Equal texts fail the same filters of words and characters, so each text is counted once, and rows are added up by text before they
meet it: a text that a third of all rows hold is one row for each source there.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
#: Filters that a document of each mask fails; bit i is filter i.
MASKS = range(1 << len(FILTERS))
COUNTS = ("n", "good", "toxic")
KEY = ["h1", "h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and a text's key: 64 bits of one hash and 60 of another."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    second = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), second.alias("h2"))


def word_counts(docs: DataFrame) -> DataFrame:
    """h1, h2, n_words, n_distinct of the different texts that have words.

    One shuffle, of texts by key after equal ones of a task have become one; words are exploded behind it, where all of a text's
    words already are together, so that neither aggregation moves them.
    """
    texts = docs.groupBy(*KEY).agg(F.first("text").alias("text"))
    words = texts.select(*KEY, F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    each = words.groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    return each.groupBy(*KEY).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def other_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """h1, h2, part, c, d, good, toxic, n, n_late: rows counted by text, part and labels, with how many of them have a smaller id
    with the same text. A null id comes behind all others and has no label; of several labels of an id the greater counts."""
    text = F.col("text")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = [(upper * 100 > F.length(text) * 2).alias("c"), text.rlike("[#$%&*|]").alias("d")]
    rows = docs.groupBy("doc_id", "part", *KEY, *flags).agg(F.count("*").alias("n"))
    one = lambda c: F.coalesce(F.max(F.col(c).cast("long")) == 1, F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("_s", F.lit(0))
    # Null ids match nothing; they are spread over tasks by their text.
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod("h1", F.lit(1009))).otherwise(0).cast("int")
    told = rows.withColumn("_s", spread).join(known, ["doc_id", "_s"], "left")
    no = F.lit(False)
    groups = told.groupBy(*KEY, "part", "c", "d", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first")
    )
    # A text has a row for each part and labels at most, so its window is small.
    earliest = F.min("first").over(Window.partitionBy(*KEY))
    early = F.when(F.col("earliest").isNull(), F.col("n")).when(F.col("first") == F.col("earliest"), F.col("n_first")).otherwise(0)
    return groups.withColumn("earliest", earliest).select(*KEY, "part", "c", "d", "good", "toxic", "n", (F.col("n") - early).alias("n_late"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and arrays n, good, toxic: documents, those of good quality and toxic ones by the filters they fail (a mask)."""
    keyed = _keyed(docs)
    joined = other_flags(keyed, labels).join(word_counts(keyed), KEY, "left")
    words, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    failed = [words < 200, distinct * 100 < words * 50, F.col("c"), F.col("d")]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    late = F.struct((F.col("_m") + (1 << len(failed))).alias("mask"), F.col("n_late").alias("n"))
    early = F.struct(F.col("_m").alias("mask"), (F.col("n") - F.col("n_late")).alias("n"))
    rows = joined.withColumn("_m", bits).select("part", "good", "toxic", F.inline(F.array(early, late)))
    sums = []
    for name in COUNTS:
        counted = F.col("n") if name == "n" else F.when(F.col(name), F.col("n"))
        sums += [F.sum(F.when(F.col("mask") == m, counted)).alias(f"{name}_{m}") for m in MASKS]
    wide = rows.groupBy("part").agg(*sums)
    return wide.select("part", *(F.array(*(F.coalesce(f"{name}_{m}", F.lit(0)) for m in MASKS)).alias(name) for name in COUNTS))


def _steps() -> Column:
    """All orders and their steps: order, step, the step's filter as a bit, and the earlier ones' bits."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {step}, 'f', {bit}, 'b', {before})")
            before |= bit
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part of docs (doc_id,
    text, source), each of the 120 orders of five filters and each step; labels has doc_id, quality, toxic.

    Filters: A under 200 words, B less than half of the words distinct, C over 2% capitals, D any of #$%&*|, E the text of a smaller id.
    A null or empty text fails A only (and E if it repeats); texts of any length are counted whole; repeated rows count each, and
    neither is earlier than the other; a null source is part ''; an empty table has no parts.
    """
    steps = failures(docs, labels).select("*", F.inline(_steps()))
    over = lambda counts, holds: F.expr(f"aggregate(sequence(0, {len(MASKS) - 1}), 0L, (a, m) -> a + IF({holds}, {counts}[m], 0L))")
    removed = "m & f <> 0 AND m & b = 0"
    # A filter comes first of the k that a document fails in one order of k.
    shapley = F.expr(f"aggregate(sequence(1, {len(MASKS) - 1}), 0L, (a, m) -> a + IF(m & f <> 0, n[m] * 120 div bit_count(m), 0L))")
    return steps.select(
        "part", "filter_order", "step", over("n", "m & (b | f) = 0").alias("kept"), over("n", removed).alias("removed"), over("n", "m & f <> 0 AND m & b <> 0").alias("redundant"),
        F.expr("n[f]").alias("unique_fails"), over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )
