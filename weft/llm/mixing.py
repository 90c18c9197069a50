"""Mixing sources to target weights: each source gives the mix an exact number of words, some documents twice, in an order like that of
one great shuffle, without sorting all documents.

A source's documents are dealt into blocks by hash, a power of two of them. A bijection of block numbers, another for each pass, is the
order in which blocks are drawn; how far a pass goes is its quota, and the last block gives the words that are still missing. A tree
splits the quotas: each node's draws are halved, and how many of each source go left is drawn from the hypergeometric distribution,
which is what halving a perfect shuffle would give. At the leaves, the output shards, each source's next draws are taken, and only the
draws of a shard are shuffled. All is built of SQL functions and hashes of given seeds, so a run can be repeated.

Blocks are at most some 2^21 and one for each source, whatever the size of the table; what is as long as the documents is one narrow
table (ids, sizes, hashes), and documents meet only their own block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import saved

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, over and over; words of the mix for each word of the input; how often a document may be taken.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Blocks have so many words and rows, or as many as make 2^20 blocks of all; a shard has about so many draws.
BLOCK_WORDS, BLOCK_ROWS, BLOCKS, DRAWS = 4096, 64, 1 << 20, 64
#: Running sums go over stretches of 2^6 blocks, and over the stretches.
STRETCH = 6
#: Sources up to this number are broadcast; more are joined by shuffle, with each source's documents dealt over so many keys.
BROADCAST, SALTS = 100_000, 64


def _hash(value: Column, part: int = 0) -> Column:
    """60 bits of the MD5 of a string."""
    return F.conv(F.substring(value, 1 + 15 * part, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, k1, k2: words and hashes of each row, kept beside; nothing later reads the texts again."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    light = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias("_d"))
    return saved(light.select("doc_id", "source", "size", _hash(F.col("_d")).alias("k1"), _hash(F.col("_d"), 1).alias("k2")))


def _numbered(frame: DataFrame, order: Column, name: str) -> DataFrame:
    """frame with its rows' places in an order, from 0: sorted over all tasks, then counted within and before each task."""
    placed = saved(frame.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    tasks = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row for each task
    before = tasks.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_p", part).join(before, "_p").select(*frame.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def sources(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sid, source, source_size, n_rows, target: sources in the order of their names, null last, and the words that each should give.

    The mix has `share` times all words, dealt by weight; a source that would give more than `passes` times its words gives that, and
    the rest is dealt among the others. So a target is the smaller of that bound and the weight times one level for all, and the
    level is raised until none is above its bound: a few sums over the sources, of which the driver sees two numbers.
    """
    totals = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ranked = _numbered(totals, F.col("source").asc_nulls_last(), "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    weighed = saved(ranked.select("sid", "source", "source_size", "n_rows", weight.cast("double").alias("weight")))
    bound, level, full = F.col("source_size") * passes, 0.0, -1
    words = weighed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.col("weight") * level >= bound
        row = weighed.agg(F.count_if(above).alias("full"), F.sum(F.when(above, bound)).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if row["full"] == full or not row["free"]:
            break
        full, level = row["full"], (words * share - (row["given"] or 0)) / row["free"]
    return weighed.select("sid", "source", "source_size", "n_rows", F.least(F.col("weight") * level, bound.cast("double")).alias("target"))


def _blocked(found: DataFrame, words: int, rows: int) -> DataFrame:
    """sources with `bits`: each has 2^bits blocks."""
    per_words, per_rows = max(BLOCK_WORDS, -(-words // BLOCKS)), max(BLOCK_ROWS, -(-rows // BLOCKS))
    need = F.greatest(F.ceil(F.col("source_size") / per_words), F.ceil(F.col("n_rows") / per_rows), F.lit(1)).cast("long")
    return found.withColumn("bits", F.when(need == 1, 0).otherwise(F.length(F.bin(need - 1))))


def _permuted(number: Column, bits: Column, salt: Column) -> Column:
    """A bijection of the numbers below 2^bits: odd multiples and a shifted xor, each of which can be undone."""
    mask = F.expr("shiftleft(1L, bits)") - 1
    first = let((number * 741103597 + F.shiftright(salt, 24)).bitwiseAND(mask), lambda x: x.bitwiseXOR(F.call_function("shiftright", x, F.greatest(F.lit(1), F.ceil(bits / 2).cast("int")))))
    return (first * 612420109 + salt.bitwiseAND((1 << 24) - 1)).bitwiseAND(mask)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _with_source(light: DataFrame, found: DataFrame, n_sources: int) -> DataFrame:
    """light with its source's columns and its block."""
    few = found.select("sid", "source", "source_size", "target", "bits")
    if n_sources <= BROADCAST:
        joined = light.join(F.broadcast(few.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    else:
        salted = few.withColumnRenamed("source", "_s").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = light.join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.pmod("k2", F.lit(SALTS)) == F.col("_salt"))).drop("_salt")
    return joined.withColumn("block", F.col("k1").bitwiseAND(F.expr("shiftleft(1L, bits)") - 1)).drop("_s", "bits", "source")


def drawn_blocks(placed: DataFrame, found: DataFrame, seed: int = 0) -> DataFrame:
    """sid, pass, nth, block, block_words, words: the blocks that each source gives in each pass, in order. `words` is less than the block
    has for the last one of a pass. Words before a block are summed in stretches of blocks first, and then over the stretches."""
    sums = placed.groupBy("sid", "block").agg(F.sum("size").alias("block_words"))
    goal = F.round("target").cast("long")
    passes = F.array(F.struct(F.lit(1).alias("pass"), F.least(goal, "source_size").alias("quota")), F.struct(F.lit(2).alias("pass"), F.greatest(goal - F.col("source_size"), F.lit(0).cast("long")).alias("quota")))
    each = found.select("sid", "bits", F.inline(passes)).where("quota > 0")
    salt = _hash(F.md5(F.concat(F.lit(f"{seed}:"), F.col("sid").cast("string"), F.lit(":"), F.col("pass").cast("string"))))
    numbers = each.withColumn("_salt", F.pmod(salt, F.lit(1 << 48))).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, bits)") - 1)))
    ordered = numbers.select("sid", "pass", "quota", "nth", F.shiftright("nth", STRETCH).alias("_s"), _permuted(F.col("nth"), F.col("bits"), F.col("_salt")).alias("block"))
    ordered = ordered.join(sums, ["sid", "block"], "left").withColumn("block_words", F.coalesce("block_words", F.lit(0)))
    ahead = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = ordered.groupBy("sid", "pass", "_s").agg(F.sum("block_words").alias("_sum"))
    stretches = stretches.select("sid", "pass", "_s", ahead("_sum", ["sid", "pass"], "_s").alias("_base"))
    inside = ordered.withColumn("_inner", ahead("block_words", ["sid", "pass", "_s"], "nth")).join(stretches, ["sid", "pass", "_s"])
    before = F.col("_base") + F.col("_inner")
    return saved(inside.where(before < F.col("quota")).select("sid", "pass", "nth", "block", "block_words", F.least(F.col("block_words"), F.col("quota") - before).alias("words")))


def _log_factorial(x: Column) -> Column:
    """ln x!: exact for small x, Stirling's series beyond (its error is below 1e-12 there)."""
    y = x.cast("double")
    series = y * F.ln(y) - y + F.ln(y * 6.283185307179586) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(uniform: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of `marked` among `total` are in a draw of `drawn`, from one uniform number: probabilities are taken off it from the most
    likely count outwards, each from its neighbour's by a ratio, until it is used up."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(marked, drawn)

    def search(s: Column) -> Column:
        mode, lo, hi, n, k, t = s["mode"], s["low"], s["high"], s["drawn"], s["marked"], s["total"]
        log = _log_factorial
        start = F.exp(log(k) - log(mode) - log(k - mode) + log(t - k) - log(n - mode) - log(t - k - n + mode) - log(t) + log(n) + log(t - n))
        state = F.struct(s["u"].alias("u"), mode.alias("up"), start.alias("pu"), mode.alias("down"), start.alias("pd"), F.when(s["u"] < start, mode).alias("found"), F.lit(True).alias("odd"))
        state = state.withField("u", s["u"] - start)

        def step(a: Column, _: Column) -> Column:
            rise = F.when(a["up"] < hi, a["pu"] * (k - a["up"]) * (n - a["up"]) / ((a["up"] + 1) * (t - k - n + a["up"] + 1))).otherwise(0.0)
            fall = F.when(a["down"] > lo, a["pd"] * a["down"] * (t - k - n + a["down"]) / ((k - a["down"] + 1) * (n - a["down"] + 1))).otherwise(0.0)
            p = F.when(a["odd"], rise).otherwise(fall)
            at = F.when(a["odd"], a["up"] + 1).otherwise(a["down"] - 1)
            moved = F.struct(
                (a["u"] - p).alias("u"), F.when(a["odd"] & (a["up"] < hi), a["up"] + 1).otherwise(a["up"]).alias("up"), F.when(a["odd"], rise).otherwise(a["pu"]).alias("pu"),
                F.when(~a["odd"] & (a["down"] > lo), a["down"] - 1).otherwise(a["down"]).alias("down"), F.when(a["odd"], a["pd"]).otherwise(fall).alias("pd"),
                F.when((a["u"] < p) & (p > 0), at).alias("found"), (~a["odd"]).alias("odd"),
            )
            return F.when(a["found"].isNotNull(), a).otherwise(moved)

        # Forty deviations to each side are beyond what a uniform number can tell apart.
        spread = F.sqrt(n.cast("double") * k / t * (1 - k.cast("double") / t)) * 80 + 80
        steps = F.sequence(F.lit(0).cast("long"), F.least(2 * (hi - lo) + 2, spread.cast("long")))
        return F.coalesce(F.aggregate(steps, state, step)["found"], mode)

    mode = F.least(high, F.greatest(low, F.floor((drawn + 1).cast("double") * (marked + 1) / (total + 2)).cast("long")))
    whole = F.struct(uniform.alias("u"), total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), low.alias("low"), high.alias("high"), mode.alias("mode"))
    return F.when((low == high) | (total == 0), low).otherwise(let(whole, search))


def _halved(seed: int) -> Column:
    """The left child's quotas of a node (node, quotas): each source's share is drawn given what is left of both."""
    zero = F.lit(0).cast("long")
    total = F.aggregate("quotas", zero, lambda a, x: a + x)
    start = F.struct(total.alias("rest"), F.shiftright(total, 1).alias("room"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        quota = F.get("quotas", i)
        uniform = F.pmod(F.xxhash64(F.lit(seed), F.col("node"), i), F.lit(1 << 53)) / float(1 << 53)
        return let(hypergeometric(uniform, a["rest"], quota, a["room"]), lambda x: F.struct((a["rest"] - quota).alias("rest"), (a["room"] - x).alias("room"), F.array_append(a["out"], x).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size("quotas") - 1), start, step)["out"]


def shards(draws: DataFrame, found: DataFrame, seed: int = 0, draws_per_shard: int = DRAWS) -> DataFrame:
    """draws with `shard` and `place`, their order in it. A node of the tree is a row with the quotas of all sources, each pass by itself;
    the number of leaves is a power of two, and they differ by one draw at most."""
    counts = draws.groupBy("sid", "pass").agg(F.count("*").alias("quota"))
    every = counts.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, (max(1, every // draws_per_shard)).bit_length() - 1)
    of_source = found.select("sid", F.explode(F.array(*map(F.lit, range(1, PASSES + 1)))).alias("pass")).join(counts, ["sid", "pass"], "left")
    quotas = of_source.select(F.struct("sid", "pass", F.coalesce("quota", F.lit(0)).alias("quota")).alias("q"))
    tree = quotas.agg(F.transform(F.array_sort(F.collect_list("q")), lambda x: x["quota"]).alias("quotas")).where("size(quotas) > 0").select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(levels):
        split = tree.withColumn("left", _halved(seed))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        tree = split.select(F.inline(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))))
        if level % 4 == 3:  # nodes grow in number: they are dealt out, and lineage is cut
            tree = saved(tree.repartition("node"))
    leaves = tree.select((F.col("node") - (1 << levels)).alias("shard"), F.posexplode("quotas").alias("_i", "quota")).where("quota > 0")
    leaves = leaves.select(F.expr(f"_i div {PASSES}").alias("sid"), (F.col("_i") % PASSES + 1).alias("pass"), "shard", "quota")
    since = F.coalesce(F.sum("quota").over(Window.partitionBy("sid", "pass").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = leaves.withColumn("_since", since).select("sid", "pass", "shard", F.explode(F.expr("sequence(_since, _since + quota - 1)")).alias("nth"))
    order = F.xxhash64(F.lit(seed + 1), "sid", "pass", "nth")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(order, "sid", "pass", "nth")) - 1
    return draws.join(dealt, ["sid", "pass", "nth"]).withColumn("place", place.cast("long"))


class Mix:
    """A mix of docs (doc_id, text, source): `draws` tells which blocks each output shard takes, in its order; `documents` where each
    document goes; `taken` how many of its words the mix has."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 0):
        light = sizes(docs, seed)
        found = sources(light, weights, share)
        totals = found.agg(F.sum("source_size").alias("words"), F.sum("n_rows").alias("rows"), F.count("*").alias("n")).first()
        self.sources = saved(_blocked(found, totals["words"] or 0, totals["rows"] or 0))
        self.placed = _with_source(light, self.sources, totals["n"])
        self.draws = saved(shards(drawn_blocks(self.placed, self.sources, seed), self.sources, seed))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: a row for each of docs."""
        return self._shares().select("doc_id", "size", "source_size", "target", sum(_share(p) for p in (1, 2)).alias("taken"))

    def documents(self) -> DataFrame:
        """doc_id, shard, place, words: a row for each time that a document is taken; place orders a shard's documents."""
        at = [F.when(_share(p) > 0, F.struct(F.col(f"at{p}.shard").alias("shard"), F.col(f"at{p}.place").alias("place"), _share(p).alias("words"))) for p in (1, 2)]
        found = self._shares().select("doc_id", "k2", F.inline(F.array_compact(F.array(*at))))
        return found.select("doc_id", "shard", F.struct("place", "k2").alias("place"), "words")

    def _shares(self) -> DataFrame:
        """placed with cut1, before1, at1 and so on: what of its block each pass takes (null: nothing), what lies before in it, and where."""
        of = lambda name, p: F.max(F.when(F.col("pass") == p, F.col(name)))
        aggregates = [x for p in (1, 2) for x in (of("words", p).alias(f"cut{p}"), F.max(F.when(F.col("pass") == p, F.struct("shard", "place"))).alias(f"at{p}"))]
        blocks = self.draws.groupBy("sid", "block").agg(F.max("block_words").alias("block_words"), *aggregates)
        # Within a block that is taken in part, documents come in the order of their hashes; equal rows share what they get. There are
        # two such blocks of a source at most, one for each pass.
        partly = blocks.where("cut1 < block_words OR cut2 < block_words").select("sid", "block")
        inside = self.placed.join(partly, ["sid", "block"], "left_semi").groupBy("sid", "block", "k1", "k2", "size").agg(F.count("*").alias("m"))
        for p in (1, 2):
            window = Window.partitionBy("sid", "block").orderBy(f"k{p}", f"k{3 - p}", "size").rowsBetween(Window.unboundedPreceding, -1)
            inside = inside.withColumn(f"before{p}", F.coalesce(F.sum(F.col("size") * F.col("m")).over(window), F.lit(0)))
        return self.placed.join(blocks, ["sid", "block"], "left").join(inside, ["sid", "block", "k1", "k2", "size"], "left")


def _share(p: int) -> Column:
    """A row's words that pass p takes."""
    cut, before, size = F.col(f"cut{p}"), F.col(f"before{p}"), F.col("size")
    part = F.least(size, F.greatest(F.lit(0).cast("long"), F.floor((cut - before) / F.col("m")).cast("long")))
    return F.when(cut.isNull(), 0).when(cut == F.col("block_words"), size).otherwise(part).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    Sizes are words of whole texts, whatever their length; a null text has none. A null source is one of its own, the last. Ids
    may be null; rows equal in id and text are one block's and share its words evenly, rounded down. A source gives its target, rounded, but
    for what that rounding loses. An empty table, or one without words, gives its rows with targets of 0.
    """
    return Mix(docs, weights, share, seed).taken()
