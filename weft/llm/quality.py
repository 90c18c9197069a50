"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over common words are held against references of its
language by Jensen-Shannon distance. References are means over all documents long enough and sound by the base rules, where
there are enough of them; common words are a fixed list for each language. Short documents are guarded: below a minimum
length a histogram says nothing and is not judged, and neither are documents of a language without a reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WHITE, blocks
from weft.session import saved

# Frequent function words of each language.
COMMON = {
    "de": "der die das und in zu den von mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum haben nur oder aber vor zur bis mehr durch man sein wurde",
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no out up into",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont aux avec cette ces été même son sa ses être fait nous vous je tout elle on sans entre aussi",
}
LANGUAGES = tuple(COMMON)
#: Classes of characters: lower and upper case, other letters, digits, blanks, line breaks, stops, other ASCII signs, the rest.
N_CLASSES = 9
N_WORDS = 1 + max(len(set(x.split())) for x in COMMON.values())
SYMBOLS = b"#*$%&|<>"
MIN_CHARS, MIN_WORDS = 200, 50
#: Documents behind a reference.
MIN_DOCS = 20
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.24
#: Few words stray further from a reference by chance: this over the square root of their number is added to the limit.
SLACK = 0.8

_RANKS = {lang: {w.encode(): i for i, w in enumerate(dict.fromkeys(words.split()))} for lang, words in COMMON.items()}
_KIND = np.full(256, 7, dtype=np.int64)
for _c in range(256):
    if 97 <= _c <= 122:
        _KIND[_c] = 0
    elif 65 <= _c <= 90:
        _KIND[_c] = 1
    elif 48 <= _c <= 57:
        _KIND[_c] = 3
    elif _c in b" \t":
        _KIND[_c] = 4
    elif _c in b"\n\r\x0b\x0c":
        _KIND[_c] = 5
    elif _c in b".,;:!?'\"-":
        _KIND[_c] = 6


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    counts = np.bincount(_KIND[points[points < 128]], minlength=N_CLASSES)
    wide = points[points >= 128]
    letters = int(((wide >= 0xC0) & (wide != 0xD7) & (wide != 0xF7) & ((wide < 0x2000) | (wide >= 0x3040)) & (wide < 0xE000)).sum())
    counts[2] += letters
    counts[8] += len(wide) - letters
    return counts


def word_histogram(words: list[bytes], lang: str) -> np.ndarray:
    """Counts of the language's common words, and in the last place of all others."""
    counts = np.zeros(N_WORDS, dtype=np.int64)
    ranks = _RANKS[lang]
    for w in words:
        counts[ranks.get(w, -1)] += 1
    return counts


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance to base 2: 0 for equal, 1 for disjoint histograms."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, parts / 2)))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
        n = len(ids)
        if n < 1 << 21:
            codes = (a[:-2] * n + a[1:-1]) * n + a[2:]
        else:
            pairs = np.unique(a[:-1] * n + a[1:], return_inverse=True)[1]
            codes = pairs[:-1] * n + a[2:]
        order = np.argsort(codes, kind="stable")
        same = codes[order][1:] == codes[order][:-1]
        twice = np.zeros(len(codes), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(a), dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(codes)] |= twice
        repeat = int(covered.sum())
    return chars, symbols, dup, repeat


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        out = []
        for text, lang in zip(block.column("text").to_pylist(), block.column("lang").to_pylist()):
            text = text or ""
            words = text.encode().split()
            lower = [w.strip(b".,;:!?'\"-").lower() for w in words]
            kinds = char_histogram(text)
            # The language is the stated one, or without any the one whose common words cover most of the text.
            hists = {x: word_histogram(lower, x) for x in LANGUAGES if lang in (x, None)} or {None: np.zeros(N_WORDS, dtype=np.int64)}
            best = min(hists, key=lambda x: (hists[x][-1], x))
            out.append((len(words), *base_counts(text, words), best, int(kinds.sum()), kinds.tolist(), hists[best].tolist()))
        columns = list(zip(*out))
        kinds = (pa.int64(),) * 5 + (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "language", "n_chars", "chars", "words"]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])


MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, language string, "
    "n_chars long, chars array<bigint>, words array<bigint>"
)


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(measured: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language with `min_docs` documents that are long enough and don't fail the base rules, the mean of their shares of
    each class and common word.

    A row for each of four languages comes to the driver, whatever the input.
    """
    share = lambda c, n: [F.sum(F.element_at(c, i + 1) / n).alias(f"{c}{i}") for i in range(N_CLASSES if c == "chars" else N_WORDS)]
    long = measured.where((F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words) & ~_base_failed() & F.col("language").isNotNull())
    sums = long.groupBy("language").agg(F.count("*").alias("n"), *share("chars", F.col("n_chars")), *share("words", F.col("n_words"))).where(F.col("n") >= min_docs).collect()
    return {r["language"]: (np.array(r[2 : 2 + N_CLASSES]), np.array(r[2 + N_CLASSES :])) for r in sums}


def quality(
    docs: DataFrame,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    slack: float = SLACK,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance,
    word_distance.

    base_failed: under 50 words, or more than half of them in 3-word windows that occur twice. kept is false then;
    otherwise both distances to the references of the document's language must be within their limits (that for words
    grows by slack / sqrt(n_words)). A histogram of
    fewer than `min_chars` characters or `min_words` words is not judged (its distance is null), nor is any of a language that
    is not one of the four, or that has fewer than `min_docs` documents fit for a reference. A null language
    is replaced by that whose common words cover most of the text (of equal ones the first by name). Null texts have no words; texts of any length are
    read whole. Each row, repeated ones and null ids too, gives a row; an empty table gives an empty one; further columns are ignored.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    measured = saved(docs.mapInArrow(_measure, MEASURES))
    known = references(measured, min_chars, min_words, min_docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far: tuple[list, list] = ([], [])
            rows = zip(*(batch.column(c).to_pylist() for c in ("language", "n_chars", "n_words", "chars", "words")))
            for language, n_chars, n_words, *hists in rows:
                for k, enough in enumerate((n_chars >= min_chars, n_words >= min_words)):
                    far[k].append(distance(np.array(hists[k]), known[language][k]) if enough and language in known else None)
            out = [*(batch.column(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
            out += [pa.array(x, pa.float64()) for x in far]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:6], "char_distance", "word_distance"])

    judged = measured.mapInArrow(judge, MEASURES.split(", language")[0] + ", char_distance double, word_distance double")
    failed = _base_failed()
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance + slack / F.sqrt(F.greatest("n_words", F.lit(1))))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(*names, failed.alias("base_failed"), (~failed & fits).alias("kept"), "char_distance", "word_distance")
