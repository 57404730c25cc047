"""Quality rules: base counts, and the divergence of a text's histograms from language references.

A text's histogram of character classes and its histogram of common words are compared with the
reference of each language by Jensen-Shannon distance (the root of the divergence in bits, 0 to
1). Its language is the reference with the nearest word histogram; the text is rejected if that
distance or the distance of its character classes to the same reference is above a threshold.
Texts below a minimum length are not judged by a histogram, for a few words tell little. Nor are
texts whose label has no reference (another language, or no label): the distance to the references
of other languages says nothing of their quality, and the base rule alone decides.

References are sums over all documents that carry the language's label: one row of counts for
each language of ``COMMON_WORDS``, which bounds what the driver gets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas.llm.tables import fresh, row_struct, stored

# Frequent function words of each language.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "on"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del"),
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the verdict; distances are Jensen-Shannon distances."""

    min_words: int = 20  # base rule
    repeat_percent: int = 30  # base rule
    window: int = 8
    class_min_chars: int = 450
    class_distance: float = 0.19
    word_min_words: int = 60
    word_distance: float = 0.28


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns behind a generator of one row.

    The optimizer copies no expression across a generator, so a costly value that several later
    expressions use is computed once.
    """
    row = fresh(df, "__row")
    out = df.select("*", F.explode(F.array(F.struct(
        *[v.alias(k) for k, v in values.items()]))).alias(row))
    return out.select(*df.columns, *[F.col(f"{row}.{k}").alias(k) for k in values])


def with_histograms(
    docs: DataFrame, text_col: str, prefix: str, common: Mapping[str, Sequence[str]] = COMMON_WORDS,
) -> DataFrame:
    """Adds ``<prefix>text, _words`` (array), ``_classes`` and ``_common`` (arrays of counts).

    ``classes`` counts code points in the order of ``CLASSES``, ``common`` the occurrences of
    each listed word in the order of ``listed``. No shuffle.
    """
    p = prefix
    df = computed(docs, **{f"{p}text": F.coalesce(F.col(text_col), F.lit(""))})
    # Split at every whitespace character: one part more than there are such characters.
    # The rest without lower-case letters and spaces is short.
    df = computed(df, **{
        f"{p}parts": F.split(f"{p}text", r"[\x20\x09-\x0D]"),
        f"{p}rest": _removed(F.col(f"{p}text"), r"[\p{Ll}\x20]+")})
    df = computed(df, **{
        f"{p}words": F.array_remove(f"{p}parts", ""),
        f"{p}space": F.size(f"{p}parts") - 1}).drop(f"{p}parts")
    both = [*listed(common), *(w.capitalize() for w in listed(common))]
    df = computed(df, **{
        f"{p}found": F.transform(F.filter(f"{p}words", lambda w: w.isin(both)), F.lower),
        f"{p}upper": F.length(f"{p}rest") - F.length(_removed(F.col(f"{p}rest"), r"\p{Lu}+")),
        f"{p}digits": F.length(f"{p}rest") - F.length(_removed(F.col(f"{p}rest"), r"[0-9]+")),
        f"{p}symbols": F.length(f"{p}rest") - F.length(_removed(F.col(f"{p}rest"), r"[#*$%&|<>]+")),
        f"{p}others": F.length(_removed(
            F.col(f"{p}rest"), r"[\p{Lu}0-9\x09-\x0D#*$%&|<>]+"))})
    space, upper, digits, symbols, others = (
        F.col(f"{p}{c}") for c in ("space", "upper", "digits", "symbols", "others"))
    lower = F.length(f"{p}text") - space - upper - digits - symbols - others
    return computed(df, **{
        f"{p}classes": F.array(lower, upper, digits, space, symbols, others),
        f"{p}common": F.transform(
            F.array(*[F.lit(w) for w in listed(common)]),
            lambda w: F.size(f"{p}found") - F.size(F.array_remove(f"{p}found", w)))})


def listed(common: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({w for ws in common.values() for w in ws})


def references(
    measured: DataFrame, common: Mapping[str, Sequence[str]] = COMMON_WORDS,
) -> dict[str, tuple[list[float], list[float]]]:
    """Language -> shares of the character classes; shares of its common words and the rest.

    ``measured`` has ``lang, n, chars, classes, common`` of every document; those whose label has
    a word list count, if they have words. Words: sums over the documents. Classes: the median
    document's share of each class in thousandths, for junk has shares far off that a mean would
    follow; scaled to a sum of 1. The driver gets one row of sums for each language, and at most
    1,001 counts for each language and class. A language without words has no reference.
    """
    words = listed(common)
    rows = measured.filter(F.col("lang").isin(list(common)) & (F.col("n") > 0))
    sums = rows.groupBy("lang").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.get("common", F.lit(i)).cast("long")) for i in range(len(words))]).alias("common"))
    thousandths = rows.select(
        "lang", F.posexplode(F.transform(
            "classes", lambda c: F.floor(c * 1000 / F.col("chars") + 0.5))).alias("class", "share"))
    shares: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in thousandths.groupBy("lang", "class", "share").count().orderBy("share").collect():
        shares.setdefault((r["lang"], r["class"]), []).append((r["share"], r["count"]))
    out = {}
    for r in sorted(sums.collect(), key=lambda r: r["lang"]):
        counts = dict(zip(words, r["common"], strict=True))
        known = [counts[w] / r["n"] for w in common[r["lang"]]]
        middle = [_lower_median(shares[r["lang"], i]) for i in range(len(CLASSES))]
        out[r["lang"]] = (
            [m / sum(middle) for m in middle],
            [*known, (r["n"] - sum(counts[w] for w in common[r["lang"]])) / r["n"]])
    return out


def _lower_median(counts: Sequence[tuple[int, int]]) -> int:
    """Of values with their numbers, in order of value."""
    rank, seen = (sum(n for _, n in counts) + 1) // 2, 0
    for value, n in counts:
        seen += n
        if seen >= rank:
            return value
    raise ValueError("no values")


def jensen_shannon(p: Column, q: Sequence[float]) -> Column:
    """The Jensen-Shannon distance of an array of shares ``p`` to fixed shares ``q``, in [0, 1]."""
    def term(a, b):
        half = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / half)).otherwise(0.0) + F.when(
            b > 0, b * F.log2(b / half)).otherwise(0.0)

    fixed = F.array(*[F.lit(float(x)) for x in q])
    total = F.aggregate(F.zip_with(p, fixed, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def repeated_words(docs: DataFrame, words: str, window: int, into: str) -> DataFrame:
    """Adds the count of words that lie in a window found twice or more in the same text.

    A repeated window of w words (a multiple of 4) repeats w - 3 runs of four words. A text in
    which fewer runs of four recur has none and stops there; else its windows are hashed and
    sorted inside the row, and the count is the union of those with an equal neighbour in that
    order. Word runs are compared by 64-bit hashes.
    """
    if window < 4 or window % 4:
        raise ValueError("the window must be a multiple of 4 words")
    fours, wide, pairs, starts = (fresh(docs, f"__{into}_{x}") for x in ("4", "w", "p", "s"))

    def joined(runs: str | Column, size: int, step: int, hash_of) -> Column:
        """Hashes of runs that begin ``step`` apart; only pairs with both parts."""
        n = F.greatest(F.size(runs) - step, F.lit(0))
        return F.slice(F.zip_with(runs, F.slice(runs, step + 1, n), hash_of), F.lit(1), n)

    def both(a, b):
        return F.xxhash64(a, b)

    twos = fresh(docs, f"__{into}_2")
    df = computed(docs, **{twos: joined(words, 2, 1, both)})
    df = computed(df, **{fours: joined(F.col(twos), 4, 2, both)}).drop(twos)
    nothing = F.array().cast("array<bigint>")
    eights = F.array(F.col(fours))
    for _ in range(window // 4 - 1):
        # The run lengthened by the four words after it, with the runs of four as second part.
        eights = F.transform(eights, lambda runs: _longer(runs, F.col(fours)))
    df = computed(df, **{wide: F.when(
        F.size(fours) - F.size(F.array_distinct(fours)) >= window - 3, F.get(eights, F.lit(0)),
    ).otherwise(nothing)}).drop(fours)
    df = computed(df, **{pairs: F.when(
        F.size(F.array_distinct(wide)) < F.size(wide),
        F.array_sort(F.transform(wide, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))}).drop(wide)

    def neighbour(i, step):
        return F.get(pairs, i + step)["h"]

    df = computed(df, **{starts: F.array_sort(F.filter(
        F.transform(pairs, lambda x, i: F.when(
            neighbour(i, -1).eqNullSafe(x["h"]) | neighbour(i, 1).eqNullSafe(x["h"]), x["i"])),
        lambda i: i.isNotNull()))}).drop(pairs)
    cover = F.aggregate(
        F.transform(starts, lambda s, j: F.least(
            F.lit(window), F.coalesce(F.get(starts, j + 1) - s, F.lit(window)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return computed(df, **{into: cover}).drop(starts)


def _longer(runs: Column, fours: Column) -> Column:
    """Hashes of each run with the four words that follow it."""
    done = F.size(fours) - F.size(runs) + 4
    n = F.greatest(F.size(runs) - 4, F.lit(0))
    return F.slice(
        F.zip_with(runs, F.slice(fours, done + 1, n), lambda a, b: F.xxhash64(a, b)), F.lit(1), n)


def measure(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(),
    common: Mapping[str, Sequence[str]] = COMMON_WORDS, carry: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (struct of the carried columns) and what the rules count in each text.

    One pass over the texts without a shuffle, written to the shared folder: the references are
    sums over it, and the verdict needs nothing else.
    """
    carried = docs.columns if carry is None else list(carry)
    df = docs.select(
        row_struct(docs, carried), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("raw"))
    df = with_histograms(df, "raw", "h_", common)
    df = repeated_words(df, "h_words", limits.window, "repeats")
    df = computed(df, lines=F.filter(
        F.split("h_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return stored(df.select(
        "row", "lang", F.size("h_words").cast("long").alias("n"),
        F.length("h_text").alias("chars"), F.col("h_classes").alias("classes"),
        F.col("h_common").alias("common"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("dup_lines"),
        "repeats"), "quality-measured")


def judge(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(),
    common: Mapping[str, Sequence[str]] = COMMON_WORDS, carry: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the struct ``row`` of its carried columns, and the verdict.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``,
    ``language`` (of the nearest word reference), ``class_distance``, ``word_distance`` (all NULL
    below the minimum length or without a reference of the text's label) and ``kept``. NULL texts are
    empty and fail the base rule. A text whose label has no reference (NULL, or a language without a
    word list) is left to the base rule; any other is judged by the nearest reference. Ties between languages go to the smaller distance of classes within the
    first language by name. ``carry`` names the columns of ``row``, by default all; they keep
    their names inside the struct, so that none can clash.
    """
    df = measure(docs, text_col, lang_col, limits, common, carry)
    known = references(df, common)
    words = listed(common)
    pairs = []
    for lang, (class_shares, word_shares) in known.items():
        counts = F.array(*[F.get("common", F.lit(words.index(w))) for w in common[lang]])
        rest = F.col("n") - F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        own = F.transform(F.array_append(counts, rest.cast("int")), lambda c: c / F.col("n"))
        pairs.append(F.struct(
            jensen_shannon(own, word_shares).alias("word"), F.lit(lang).alias("lang"),
            jensen_shannon(F.transform("classes", lambda c: c / F.col("chars")), class_shares).alias("class")))
    nothing = F.lit(None).cast("struct<word:double,lang:string,class:double>")
    nearest = F.array_min(F.array(*pairs)) if pairs else nothing
    df = computed(df, near=F.when((F.col("n") > 0) & F.col("lang").isin(list(known)), nearest))
    by_class, by_word = F.col("chars") >= limits.class_min_chars, F.col("n") >= limits.word_min_words
    df = computed(
        df, class_distance=F.when(by_class, F.col("near.class")),
        word_distance=F.when(by_word, F.col("near.word")),
        base_failed=(F.col("n") < limits.min_words) | (
            100 * F.col("repeats") > limits.repeat_percent * F.col("n")))
    strange = (
        F.coalesce(F.col("class_distance") > limits.class_distance, F.lit(False))
        | F.coalesce(F.col("word_distance") > limits.word_distance, F.lit(False)))

    def in_class(name):
        return F.get("classes", F.lit(CLASSES.index(name)))

    return df.select(
        "row", F.col("n").alias("n_words"),
        (F.col("chars") - in_class("space")).cast("long").alias("word_chars"),
        in_class("symbol").cast("long").alias("n_symbols"), F.col("dup_lines").alias("n_dup_lines"),
        F.col("repeats").alias("n_repeat_words"), "base_failed",
        F.when(by_class | by_word, F.col("near.lang")).alias("language"),
        "class_distance", "word_distance", (~F.col("base_failed") & ~strange).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    found = judge(docs, text_col, lang_col).filter("kept")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
