"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of common words are compared with the histograms of its language, which
are summed over all documents, by Jensen-Shannon distance. Texts under a minimum length are not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.shared import Stash

_SPACE = r"\x20\x09-\x0D"

#: Common words by language (fixed values, by rough frequency).
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "ein"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"],
}
#: Used for all other languages, whose reference is their common histogram.
OTHER = "other"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least sizes for the comparisons, and the distances up to which a text is kept.
CLASS_MIN_CHARS, CLASS_MAX_DISTANCE = 200, 0.2
WORD_MIN_WORDS, WORD_MAX_DISTANCE = 100, 0.275
CLASSES = ("lower", "upper", "digit", "space", "punct", "wide")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang (one of the known ones or OTHER), the base figures, and both histograms as arrays.

    A null text is empty. Words are maximal runs outside space and \\t..\\r; a word is in a repeated window if the
    three-word window that holds it is found twice or more in the text.
    """
    lists = F.create_map(*[x for k, v in {**COMMON_WORDS, OTHER: COMMON_WORDS["en"]}.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    lang = F.col("lang").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(lang.isin(*COMMON_WORDS), lang).otherwise(OTHER).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("words", F.array_remove(F.split("text", f"[{_SPACE}]+"), ""))
    hashed = base.withColumn(
        "windows",
        F.when(
            F.size("words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    ).withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    again = hashed.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter("sorted", lambda x, j: (F.get("sorted", j - 1)["h"] == x["h"]) | (F.get("sorted", j + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{_SPACE}]")))
    counted = again.withColumn("lines", lines).withColumn(
        "common", F.filter(F.transform("words", F.lower), lambda w: w.isin(*every))
    )
    figures = counted.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", f"[{_SPACE}]+", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), "[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") == 0, F.lit(0)).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.size("at")), F.lit(3), lambda n, j: n + F.when(j < F.size("at"), F.least(F.lit(3), F.get("at", j) - F.get("at", j - 1))).otherwise(0))
        ).cast("long").alias("n_repeat_words"),
        F.char_length("text").cast("long").alias("n_chars"),
        _count(F.col("text"), "[A-Z]").alias("upper"),
        _count(F.col("text"), "[0-9]").alias("digit"),
        _count(F.col("text"), r"[!-/:-@\[-`{-~]").alias("punct"),
        _count(F.col("text"), r"[^\x00-\x7F]").alias("wide"),
        F.transform(F.element_at(lists, F.col("lang")), lambda r: F.size(F.filter("common", lambda w: w == r)).cast("long")).alias("hits"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    lower = F.col("n_chars") - F.col("upper") - F.col("digit") - space - F.col("punct") - F.col("wide")
    other = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x)
    return figures.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
        F.array(lower, F.col("upper"), F.col("digit"), space, F.col("punct"), F.col("wide")).alias("classes"),
        F.concat("hits", F.array(other)).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of two histograms of counts; 0 where one of them is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda n, x: n + x.cast("double"))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    sums = F.struct(total(p).alias("p"), total(q).alias("q"))

    def divergence(s: Column) -> Column:
        each = F.zip_with(p, q, lambda a, b: F.struct((a / s["p"]).alias("a"), (b / s["q"]).alias("b")))
        whole = F.aggregate(each, F.lit(0.0), lambda n, x: n + part(x["a"], (x["a"] + x["b"]) / 2) / 2 + part(x["b"], (x["a"] + x["b"]) / 2) / 2)
        return F.when((s["p"] > 0) & (s["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), whole))).otherwise(0.0)

    return F.get(F.transform(F.array(sums), divergence), 0)


def judged(docs: DataFrame, class_max: float = CLASS_MAX_DISTANCE, word_max: float = WORD_MAX_DISTANCE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance) for every row of ``docs(doc_id, text, lang)``.

    Texts of fewer than MIN_WORDS words, or with more than MAX_REPEAT_PERCENT of their words in repeated windows, fail.
    The others are kept unless a histogram is too far from that of their language. Every row counts in the histograms
    of languages, repeated rows each time; unknown and null languages share one reference. Other columns are ignored.
    """
    stash = Stash(docs.sparkSession)
    rows = stash.keep(measured(docs), "measured")
    sums = lambda name, n: F.array(*[F.sum(F.get(name, i)) for i in range(n)]).alias(f"all_{name}")
    # at most one row for each known language and one for the rest
    reference = rows.groupBy("lang").agg(sums("classes", len(CLASSES)), sums("common", len(COMMON_WORDS["en"]) + 1))
    far = rows.join(F.broadcast(reference), "lang").withColumns(
        {"class_distance": js_distance(F.col("classes"), F.col("all_classes")), "word_distance": js_distance(F.col("common"), F.col("all_common"))}
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    odd = ((F.col("n_chars") >= CLASS_MIN_CHARS) & (F.col("class_distance") > class_max)) | (
        (F.col("n_words") >= WORD_MIN_WORDS) & (F.col("word_distance") > word_max)
    )
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "class_distance", "word_distance",
    )
