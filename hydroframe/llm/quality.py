"""Quality rules: length and repetition rules, then the distance of a text's histograms to its language's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import WORD, small, text_of, words_of, written

MIN_WORDS = 50
#: A word is common in a language if it makes up this share of its words: at most 1 / 0.004 = 250 words.
COMMON_SHARE = 0.004
#: A language needs so many words in the corpus before its histograms are held against a text.
MIN_REFERENCE_WORDS = 5_000
#: Jensen-Shannon distances (base 2, in [0, 1]) above which a text is rejected.
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.40

#: Character classes of the characters in words; what is in none of them is the last class, "other".
CLASSES = {"upper": r"\p{Lu}", "lower": r"\p{Ll}", "digit": "0-9", "stop": r".,;:?'"}
SYMBOLS = r"#*$%&|<>"


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _class_counts(rest: Column, plain: Column) -> Column:
    """Counts of the classes and of the other characters in ``rest`` and ``plain`` lower-case letters beside it."""
    found = [_count(rest, c) + (plain if k == "lower" else F.lit(0)) for k, c in CLASSES.items()]
    return F.array(*found, F.length(rest).cast("long") + plain - reduce(lambda a, b: a + b, found))


def references(docs: DataFrame) -> DataFrame:
    """Per language (null: "") with enough words: the counts of the character classes (``ref_chars``), the common
    words, sorted (``common``), and their counts with the rest's at the end (``ref_words``).

    All rows count. Words are counted before they are shuffled, so a language with most of the rows is no hot key;
    the result has a row for each language with ``MIN_REFERENCE_WORDS`` words or more.
    """
    words = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words_of(text_of())).alias("word"))
    counted = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    rest = F.regexp_replace("word", "[a-z]+", "")
    classes = _class_counts(rest, F.length("word") - F.length(rest))
    sums = [F.sum(F.get("chars", F.lit(i)) * F.col("n")) for i in range(len(CLASSES) + 1)]
    totals = counted.select("lang", "n", classes.alias("chars")).groupBy("lang").agg(F.sum("n").alias("total"), F.array(*sums).alias("ref_chars"))
    totals = written(totals.where(F.col("total") >= MIN_REFERENCE_WORDS), "languages")
    common = counted.join(small(totals.select("lang", "total")), "lang").where(F.col("n") >= COMMON_SHARE * F.col("total"))
    common = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("top"))
    have = totals.join(common, "lang", "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<word:string,n:bigint>>")))
    rest = F.aggregate(F.col("top.n"), F.col("total"), lambda a, x: a - x)
    return have.select("lang", "ref_chars", F.col("top.word").alias("common"), F.concat(F.col("top.n"), F.array(rest)).alias("ref_words"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares of one length."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    """Null if there is nothing to share: ANSI division by a total of 0 is an error."""
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def judged(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` columns of each row of ``docs`` (it has ``text`` and ``lang``), the rules' counts, the two distances
    (null: no reference) and ``kept``.

    Counts, distances and verdict are made within the row: one pass, and the only join is with the references, a row
    for each language. Repeated 3-word windows are found by sorting the hashes of a text's windows with their places,
    and common words' counts from their first and last places in the sorted list: n log n for n words. Null or empty
    texts have no words and fail the base rule; repeated rows get a verdict each; an empty table gives an empty
    result; a text in a language without reference is judged by the base rules alone.
    """
    ref = small(written(references(docs), "references")).withColumnRenamed("lang", "_lang")
    text, n = F.col("_text"), F.size("_words")
    d = docs.select(F.struct(*keep).alias("_row"), text_of().alias("_text"), F.coalesce("lang", F.lit("")).alias("_key"))
    d = d.join(ref, F.col("_key") == F.col("_lang"), "left")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = d.withColumn("_words", words_of(text)).withColumn("_lines", lines).withColumn("_rest", F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""))
    window = lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
    chars = F.length(F.array_join("_words", "")).cast("long")
    d = d.select(
        "_row", "ref_chars", "ref_words", "common", n.cast("long").alias("n_words"),
        chars.alias("word_chars"), _count(F.col("_rest"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.slice("_words", 1, n - 2), window)).alias("_windows"),
        F.when(n >= MIN_WORDS, _class_counts(F.col("_rest"), chars - F.length("_rest"))).alias("_chars"),
        F.when(n >= MIN_WORDS, F.sort_array(F.filter("_words", lambda w: F.array_contains("common", w)))).alias("_hits"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    alike = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    again = F.filter("_sorted", lambda x, i: alike(x, i - 1) | alike(x, i + 1))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    first = lambda w: F.array_position("_hits", w)
    times = lambda w: F.when(first(w) > 0, F.size("_hits") - F.array_position("_back", w) + 2 - first(w)).otherwise(F.lit(0))
    d = d.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")).withColumn("_back", F.reverse("_hits"))
    d = d.withColumn("_counts", F.concat(F.transform("common", lambda w: times(w).cast("long")), F.array(F.col("n_words") - F.size("_hits"))))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    d = d.withColumn("base_failed", (n < MIN_WORDS) | (100 * rep > 50 * n))
    d = d.withColumn("char_distance", js_distance(_shares("_chars", F.col("word_chars")), _shares("ref_chars", total("ref_chars"))))
    d = d.withColumn("word_distance", js_distance(_shares("_counts", n), _shares("ref_words", total("ref_words"))))
    far = (F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)
    d = d.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return d.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    d = judged(docs, [F.col("*")]).select("_row", "kept", F.monotonically_increasing_id().alias("_at"))
    # the row number keeps the filter above the projections: pushed below, it would repeat their expressions
    return d.where(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")
