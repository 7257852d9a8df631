"""Benchmark decontamination by winnowing: documents and items meet by the minimum k-gram hash of each sliding window
and hits are extended to all shared spans of ``SPAN`` words or more.

A span of ``SPAN`` words has ``SPAN - K + 1`` k-grams, one window's worth. Both sides keep each window's minimum, so they
keep the same hash of every shared span: none is missed. Items shorter than ``SPAN`` are looked up as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import small, text_of, written

SPAN, K = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """ASCII letters and digits and all that is not ASCII make words; case is as it was."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), "")


def _grams(hashes: Column, size: int) -> Column:
    """Hash of each run of ``size`` words; ``hashes`` is a column by name, as each run reads it ``size`` times."""
    some = F.size(hashes) - size + 1
    run = F.transform(F.slice(hashes, 1, F.greatest(some, F.lit(0))), lambda h, i: F.xxhash64(F.lit(size), h, *(F.get(hashes, i + j) for j in range(1, size))))
    return F.when(some > 0, run).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(words: Column) -> Column:
    """Hashes that are alike for words alike in all but the case of A-Z (and for some others: hits are compared)."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _minima(grams: Column) -> Column:
    """Distinct minima of all windows of ``SPAN - K + 1`` k-grams."""
    size = SPAN - K + 1
    windows = F.size(grams) - size + 1
    least = F.transform(F.slice(grams, 1, F.greatest(windows, F.lit(0))), lambda g, i: F.array_min(F.slice(grams, i + 1, size)))
    return F.array_distinct(F.when(windows > 0, least).otherwise(F.array().cast("array<bigint>")))


def _prints(d: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """``d`` (it has ``words``) with its fingerprints ``prints`` and ``n_words``. ``whole``: items, of which a short one is
    one gram; else all runs of the short items' lengths are fingerprints too."""
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", _word_hashes(F.col("words"))).withColumn("grams", _grams(F.col("hashes"), K))
    found = _minima(F.col("grams"))
    for m in lengths:
        runs = _grams(F.col("hashes"), m)
        found = F.concat(found, F.when(F.col("n_words") == m, runs).otherwise(F.array().cast("array<bigint>")) if whole else F.array_distinct(runs))
    return d.withColumn("prints", found).drop("hashes", "grams")


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct fingerprints of all items, their windows (``window``, ``item``) and the lengths of the short ones."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(item.alias("item"), raw_words(text_of()).alias("words")).where(F.size("words") > 0)
    short = items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # SPAN - 1 at most
    items = items.repartition(benchmark.sparkSession.sparkContext.defaultParallelism)
    prints = _exploded(_prints(items, lengths, whole=True), F.col("prints"), "print").select("print").distinct()
    n = F.size("words")
    d = items.select("item", _lowered(F.col("words")).alias("words"))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - SPAN + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, SPAN), " "))
    return written(prints, "prints"), written(_exploded(d, windows, "window").select("window", "item").distinct(), "windows"), lengths


def _exploded(d: DataFrame, array: Column, name: str) -> DataFrame:
    """A row for each element of a computed array, in the column ``name``.

    ``explode`` would have Spark infer a filter on the array and push it below the projections that compute it, once for
    each level of nesting: the work grew with the cube of a text's words. ``explode_outer`` infers none.
    """
    return d.select("*", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def _lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, _UPPER, _LOWER))


def _near(grams: Column, size: int, gram: int) -> Column:
    """The windows of ``size`` words (``start``, ``size``) that hold a k-gram of ``gram`` words with a hash in ``met``."""
    at = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains("met", g), i)), lambda i: i.isNotNull())

    def around(p: Column) -> Column:
        first, last = F.greatest(p - (size - gram), F.lit(0)), F.least(p, F.size("words") - size)
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(at, around)))
    return F.transform(starts, lambda p: F.struct(p.alias("start"), F.lit(size).alias("size")))


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: each row's ``doc_id``, text hash ``h`` and ``n_words``; and of the rows with hits, by ``doc_id``
    and ``h``, the places of the hit words ``places`` and the ``items``.

    Texts are read twice: all for their fingerprints, and those that share one with an item again to compare windows word by word.
    Only fingerprints and windows meet in joins; a side is broadcast if it is counted and small.
    """
    prints, windows, lengths = _items(benchmark)
    key = [F.col("doc_id"), text_of().alias("text")]
    d = docs.select(*key).select("doc_id", "text", F.xxhash64("text").alias("h"))
    base = _prints(d.select("doc_id", "h", raw_words(F.col("text")).alias("words")), lengths, whole=False)
    base = written(base.select("doc_id", "h", "n_words", "prints"), "base")
    met = _exploded(base, F.col("prints"), "print").select("doc_id", "h", "print").join(small(prints), "print")
    met = written(met.groupBy("doc_id", "h").agg(F.collect_set("print").alias("met")), "met").withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    c = d.join(small(met), F.col("h").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))).dropDuplicates(["doc_id", "h"])
    c = c.select("doc_id", "h", "met", raw_words(F.col("text")).alias("words"))
    c = c.withColumn("hashes", _word_hashes(F.col("words"))).withColumn("lower", _lowered(F.col("words")))
    found = F.array().cast("array<struct<start:int,size:int>>")
    for size, gram in [(SPAN, K), *((m, m) for m in lengths)]:
        c = c.withColumn(f"g{size}", _grams(F.col("hashes"), gram))
        found = F.concat(found, _near(F.col(f"g{size}"), size, gram))
    c = _exploded(c.select("doc_id", "h", "lower", found.alias("found")), F.col("found"), "w")
    c = c.select("doc_id", "h", "w", F.array_join(F.slice("lower", F.col("w.start") + 1, F.col("w.size")), " ").alias("window"))
    c = c.join(small(windows), "window").groupBy("doc_id", "h").agg(F.collect_set("w").alias("ws"), F.sort_array(F.collect_set("item")).alias("items"))
    places = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.sequence(w["start"], w["start"] + w["size"] - 1))))
    return base.select("doc_id", "h", "n_words"), written(c.select("doc_id", "h", places.alias("places"), "items"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words in a shared window), ``n_items``, ``items_sha256`` and
    ``contaminated``.

    Null texts have no words; items without words have no windows; a null item id counts as ``""``; rows alike in id
    and text get the same result each; empty tables give no hits or an empty result.
    """
    base, found = hits(docs, benchmark)
    found = small(found).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.size("places").cast("long").alias("n"), "items")
    d = base.join(found, F.col("h").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n", F.lit(0).cast("long"))
    sha = F.sha2(F.array_join(items, ",").cast("binary"), 256)
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), sha.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they were."""
    found = small(hits(docs, benchmark)[1].select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")))
    d = docs.select(F.struct("*").alias("_row")).withColumn("_t", F.xxhash64(text_of("_row.text")))
    return d.join(found, F.col("_t").eqNullSafe(F.col("_h")) & F.col("_row.doc_id").eqNullSafe(F.col("_d")), "left_anti").select("_row.*")
