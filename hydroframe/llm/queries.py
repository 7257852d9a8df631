"""Registered queries of the operators; each reads its whole table. ``ORACLE`` has SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm import chat, decontamination, lm, mixing, near, packing, periodic, pii, quality, secrets, tokens, urls, whitening
from hydroframe.llm.common import scratch, table, text_of, words_of
from hydroframe.llm.oracle import ORACLE as ORACLE
from hydroframe.llm.settings import MARKED, MIX_SEED, TOKENIZER, URL_RULES, WEIGHTS


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, seed=MIX_SEED)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), TOKENIZER)
    return tokens.read_digests(spark, path)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judged(table(spark, sf_dir, "documents"), [F.col("doc_id")])
    return d.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents"))


def op9_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    marked = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], c.schema)
    return chat.digests(chat.examples(c.unionByName(marked)))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs are labelled bad by the labels of their id: low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judged(pages, URL_RULES, pages.join(bad, "page_id").select("url", "bad"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packing.write_sequences(table(spark, sf_dir, "documents"), scratch(spark, "sequences"), TOKENIZER)
    return packing.read_places(spark, path)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by crc32 of the id, repeat a stretch of their own words to the end.

    The array of words is bound by an outer ``transform``, so that it is made once a text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))

    text = F.array_join(F.get(F.transform(F.array(words_of(text_of())), repeated), 0), " ")
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic.periodic_runs(_made_periodic(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.shorter")
    milli = F.floor(1000 * length / period).cast("long")
    return d.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixture": op1_source_mixture,
    "op2_secrets": op2_secrets,
    "op3_pii": op3_pii,
    "op4_token_files": op4_token_files,
    "op5_lm_scores": op5_lm_scores,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_chat_examples": op9_chat_examples,
    "op10_url_verdicts": op10_url_verdicts,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_packed_sequences": op12_packed_sequences,
    "op13_periodic_runs": op13_periodic_runs,
}
