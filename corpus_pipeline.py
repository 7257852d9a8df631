"""The corpus pipeline: from ``documents`` to token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; every stage but the last returns the
columns of ``docs``. Between stages rows are written as Parquet and read again, so a lost executor costs its own tasks alone.
Null texts count as empty (the quality rules reject them), repeated rows are copies of each other, extra columns
pass through, and empty tables give empty results; the operators say more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm import decontamination, mixing, near, quality, tokens
from hydroframe.llm.common import scratch, table, written
from hydroframe.llm.settings import MIX_SEED, TOKENIZER, WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot say the tokenizer of the last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go."""
    return quality.clean_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays."""
    return near.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a span of ten words, or a whole short item, with the benchmark go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mixture says, in its order: files in order of their names, rows as they stand."""
    return mixing.mix(docs, WEIGHTS, seed=MIX_SEED).select([F.col(f"`{c}`") for c in docs.columns])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture, which is that of the files that hold ``docs`` (rows that stand in no
    files go by ``doc_id``); what is returned is read back from them."""
    order = [F.col("_file"), F.col("_place")]
    try:
        docs = tokens.file_order(docs)
    except AnalysisException:  # no file metadata: docs was not read from files
        order = None
    return tokens.read_digests(spark, tokens.write_tokens(docs, scratch(spark, "tokens"), TOKENIZER, order))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
