"""The pipeline against a brute-force version of its stages, and the queries against their SQL."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from hydroframe.llm.queries import ORACLE, QUERIES
from hydroframe.llm.settings import TOKENIZER
from tests.conftest import SF_SMALL
from tests.llm import fixtures as fx


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, name):
    from tools.compare import compare

    said = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert said.startswith("OK"), said


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        assert name == "token_files" or docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in seen[name]]
    first = [(r["doc_id"], r["text"]) for r in seen["quality_rules"]]
    assert all(not fx.quality_counts(t)[-1] for _, t in first)
    assert sorted(ids("ngram_jaccard")) == sorted({c for _, _, c in fx.components(first)})
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    second = [(r["doc_id"], r["text"]) for r in seen["ngram_jaccard"]]
    assert sorted(ids("benchmark_decontamination")) == sorted(r[0] for r in fx.contamination(second, items) if not r[-1])
    assert set(ids("source_mixture")) <= set(ids("benchmark_decontamination"))
    tokenizer, at = Tokenizer.from_file(TOKENIZER), 0
    got = sorted(seen["token_files"], key=lambda r: r["start"])
    text = {r["doc_id"]: r["text"] for r in seen["source_mixture"]}
    assert [r["doc_id"] for r in got] == ids("source_mixture")  # the mixture's order is the files'
    for r in got:
        x = np.array(tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), crc32(x.tobytes()))
        at += len(x)


def test_stages_take_anything(spark):
    docs = fx.odd_documents(spark)
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF_SMALL)
            rows = out.collect()
            assert name == "token_files" or out.columns == d.columns
            assert not rows or d is docs
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.source_mixture(spark, docs, SF_SMALL).collect())
    assert set(mixed) <= {r["doc_id"] for r in docs.collect()}
