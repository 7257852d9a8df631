"""Operators against brute-force versions, on driver tables and on inputs with all that may go wrong."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from hydroframe.llm import chat, decontamination, lm, mixing, near, pii, quality, secrets, tokens, urls
from hydroframe.llm.settings import MARKED, TOKENIZER, URL_RULES
from tests.conftest import SF_SMALL
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def odd(spark):
    return fx.odd_documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(4).cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_quality_counts(request, which):
    docs = request.getfixturevalue(which)
    got = quality.judged(docs, [docs["doc_id"]]).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert in_order(got) == in_order((i, *fx.quality_counts(t)) for i, t in pairs(docs))


def test_quality_keeps_clean_and_rejects_junk(spark, corpus):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in quality.clean_documents(corpus).select("doc_id").collect()}
    long = {i for i, t in pairs(corpus) if not fx.quality_counts(t)[-1]}
    assert {i for i in long if labels.get(i) == 1} <= kept
    assert not {i for i in labels if labels[i] == 0} & kept


def test_quality_keeps_columns(odd):
    d = quality.clean_documents(odd)
    assert d.columns == odd.columns and {r["h"] for r in d.collect()} <= {"h"}
    assert quality.clean_documents(odd.limit(0)).count() == 0


def test_quality_texts_without_words_in_languages_with_references(spark):
    long = [(i, fx.prose(3_000, i), lang) for i, lang in enumerate(["en", "en", None, None])]
    none = [(10 + i, text, lang) for i, (text, lang) in enumerate((t, x) for t in (None, "", "  ", " \n\t ") for x in ("en", None, "de"))]
    verdicts = []
    for rows in (long, long + none):
        docs = spark.createDataFrame([(*r, "src0", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
        assert {r["lang"] for r in quality.references(docs).collect()} == {"", "en"}
        got = quality.judged(docs, [docs["doc_id"]]).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert in_order(r[:-1] for r in got) == in_order((i, *fx.quality_counts(t)) for i, t, _ in rows)
        assert {r["doc_id"] for r in quality.clean_documents(docs).collect()} == {r["doc_id"] for r in got if r["kept"]}
        verdicts.append({r["doc_id"]: r["kept"] for r in got})
    assert verdicts[1] == verdicts[0] | {r[0]: False for r in none}


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_near_components(request, which):
    docs = request.getfixturevalue(which)
    got = near.near_classes(docs).collect()
    assert in_order(got) == in_order(fx.components(pairs(docs)))


def test_one_of_each(odd):
    d = near.one_of_each(odd)
    got = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert d.columns == odd.columns
    left = [r for r in got if fx.split_words(r[1])]
    assert all(fx.components([a, b])[1][2] == b[0] for i, a in enumerate(left) for b in left[:i] if a[0] != b[0])  # no two are linked
    assert {c for _, n, c in fx.components(pairs(odd)) if n} == {i for i, _ in left}
    assert len(got) - len(left) == sum(not fx.split_words(t) for _, t in pairs(odd))
    assert near.one_of_each(odd.limit(0)).count() == 0


def test_cells_meet_and_sketches_bound():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 8, 16, 31, 64, 100, 129, 300):
        for _ in range(30):
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(rng.sample(sorted(a), n - rng.randint(0, n // 5))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 5))}
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert near.distance(near.bits(x), near.bits(y)) <= len(a ^ b)
            if near.linked(x, y):
                assert len(a ^ b) <= near.bound(len(a), len(b))
                one, two = ({k: (set(keys.tolist()), room) for k, keys, room in near.cells(s)} for s in (x, y))
                assert any(len(one[k][0] & two[k][0]) > max(one[k][1], two[k][1]) >= 0 for k in one.keys() & two.keys())


def test_chains_and_frequent_cells(spark):
    """A chain of texts, each linked with the next alone, and many texts that share a frequent passage."""
    rng = random.Random(4)
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 12 : i * 12 + 110])) for i in range(20)]
    shared = " ".join(f"s{i}" for i in range(14))
    rows += [(100 + i, shared + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 6)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert in_order(near.near_classes(docs).collect()) == in_order(fx.components(rows))


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_contamination(spark, request, which):
    docs = request.getfixturevalue(which)
    items = [(1, fx.prose(30)), (2, "É"), (3, "one TWO"), (4, None), (5, ""), (None, "ΑΣ"), (6, fx.prose(12, 2)), (6, fx.prose(12, 2)), (7, "word word word")]
    items += [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    benchmark = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, words string")
    want = fx.contamination(pairs(docs), items)
    assert in_order(decontamination.contamination(docs, benchmark).collect()) == in_order(want)
    if which == "odd":
        clean = decontamination.clean_documents(docs, benchmark)
        assert clean.columns == docs.columns and clean.count() == sum(not r[-1] for r in want)
        assert not any(r["contaminated"] for r in decontamination.contamination(docs, benchmark.limit(0)).collect())


@pytest.mark.parametrize("which", ["odd", "corpus", "random"])
def test_private_data(spark, request, which):
    if which == "random":
        rng, some = random.Random(5), "0123456789" * 3 + "..--  ()++@@aZ_%é\U0001F600,"
        rows = [(i, "".join(rng.choice(some) for _ in range(rng.randint(0, 120)))) for i in range(400)]
        rows += [(900, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 " + "1" * 40_000), (901, "x@" * 9_000), (902, "+1" + " " * 20_000 + "2"), (903, "1 " * 9_000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    else:
        docs = request.getfixturevalue(which)
    got = pii.report(docs).collect()
    want = [(i, fx.private(t)) for i, t in pairs(docs)]
    assert in_order(r[:6] for r in got) == in_order((i, *(sum(s[0] == k for s in x) for k in pii.KINDS), fx.sha(fx.listed(x))) for i, x in want)
    spans = Counter(s for r in got for s in r["spans"].split(",") if s)
    assert not Counter(f"{k}:{a}:{b}" for _, x in want for k, a, b in x) - spans  # base ones stay


def test_trees_as_expression(spark):
    """The expression of the trees is the model."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [([float(rng.randint(0, 9)) for _ in pii.FEATURES],) for _ in range(400)]
    d = spark.createDataFrame([(x, int(x[2] + x[5] > 9 or x[0] == 3)) for (x,) in rows], "x array<double>, y int")
    found = d.select(F.array(F.struct(F.lit(0).alias("kind"), "y", "x")).alias("labelled"))
    model = pii.fitted(found)
    scored = model.transform(d.select("x", array_to_vector("x").alias("features"))).select(vector_to_array("probability")[1].alias("p"), pii.probability(model, F.col("x")).alias("q"))
    assert all(abs(r["p"] - r["q"]) < 1e-9 for r in scored.collect())


@pytest.mark.parametrize("which", ["odd", "corpus", "random"])
def test_secrets(spark, request, which):
    if which == "random":
        rng = random.Random(2)
        some = ["token", "TOKEN ", " = ", ":", '"', "'", "AKIA", "api_key", "apikey", "ſecret", "secret", "0123456789abcdef", "deadbeef", "ABC123", "é", " ", "\n", "-", "\U0001F600"]
        rows = [(i, "".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for i in range(500)] + [(900, "a" * 50_000 + "g " + "0" * 31)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    else:
        docs = request.getfixturevalue(which)
    got = secrets.report(docs).collect()
    want = [(i, fx.credentials(t)) for i, t in pairs(docs)]
    assert in_order(r[:5] for r in got) == in_order((i, *(sum(s[0] == k for s in x) for k in secrets.KINDS[:3]), fx.sha(fx.listed(x))) for i, x in want)
    assert not Counter(f"{k}:{a}:{b}" for _, x in want for k, a, b in x) - Counter(s for r in got for s in r["spans"].split(",") if s)


def test_formats_are_learned():
    rng = random.Random(7)
    known = ["sk-" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(400)]
    a = secrets.Automaton(known[:300])
    b = secrets.Automaton([f"{rng.randint(0, 9)}.example-{rng.randint(0, 99)}.com/page" for _ in range(300)])
    assert len(a.follow) < 60
    assert all(a.likelihood(s) > b.likelihood(s) for s in known[300:])
    assert a.likelihood("7.example-12.com/page") < min(map(a.likelihood, known)) - 1


def test_learned_spans_are_added(spark):
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'text token = "{key()}" more {rng.randint(10**15, 10**16)}.') for i in range(60)] + [(99, "see " + key()[:20] + "-" + key()[:19].upper()), (100, f"lone {key()[:31]} here")]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "format:5:36" in got[100]
    assert not any("format" in got[i] for i in range(60))


def test_addresses_without_a_host_are_not_added(spark):
    rows = [(i, f"mail user{i}.x@host{i % 9}.example.com or call +49 30 {10**6 + 7919 * i} now, from git@github and a@b in user{i}@localhost, +1 {i % 10}") for i in range(80)]
    d = spark.createDataFrame(rows + [(100, "see root@server1 or m\u00fcller@b\u00fccher.example.de")], "doc_id long, text string")
    found = pii.candidates(d, [d["doc_id"]]).cache()
    labels = Counter((r["kind"], r["y"]) for r in found.selectExpr("inline(labelled)").collect())
    assert labels[0, 1] == 80 and labels[0, 0] == 241
    spans = {r["doc_id"]: r["spans"] for r in pii.report(d).collect()}
    assert all(s.count("email") == 1 for i, s in spans.items() if i < 80) and "email:4:" not in spans[100]
    only = found.where("_row.doc_id < 80").withColumn("labelled", pii.F.filter("labelled", lambda c: (c["kind"] != 0) | (c["y"] == 1)))
    assert 0 not in pii.thresholds(only, pii.fitted(only))


def test_a_dropped_span_drops_no_other(spark):
    free = [(0, 3, 14, 0.9), (6, 2, 25, 0.8), (20, 3, 30, 0.7), (40, 3, 50, 0.6), (41, 0, 49, 0.6)]
    d = spark.createDataFrame([(free,), ([],)], "free array<struct<start:int,kind:int,end:int,score:double>>")
    got = [[tuple(s)[:3] for s in r["added"]] for r in d.select(pii._best(d["free"]).alias("added")).collect()]
    assert sorted(got) == [[], [(0, 3, 14), (20, 3, 30), (41, 0, 49)]]


def test_short_and_digitless_credentials_are_candidates(spark):
    assert [t for _, _, t in secrets.scan("a Zx9Kq2Lm and QwErTyUiOp; token=abcdefgh1 " + "f" * 40 + "-ZYXWVUTS short")[2]] == ["Zx9Kq2Lm", "QwErTyUiOp", "-ZYXWVUTS"]
    assert secrets.scan("abcdefgh" + "AKIA" + "A" * 12 + "/tail.of.it")[2] == [(0, 8, "abcdefgh"), (24, 35, "/tail.of.it")]
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
    rows = [(i, f"password = {key(12)} and something ordinary follows{i % 7} everywhere") for i in range(80)] + [(99, f"lone {key(12)} here")]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "format:5:17" and not any("format" in got[i] for i in range(80))


def test_token_files(spark, odd, corpus, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    for k, docs in enumerate((odd, corpus, odd.limit(0))):
        path = tokens.write_tokens(docs, str(tmp_path / f"t{k}"), TOKENIZER)
        got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
        crc = {r["start"]: r["ids_crc32"] for r in tokens.read_digests(spark, path).collect()}
        want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in pairs(docs))
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
        assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        assert all(crc[r["start"]] == crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)


def test_token_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        for most in (1, 2, 300, 49_408, 2**20, 2**32):
            x = rng.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
            x[2:3] = most - 1
            assert (tokens.unpack(tokens.pack(x)) == x).all()
            if n == 5000:
                assert (tokens.unpack(tokens.pack(x), range(1, 3)) == x[1024:3072]).all()


def test_words_one_by_one_are_the_text():
    rng, some = random.Random(3), "aAbBzZéÉßİ'sStd19 \n\t\x0b\x1c\x85\u00a0\u0301ΑΣ<|endoftext|>.,!#\U0001F600漢"
    e = tokens._Encoder(TOKENIZER)
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> a<|startoftext|>b  c"]
    assert e.by_word
    assert all(e.tokenizer.encode(t, add_special_tokens=False).ids == x.tolist() for t, x in zip(texts, e.encode(texts), strict=True))


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_base_scores(request, which):
    docs = request.getfixturevalue(which)
    rows = [(i, fx.split_words((t or "").translate(fx.LOWER)) + [" "], crc32(str("" if i is None else i).encode()) % 10 == 0) for i, t in pairs(docs)]
    c = Counter(w for _, ws, held in rows if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0), held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 3)) for i, ws, held in rows)
    got = lm.scores(docs).collect()
    assert sorted(((r[0] is None, r[0] or 0), *r[1:5], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_scores_of_nothing(odd):
    assert lm.scores(odd.limit(0)).collect() == []


def test_all_training_documents_are_dealt_once(spark, corpus, monkeypatch):
    dealt, deal = [], lm._dealt
    monkeypatch.setattr(lm, "WORKER_TOKENS", 5_000)
    monkeypatch.setattr(lm, "_dealt", lambda *a: dealt.append((deal(*a), a[1], a[3])) or dealt[-1][0])
    lm.learn(*lm._buckets(corpus))
    (train, outputs, rounds), = dealt
    got = Counter(np.frombuffer(r["ids"], "<u2").tobytes() for r in train.collect())
    want = Counter(outputs(lm.words(t or "")).astype("<u2").tobytes() for i, t in pairs(corpus) if crc32(("" if i is None else str(i)).encode()) % 10)
    assert got == want
    tokens = sum(n * len(x) // 2 for x, n in want.items())
    assert rounds == math.ceil((tokens / 5_000) ** lm.ROUNDS_POWER) > lm.ROUNDS
    assert {r["round"] for r in train.select("round").distinct().collect()} == set(range(rounds))


def test_vocabulary_grows_and_forms_hold_all_other_words(spark, corpus):
    rows = [(i, t) for i, t in pairs(corpus) if crc32(str(i).encode()) % 10]
    c = Counter(w for _, t in rows for w in lm.words(t or ""))
    seen = {}
    for n in (1, 4):  # the corpus, and with three times as many words again
        docs = spark.createDataFrame([(i, " ".join(f"{w}{k}" if k else w for w in (t or "").split())) for k in range(n) for i, t in rows], "doc_id long, text string")
        m, _ = lm.learn(*lm._buckets(docs))
        types = m.types
        known = len(m.outputs.known) - 1
        assert known == math.ceil(lm.VOCABULARY * math.sqrt(types)) and len(m.form_tokens) == int(lm.FORM_OUTPUTS * math.sqrt(known))
        assert m.tokens == round(m.form_tokens.sum() + m.coverage() * m.tokens) and (m.form_types >= 0).all()
        seen[n] = known
    assert types > 3 * len(c) and seen[4] > 1.7 * seen[1]
    assert lm.form(b"walking.") == lm.form(b"ing.") != lm.form(b"walking") != lm.form(b"walked")


def test_scores_are_the_same_again(corpus):
    score = lambda d: {r["doc_id"]: r["score"] for r in lm.scores(d).collect()}
    assert score(corpus) == score(corpus)


def test_held_out_rows_are_likelier_after_training(spark, monkeypatch):
    said = "the cat sat on a mat and then went off to see".split()
    rows = [(i, " ".join((said[i % 11 :] + said[: i % 11]) * 20)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda: lm.scores(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    trained, deal = held(), lm._dealt
    monkeypatch.setattr(lm, "_dealt", lambda *a: deal(*a).where("false"))
    untrained = held()
    assert trained["s"] > 0.9 * untrained["s"] and trained["s"] > 0.9 * trained["b"]


def test_model_gradient_and_learning():
    rng = np.random.default_rng(0)
    counts = np.array([50, 200, 100, 80, 60, 40, 20, 10, 5, 5.0])
    m = lm.initial(counts)
    m.values = m.values.astype(np.float64) + rng.normal(0, 0.1, len(m.values))
    m.parts = m.split(m.values)
    xs, ys, h = rng.integers(0, 10, (5, 3)), rng.integers(0, 10, (5, 3)), rng.normal(0, 0.3, (3, lm.HIDDEN))
    grad = m.gradient(xs, ys, h)[1]
    for i in rng.choice(len(m.values), 60, replace=False):
        m.values[i] += 1e-6
        up = m.gradient(xs, ys, h)[0]
        m.values[i] -= 2e-6
        assert abs((up - m.gradient(xs, ys, h)[0]) / 2e-6 - grad[i]) < 1e-6
        m.values[i] += 1e-6
    m = lm.initial(counts)
    docs = [np.array([2, 3, 4, 2, 3, 4, 0])] * 400
    before = m.score(docs[:1])[0]
    for _ in range(60):
        m.train(np.concatenate(docs))
    after = lm.Model(m.classes, m.values).score(docs[:1])[0]
    assert after > before / 2  # order is learned, which counts cannot
    one = sum(np.exp(m.log_probability(np.zeros((1, lm.HIDDEN), np.float32), np.array([k])))[0] for k in range(10))
    assert abs(one - 1) < 1e-5


def test_words_are_split_counted_and_scored_in_arrays(monkeypatch):
    rng, some = random.Random(4), "aAbBzZéÉßİ's19 \n\t\x0b\x0c\r\x1c\x85\u00a0.,!#\U0001F600漢\0"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " ", "\n\ta ", "!!", "a" * 500]
    want = [t.encode().lower().split() for t in texts]
    flat, lengths = lm.split(pa.array(texts))
    assert flat.to_pylist() == [w for ws in want for w in ws] and lengths.tolist() == [len(ws) for ws in want]
    found, places = lm.numbers(flat)
    assert found.take(pa.array(places)) == flat and len(set(found.to_pylist())) == len(found)
    assert lm.forms_of(found.slice(3)).tolist() == [lm.form(w) for w in found.to_pylist()[3:]]
    assert lm.form(b"!!") == lm.form(b"!") != lm.form(b"a!") and lm.form(b"a") == crc32(b"a ") % lm.FORMS and lm.form(b"cab.,") == crc32(b"ab .") % lm.FORMS
    assert (lm.part_of(found, 7)[5:] == lm.part_of(found.slice(5), 7)).all() and set(lm.part_of(found, 7)) == set(range(7))

    held = [i % 3 == 0 for i in range(len(texts))]
    docs = pa.RecordBatch.from_pydict({"bucket": [0] * 200 + [1] * (len(texts) - 200), "held_out": held, "text": texts})
    scored = []
    for chars in (lm.BUCKET_CHARS, 300):  # a bucket in one piece, and in many
        monkeypatch.setattr(lm, "BUCKET_CHARS", chars)
        rows = [r for b in lm._counted(5)(iter([docs])) for r in b.to_pylist()]
        for bucket, own in ((0, range(200)), (1, range(200, len(texts)))):
            got = {w: n for r in rows if r["bucket"] == bucket for w, n in zip(r["words"].split(b"\n"), np.frombuffer(r["counts"], "<i8").tolist(), strict=True)}
            c = Counter(w for i in own if not held[i] for w in [*want[i], lm.END_WORD])
            assert got == {w: c[w] for i in own for w in [*want[i], lm.END_WORD]}
        outputs = lm.Outputs({lm.END_WORD: 0, b"a": 3, b"b": 4}, [1 + f % 2 for f in range(lm.FORMS)])
        m = lm.Language(lm.initial(np.array([5, 9, 8, 4, 3.0]), 2), outputs, 900, 300, np.array([500, 400]), np.array([150, 140]))
        side = {"doc_id": pa.array([None] * len(rows), pa.int64()), "held_out": pa.array([None] * len(rows), pa.bool_()), "text": pa.array([None] * len(rows), pa.string())}
        first = pa.RecordBatch.from_pydict({"bucket": [r["bucket"] for r in rows], "words": pa.array([r["words"] for r in rows], pa.binary()), "counts": pa.array([r["counts"] for r in rows], pa.binary()), **side})
        then = pa.RecordBatch.from_pydict({"bucket": docs["bucket"], "words": pa.array([None] * len(texts), pa.binary()), "counts": pa.array([None] * len(texts), pa.binary()), "doc_id": list(range(len(texts))), "held_out": held, "text": texts})
        both = pa.Table.from_batches([first, then]).sort_by([("bucket", "ascending"), ("words", "ascending")]).to_batches()  # null comes last
        scored.append([r for b in lm._scored(m)(iter(both)) for r in b.to_pylist()])
        assert sorted((r["doc_id"], r["n_tokens"]) for r in scored[-1]) == [(i, len(ws) + 1) for i, ws in enumerate(want)]
        one = next(r for r in scored[-1] if r["doc_id"] == len(texts) - 3)  # "\n\ta "
        assert abs(one["score"] - m.model.score([np.array([3, 0])])[0] / math.log(10)) < 1e-4
    assert scored[0] == scored[1]


def test_states_lie_column_by_column():
    m, h = lm.initial(np.array([5, 20, 10, 8, 6.0])), np.zeros((7, lm.HIDDEN), np.float32, "F")
    z, r, candidate, c, after = m.steps(np.arange(7) % 5, h)
    assert all(x.flags.f_contiguous for x in (z, r, candidate, c, after))  # rows of a few numbers each cost several times as much


def test_scores_without_training_documents(spark):
    rows = [(i, t) for i, t in zip([i for i in range(300) if crc32(str(i).encode()) % 10 == 0], ["a b", None, "c."], strict=False)]
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in got) == [(1, 0, 0, True), (2, 0, 0, True), (3, 0, 0, True)]
    assert all(math.isfinite(r["score"]) for r in got)


def test_score_is_the_sum_over_the_whole_document():
    m, rng = lm.initial(np.array([5, 20, 10, 8, 6.0])), np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 5, n), 0) for n in (3, 1, 700, 7, 7)]
    for d, got in zip(docs, m.score(docs), strict=True):
        h, x, total = np.zeros((1, lm.HIDDEN), np.float32), np.array([0]), 0.0
        for y in d:
            h = m.steps(x, h)[-1]
            x = np.array([y])
            total += m.log_probability(h, x)[0]
        assert abs(total - got) < 1e-2


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b<|im_end|>"), (1, 2, "user", "<\\|x <|"), (2, 0, "system", None), (2, 1, None, "x"), (3, 0, "assistant", ""), (3, 1, "assistant", "z<"), (None, None, "assistant", "n"), (None, 0, "user", "u"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "é\U0001F600"), (-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED), (5, 0, "as<|im_sep|>\n", "q"), (6, 0, "assistant", "y" * 100_000)]
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    e = chat.examples(c)
    got = {r["conv_id"]: r for r in chat.digests(e).collect()}
    escape = lambda t: re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", t)
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == conv))
        parts = [chat.START + escape(r) + chat.SEP + escape(x) + chat.END + "\n" for _, _, r, x in turns]
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        size = sum(len("".join(parts[: i + 1])) for i, t in enumerate(turns) if t[2] == "assistant" or i == len(turns) - 1)
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), fx.sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)))
        assert (g["loss_chars"], g["loss_sha256"], g["formatted_chars"]) == (len(loss), fx.sha(loss), size)
    one = [r for r in e.where("conv_id = 3").collect()]
    assert sorted(r["text"][r["loss_start"] : r["loss_end"]] for r in one) == ["", "z<"]
    assert chat.digests(chat.examples(c.limit(0))).count() == 0


def test_url_rules(spark):
    rows = ["http://a.NET/x", "http://net", "http://sub.example.net/en/1", "https://example.net/e", "ftp://example.com/de/", "x.org/fr/", "http://q.org/fr/?a#b", "http://notnet/", None, "", "http://é.org/fr/", "://net/", "a://b://net/", "http://Q.net?x/", "http://a.net/x"]
    p = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)] + [(None, "http://a.net/", "h")], "page_id long, url string, host string")
    none = p.select("url", (p["page_id"] < 0).alias("bad")).limit(0)
    got = {r["page_id"]: r for r in urls.judged(p, URL_RULES, none).collect()}
    want = {0: ("a.net", "/x", "net/", "block"), 1: ("net", "", None, "allow"), 2: ("sub.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.net", "/e", "net/", "block"), 4: ("example.com", "/de/", "example.com/de/", "block"), 5: ("", "", None, "allow"), 6: ("q.org", "/fr/", "org/fr/", "allow"), 7: ("notnet", "/", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("é.org", "/fr/", "org/fr/", "allow"), 11: ("net", "/", "net/", "block"), 12: ("b:", "//net/", None, "allow"), 13: ("q.net", "", None, "allow"), 14: ("a.net", "/x", "net/", "block"), None: ("a.net", "/", "net/", "block")}
    assert {k: tuple(r[1:5]) for k, r in got.items()} == want


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'ok'}{i % 2}.example.com/{'buy' if i % 2 else 'read'}/{i}") for i in range(240)]
    p = spark.createDataFrame(rows, "page_id long, url string")
    bad = p.select("url", ((p["page_id"] % 3 == 0) & (p["page_id"] % 2 == 1)).alias("bad"))
    mined = urls.mined_rules(bad).collect()
    assert mined and all(r["confidence"] >= urls.MIN_CONFIDENCE and r["urls"] >= urls.MIN_URLS for r in mined)
    got = {r["page_id"]: r["verdict"] for r in urls.judged(p, {}, bad).collect()}
    assert got[3] == "block" and got[1] == "allow"


def test_mined_rules_are_those_of_enumeration(spark):
    from itertools import combinations

    rng = random.Random(4)
    made = [f"http://{rng.choice(['spam', 'ok', 'news'])}.example.com/{rng.choice(['buy', 'read'])}/{rng.choice('abc')}" for _ in range(600)]
    bad = [("spam" in u and "buy" in u) or ("news" in u and "/a" in u and rng.random() < 0.9) or rng.random() < 0.03 for u in made]
    d = spark.createDataFrame([(u, b) for u, b in zip(made, bad, strict=True)] + [(None, True), ("http://x", None)], "url string, bad boolean")
    baskets = [(frozenset(r["t"]), r["bad"]) for r in d.where("bad IS NOT NULL").select(urls.tokens_of(d["url"]).alias("t"), "bad").collect()]
    alike = {}  # rules are mined on one of the tokens that are in the same URLs; the others' follow from it
    for t in {t for b, _ in baskets for t in b}:
        alike.setdefault(frozenset(i for i, (b, _) in enumerate(baskets) if t in b), []).append(t)
    first = {t: min(same) for same in alike.values() for t in same}
    names = sorted(set(first.values()))
    found = {}
    for size in range(1, 6):
        for c in combinations(names, size):
            of = [b for has, b in baskets if set(c) <= has]
            if sum(of) >= urls.MIN_URLS and sum(of) >= urls.MIN_CONFIDENCE * len(of):
                found[frozenset(c)] = (sum(of) / len(of), sum(of))
    least = {c: v for c, v in found.items() if not any(p < c and w[0] >= v[0] for p, w in found.items())}
    got = {frozenset(first[t] for t in r["tokens"]): (r["confidence"], r["urls"]) for r in urls.mined_rules(d).collect()}
    assert len(least) >= 2 and got.keys() == least.keys()
    assert all(abs(got[c][0] - least[c][0]) < 1e-9 and got[c][1] == least[c][1] for c in least)


def test_long_urls(spark):
    p = spark.createDataFrame([(1, "http://a.net/" + "x/" * 50_000), (2, "http://" + "a" * 100_000)], "page_id long, url string")
    got = {r["page_id"]: (len(r["host"]), len(r["path"]), r["rule"], r["verdict"]) for r in urls.judged(p, URL_RULES, p.selectExpr("url", "true AS bad")).collect()}
    assert got == {1: (5, 100_001, "net/", "block"), 2: (100_000, 0, None, "allow")}


def test_url_rules_need_as_many_urls_in_a_large_table(spark):
    bad = spark.range(60_000).selectExpr("CASE WHEN id < 100 THEN 'http://spam.example.com/x' ELSE concat('http://ok', id % 7, '.example.com/y') END AS url", "id < 100 AS bad")
    assert {("l=spam",), ("w=spam",), ("p=x",)} <= {tuple(r["tokens"]) for r in urls.mined_rules(bad).collect() if r["urls"] == 100 and r["confidence"] == 1}
    got = urls.judged(bad.selectExpr("monotonically_increasing_id() AS page_id", "url").distinct(), {}, bad)
    assert {(r["host"], r["verdict"]) for r in got.select("host", "verdict").distinct().collect()} == {("spam.example.com", "block"), *((f"ok{i}.example.com", "allow") for i in range(7))}
    assert urls.mined_rules(bad.where("bad").limit(19)).collect() == []


def test_mixture(spark, odd):
    from math import exp

    t = mixing.poisson_cdf(2.0)
    assert abs(t[0] - exp(-2)) < 1e-12 and abs(t[3] - exp(-2) * (1 + 2 + 2 + 8 / 6)) < 1e-12 and mixing.poisson_cdf(0.0) == [1.0] and len(mixing.poisson_cdf(900.0)) > 900
    d = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 9) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS source", "'c' AS mix_copy")
    out = mixing.mix(d, {"a": 0.6, "b": 0.1}, seed=3).cache()
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 3600) < 250 and abs(n["b"] - 600) < 110 and abs(n[None] - 1800) < 180
    counts = Counter(r["doc_id"] for r in out.where("source = 'a'").collect())
    assert abs(sum(counts.values()) / 2000 - 1.8) < 0.15 and abs(np.var([counts.get(i, 0) for i in range(0, 6000, 3)]) - 1.8) < 0.25
    assert out.columns == ["doc_id", "text", "source", "mix_copy", "mix_order"]
    at = [r["mix_order"] for r in out.collect()]
    assert at == sorted(at) and in_order(out.collect()) == in_order(mixing.mix(d.repartition(7), {"a": 0.6, "b": 0.1}, seed=3).collect())
    assert mixing.mix(odd, {"src0": 0.5}).columns == [*odd.columns, "mix_copy", "mix_order"]
    assert mixing.mix(odd.limit(0), {"src0": 0.5}).count() == 0


@pytest.mark.parametrize("size", [50, 500, 5000])
def test_decontamination_of_long_items(spark, size):
    item = [f"w{i}" for i in range(size)]
    docs = spark.createDataFrame([(1, "x " + " ".join(item[20:40]) + " y"), (2, " ".join(item)), (3, "w1 w3 w5")], "doc_id long, text string")
    items = spark.createDataFrame([("long", " ".join(item)), ("other", "a b c")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (22, 20, 1), 2: (size, size, 1), 3: (3, 0, 0)}


def test_near_components_of_shared_passages_and_scattered_copies(spark):
    """Texts that consist mostly of one passage, in parts and as a whole, and copies scattered around a text that is not there."""
    rng = random.Random(8)
    words = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    passage, other, rows = words(90), words(60), []
    for k in range(45):
        rows.append(words(rng.randrange(8, 45)) + passage + words(rng.randrange(6)))
        rows.append(passage[: rng.randrange(60, 91)] + other[: rng.randrange(10, 61)])
        copy = [*other * 2, *passage]
        for at in rng.sample(range(len(copy)), rng.randrange(3, 14)):
            copy[at] = f"x{k}"
        rows.append(copy)
    rows += [passage, other, passage + other]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(5)
    want = fx.components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert 3 < len({c for _, _, c in want}) < len(rows) - 20
    assert in_order(near.near_classes(docs).collect()) == in_order(want)


def test_near_components_of_a_group_of_copies_come_from_few_pairs(spark, monkeypatch):
    """Copies of one text with some words changed, half of them too far from each other to be linked: most are linked with the text in
    the middle, and no round pairs them all."""
    rng, rows, made = random.Random(5), [], []
    text = [f"{rng.randrange(10**6)}" for _ in range(150)]
    for k in range(400):
        copy = [*text]
        for at in rng.sample(range(len(copy)), rng.randrange(1, 6)):
            copy[at] = f"x{k}" if k % 3 else ""
        rows.append(copy)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*rows, text])], "doc_id long, text string")
    before = near._pairs

    def counted(left, right):
        made.append((out := before(left, right)).count())
        return out

    monkeypatch.setattr(near, "_pairs", counted)
    got = near.near_classes(docs).collect()
    want = fx.components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert 1 < len({c for _, _, c in want}) and in_order(got) == in_order(want)
    assert max(made) < 20 * len(rows), made
