"""Embedding whitening, sequence packing and periodic runs against brute-force versions."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from hydroframe.llm import packing, periodic, whitening
from hydroframe.llm.queries import QUERIES
from hydroframe.llm.settings import TOKENIZER
from tests.conftest import SF_SMALL
from tests.llm import fixtures as fx

# ---- whitening --------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v string, whitened string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", "w", 5) for i, v in rows], VECTORS).repartition(3)


def random_vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in rng.normal(size=d) * np.linspace(1, 0.1, d) + 3]) for i in range(n)]


def brute_whitening(rows, k=8):
    """By the definition, with numpy's own eigensolver and Python's whole numbers."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return {(i, j + 1): (n, d, p, e / np.trace(y.T @ y / n)) for (i, _), d, w in zip(rows, deviation, y @ basis / np.sqrt(values), strict=True) for j, (p, e) in enumerate(zip(w, values, strict=True))}


def check_whitening(got, want):
    got = {(r["vec_id"], r["component"]): r for r in got}
    assert got.keys() == want.keys()
    sign = {}
    for (i, j), (n, d, p, e) in want.items():
        r = got[i, j]
        assert (r["n"], r["deviation"]) == (n, d)
        assert abs(r["explained"] - e) <= 1e-9 * e and r["identity_error"] <= 1e-9
        if abs(p) > 1e-6:
            assert sign.setdefault(j, np.sign(p * r["whitened"])) == np.sign(p * r["whitened"])  # either sign, the same for all rows
        assert abs(abs(r["whitened"]) - abs(p)) <= 1e-6


def test_whitening_of_a_table(spark):
    t = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    check_whitening(QUERIES["op11_embedding_whitening"](spark, SF_SMALL).collect(), brute_whitening([(r["vec_id"], r["embedding"]) for r in t.collect()]))


def test_whitening_leaves_out_unusable_vectors(spark):
    rows = random_vectors(60, 10)
    bad = [(100, None), (101, [None] * 10), (102, [1.0] * 9 + [float("nan")]), (103, [float("inf")] + [0.0] * 9), (104, []), (105, [1.0, 2.0, 3.0])]
    got = whitening.whitened_components(vectors(spark, rows + bad)).collect()
    check_whitening(got, brute_whitening(rows))


def test_whitening_of_repeated_rows_and_null_ids(spark):
    rows = random_vectors(30, 4)
    got = whitening.whitened_components(vectors(spark, rows + rows[:5] + [(None, rows[7][1])])).collect()
    assert Counter(r["vec_id"] for r in got)[0] == 8 and Counter(r["vec_id"] for r in got)[None] == 4  # four dimensions, four components
    assert {r["n"] for r in got} == {36}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_whitening_of_nothing_or_of_like_vectors(spark, rows):
    d = whitening.whitened_components(vectors(spark, rows))
    assert d.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not d.collect()


def test_whitening_of_few_vectors_has_few_components(spark):
    got = whitening.whitened_components(vectors(spark, random_vectors(4, 6))).collect()
    assert {r["component"] for r in got} == {1, 2, 3}


def test_whitening_sums_are_exact_for_huge_entries(spark):
    rows = [(i, [float(c), 2.0**40 * (i % 3), -(2.0**44) * (i % 2)]) for i, c in enumerate(range(12))]
    m = whitening.fit(vectors(spark, rows))
    assert m.sums == [sum(int(1024 * v[j]) + 100000 for _, v in rows) for j in range(3)]
    assert {r["deviation"] for r in whitening.whiten(vectors(spark, rows), m).collect()} == {None}  # beyond 64 bits


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 5, 8, 21] * 6:
        a = rng.normal(size=(n, n))
        a = a + a.T - 2 * np.diag(np.diag(a)) * rng.integers(0, 2)  # with and without a diagonal
        e = np.linalg.eigvalsh(a)
        for s in (0.0, 0.3, -1.7):
            assert whitening.inertia(a, s) == (int((e > s).sum()), int((e < s).sum())) or np.abs(e - s).min() < 1e-9


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1, 1, 1], [1] * 9, [3, 1 + 1e-9, 1, 1 - 1e-9, 1e-6], [4.0, 0, 0, 0], [0, 0]])
def test_leading_pairs_with_ties_and_near_ties(values):
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(len(values), len(values))))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    got = whitening.leading(a, 8)
    want = sorted((v for v in values if v > 0), reverse=True)[:8]
    assert np.allclose([e for e, _ in got], want, atol=1e-12)
    v = np.array([x for _, x in got]).reshape(len(got), len(values))
    assert np.allclose(v @ v.T, np.eye(len(got)), atol=1e-12) and np.allclose(v @ a, np.array(want)[:, None] * v, atol=1e-12)


# ---- packing ----------------------------------------------------------------------------------------------------


def pieces(sizes):
    return [packing.Piece(i, 0, np.zeros(n, np.uint32)) for i, n in enumerate(sizes)]


def test_choice_makes_the_sum_of_squares_least():
    rng = random.Random(4)
    for _ in range(300):
        held = packing.Open(12)
        for p in pieces(rng.randrange(1, 12) for _ in range(rng.randrange(12))):
            held.place(p)
        before, size = held.count.tolist(), rng.randrange(1, 13)

        def squares(gap, before=before, size=size):
            n = [*before]
            n[gap] -= gap < 12
            n[gap - size] += 1
            return sum(x * x for x in n[1:12])  # neither full nor empty

        choices = {g: squares(g) for g in [*(g for g in range(size, 12) if before[g]), 12]}
        assert held.choice(size) == min(choices, key=lambda g: (choices[g], g))


def test_packing_is_near_the_bound():
    sizes = [int(n) for n in np.clip(np.random.default_rng(3).lognormal(6, 1, 4000), 1, 2047)]
    out = packing.finished(pieces(sizes))
    assert sorted(p.doc_id for x in out for p in x) == [*range(4000)]
    assert all(sum(len(p.ids) for p in x) <= 2048 for x in out)
    assert len(out) <= 1.005 * max(sum(sizes) / 2048, sum(n > 1024 for n in sizes)) + 1


def check_places(got, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        ends = [0, *(a + n for a, n in sorted(x))]
        assert [a for a, _ in sorted(x)] == ends[:-1] and ends[-1] <= capacity
    return len(sequences), sum(n for _, _, _, n, _ in want.elements())


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packed_sequences_hold_all_tokens(spark, tmp_path, capacity):
    docs = fx.odd_documents(spark).repartition(3)
    path = packing.write_sequences(docs, str(tmp_path / "s"), TOKENIZER, capacity)
    check_places(packing.read_places(spark, path, capacity).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], capacity)


def test_packed_sequences_of_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    n, tokens = check_places(QUERIES["op12_packed_sequences"](spark, SF_SMALL).collect(), rows, 2048)
    assert n <= -(-tokens // 2048) + 2


def test_packing_a_piece_block_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 300)  # many blocks a task, many tasks in the second round
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(2)
    path = packing.write_sequences(docs, str(tmp_path / "s"), TOKENIZER, 64)
    check_places(packing.read_places(spark, path, 64).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 64)


def test_packing_an_empty_table(spark, tmp_path):
    path = packing.write_sequences(fx.odd_documents(spark).limit(0), str(tmp_path / "s"), TOKENIZER)
    assert not packing.read_places(spark, path).collect() and not packing.read_sequences(spark, path).collect()


# ---- periodic runs ----------------------------------------------------------------------------------------------


def brute_runs(w):
    """All lags, all stretches; of stretches alike the smallest lag is the period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            a = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i > a and i - a + q >= max(6, 4 * q):
                found.setdefault((a - q, i - a + q), q)
            i += i == a
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    rng = random.Random(6)
    for _ in range(1500):
        n, kinds = rng.randrange(150), rng.choice([1, 2, 2, 3, 9])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 8:
                s, p = rng.randrange(n - 4), rng.randrange(1, 30)
                for i in range(s + p, min(n, s + p * rng.randrange(3, 9) + rng.randrange(p))):
                    w[i] = w[i - p]
        assert periodic.runs(np.array(w, np.int64)) == brute_runs(w)


def test_one_word_a_million_times_is_one_run():
    assert periodic.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]


@pytest.mark.parametrize("rows", [1, 512])
def test_periodic_runs_of_documents(spark, monkeypatch, rows):
    monkeypatch.setattr(periodic, "ROWS", rows)
    docs = fx.odd_documents(spark).unionByName(
        spark.createDataFrame([(50, "x " + "a b c\t" * 9 + "a b y", "h", "w"), (51, "é   " * 5, "h", "w")], "doc_id long, text string, h string, words string"), allowMissingColumns=True
    ).repartition(3)
    got = periodic.periodic_runs(docs).collect()
    want = []
    for r in docs.collect():
        w = fx.split_words(r["text"])
        found = brute_runs(w) if len(w) < 5000 else ([(0, len(w), 1)] if len(set(w)) == 1 else periodic.runs(np.unique(w, return_inverse=True)[1]))
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((r["doc_id"], found, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got}[50] == [(1, 29, 3)]


def test_periodic_runs_of_an_empty_table(spark):
    assert not periodic.periodic_runs(fx.odd_documents(spark).limit(0)).collect()
