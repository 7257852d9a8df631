"""Embedding whitening by spectrum slicing: leading eigenpairs of a covariance are isolated by counting and then sharpened.

A symmetric matrix V - s I is factored as L D Lᵀ; by Sylvester's law of inertia, D has as many positive entries as V has
eigenvalues over s. Bisection over s with these counts isolates each leading eigenvalue in an interval of its own, Rayleigh
quotient iteration from inside the interval converges cubically to its eigenpair, and counts on both sides of the value found
certify its number: no pair is missed or named twice. Eigenvalues that no count can tell apart get orthonormal
vectors of their common space.

Entries become whole numbers first, so that row count, sums and squared deviations are exact at any size. Tasks see rows
of vectors; only sums over them, of a vector's size and its square, travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import written

#: An entry c becomes floor(SCALE c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors that a task multiplies at once.
ROWS = 4096
#: Pivots of a factorization are chosen one by one or two by two; this is the usual limit between them.
_ALPHA = (1 + math.sqrt(17)) / 8


# ---- the spectrum -----------------------------------------------------------------------------------------------


def inertia(a: np.ndarray, shift: float) -> tuple[int, int]:
    """How many eigenvalues of the symmetric matrix ``a`` are over ``shift`` and how many under it: the signs of D in
    P (a - shift I) Pᵀ = L D Lᵀ, with blocks of one or two rows and the pivots that Bunch and Kaufman choose."""
    m, n = a - shift * np.eye(len(a)), len(a)
    tiny = np.finfo(float).tiny * 1e8 + 1e-300
    over = under = k = 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j], k:] = m[[j, i], k:]
            m[k:, [i, j]] = m[k:, [j, i]]

    while k < n:
        rest = np.abs(m[k + 1 :, k])
        r = k + 1 + int(np.argmax(rest)) if len(rest) else k
        largest, size = (float(rest.max()) if len(rest) else 0.0), 1
        if max(abs(m[k, k]), largest) <= tiny:
            k += 1  # an eigenvalue at the shift itself
            continue
        if abs(m[k, k]) < _ALPHA * largest:
            row = np.abs(m[k:, r])
            row[r - k] = 0
            other = float(row.max())
            if abs(m[k, k]) * other >= _ALPHA * largest**2:
                pass
            elif abs(m[r, r]) >= _ALPHA * other:
                swap(k, r)
            else:
                swap(k + 1, r)
                size = 2
        block, below = m[k : k + size, k : k + size], m[k + size :, k : k + size]
        if size == 1:
            signs = [block[0, 0]]
            m[k + 1 :, k + 1 :] -= np.outer(below[:, 0], below[:, 0] / block[0, 0])
        else:
            signs = [1, -1]  # such a block has a negative determinant
            m[k + 2 :, k + 2 :] -= below @ np.linalg.solve(block, below.T)
        over += sum(x > 0 for x in signs)
        under += sum(x < 0 for x in signs)
        k += size
    return over, under


def _solved(a: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """A unit vector along (a - shift I)⁻¹ x; a shift that is an eigenvalue is moved by a rounding error."""
    for nudge in (0.0, 1.0, 16.0):
        try:
            y = np.linalg.solve(a - (shift + nudge * np.finfo(float).eps * scale) * np.eye(len(a)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and (size := np.linalg.norm(y)) > 0:
            return y / size
    return x


def _apart(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``x`` without its parts along the vectors found, as a unit vector."""
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
    return x / np.linalg.norm(x)


def leading(a: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest eigenvalues of a symmetric matrix and unit eigenvectors, by falling value; fewer if the rest
    are not over the rounding errors of the largest."""
    n, scale = len(a), float(np.abs(a).sum(axis=1).max()) if len(a) else 0.0
    if not scale:
        return []
    error = 4 * n * np.finfo(float).eps * scale
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = inertia(a, s)[0]
        return counts[s]

    rng, out = np.random.default_rng(7), []
    for number in range(1, min(count, above(error)) + 1):
        low, high = error, scale * (1 + 1e-12) + error  # above(low) >= number > above(high)
        while True:
            found = [v for _, v in out]
            alone = above(low) == number and above(high) == number - 1
            narrow = high - low <= 2 * error
            if alone or narrow:
                middle = value = (low + high) / 2
                x = _apart(rng.normal(size=n), found)
                for _ in range(3):
                    x = _apart(_solved(a, middle, x, scale), found)
                for _ in range(12):  # cubic: two or three steps do
                    value = float(x @ a @ x)
                    if not narrow and not low <= value <= high:
                        break
                    if np.linalg.norm(a @ x - value * x) <= error / 8:
                        break
                    x = _apart(_solved(a, value, x, scale), found)
                value = float(x @ a @ x)
                if narrow or (low <= value <= high and above(value - error) >= number > above(value + error)):
                    out.append((value, x))
                    break
            half = (low + high) / 2
            low, high = (half, high) if above(half) >= number else (low, half)
    return sorted(out, key=lambda p: -p[0])


@dataclass(frozen=True)
class Spectrum:
    """What the fit list says: rows ``n``, exact ``sums`` by dimension, the covariance's ``trace``, and its leading
    ``values`` and ``vectors`` (one a row)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


# ---- tasks ------------------------------------------------------------------------------------------------------


def _whole(batch: pa.RecordBatch, column: int, dimensions: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers) of the batch's usable vectors, by dimension, ``ROWS`` at once."""
    vectors = batch.column(column)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes) if dimensions is None else [dimensions]:
        at = np.flatnonzero(sizes == d)
        for i in range(0, len(at) if d else 0, ROWS):
            some = at[i : i + ROWS]
            c = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), d)
            ok = np.isfinite(c).all(axis=1)  # a null entry is read as NaN
            x = np.clip(np.floor(SCALE * c[ok]), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT
            if len(x):
                yield some[ok], x


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors -> by dimension and place: rows, and the sum of the whole numbers as high * 2**32 + low."""
    sums: dict[int, list] = {}
    for batch in batches:
        for _, x in _whole(batch, 0):
            held = sums.setdefault(x.shape[1], [0, 0, 0])
            for i, part in enumerate((np.ones_like(x[0]) * len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))):
                held[i] = held[i] + part
    for d, (n, high, low) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(n), pa.array(high), pa.array(low)], ["dimensions", "place", "n", "high", "low"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, in double precision: whole numbers first, then the mean's fraction."""
    mean = np.array([s // n for s in sums], np.int64)
    return (x - mean).astype(np.float64) - np.array([s % n / n for s in sums])


def _multiplied(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors -> the sums of products of their deviations, a row of the matrix each."""
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            for _, x in _whole(batch, 0, len(sums)):
                y = _deviations(x, n, sums)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(list(total), pa.list_(pa.float64()))], ["place", "sums"])

    return run


def _squared(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)² by row; null where that is not a 64-bit number."""
    mean, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
    off = x - mean
    most = n * (int(np.abs(off).max()) + 1)
    if len(sums) * most * most < 1 << 63:
        y = n * off - rest.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * off.astype(object) - rest
    return [int(s) if s < 1 << 63 else None for s in (y * y).sum(axis=1)]


def _whitened(m: Spectrum):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, vector -> id, deviation, whitened coordinates."""
        for batch in batches:
            for at, x in _whole(batch, 1, len(m.sums)):
                y = _deviations(x, m.n, m.sums) @ m.vectors.T / np.sqrt(m.values)
                ids = batch.column(0).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array(_squared(x, m.n, m.sums), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return run


# ---- jobs -------------------------------------------------------------------------------------------------------


def fit(vectors: DataFrame, column: str | Column = "embedding", components: int = COMPONENTS) -> Spectrum | None:
    """The spectrum of all usable vectors, or None if there are none.

    Vectors that are null or empty or hold null or non-finite entries are no part of it, nor those of another dimension than most
    have (the larger of two as frequent). Entries beyond 2**62 / SCALE count as that. Twice all vectors are read: for sums, and for
    products of deviations from the mean. What comes to the driver has the size of a vector's square.
    """
    v = vectors.select((F.col(column) if isinstance(column, str) else column).cast("array<double>").alias("v"))
    s = v.mapInArrow(_summed, "dimensions bigint, place bigint, n bigint, high bigint, low bigint").groupBy("dimensions", "place")
    s = written(s.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")), "sums")
    best = s.where("place = 0").orderBy(F.desc("n"), F.desc("dimensions")).first()
    if best is None:
        return None
    n, d = best["n"], best["dimensions"]
    rows = s.where(F.col("dimensions") == d).orderBy("place").collect()
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
    p = v.mapInArrow(_multiplied(n, sums), "place bigint, sums array<double>")
    p = p.select("place", F.posexplode("sums").alias("other", "x")).groupBy("place", "other").agg(F.sum("x").alias("x"))
    a = np.zeros((d, d))
    for r in p.collect():  # d * d rows
        a[r["place"], r["other"]] = r["x"] / n
    a = (a + a.T) / 2
    found = leading(a, components)
    return Spectrum(n, sums, float(np.trace(a)), np.array([e for e, _ in found]), np.array([x for _, x in found]).reshape(len(found), d))


def whiten(vectors: DataFrame, m: Spectrum, id_column: str = "vec_id", column: str | Column = "embedding") -> DataFrame:
    """Per usable vector of the fit's dimension: ``vec_id``, ``deviation`` (the sum over dimensions of (n x - S)²; null beyond 64 bits)
    and ``whitened``, its coordinates along the components, each with variance 1 over the fit list. Ids may be null or repeated."""
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), (F.col(column) if isinstance(column, str) else column).cast("array<double>").alias("v"))
    return v.mapInArrow(_whitened(m), "vec_id bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, n: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity, over all ``n`` rows."""
    first = white.limit(1).collect()
    k = len(first[0]["whitened"]) if first else 0
    if not k:
        return 0.0
    y = [F.col("whitened")[i] for i in range(k)]
    means = white.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(y))).first()
    y = [c - F.lit(means[i]) for i, c in enumerate(y)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = white.agg(*((F.sum(y[i] * y[j]) / n).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable row of ``vectors`` and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``.

    Unusable vectors (see ``fit``) have no rows. Fewer than ``components`` components come back if the covariance has no more
    eigenvalues over its rounding errors, as with few dimensions or many like vectors; none if all vectors are alike. An
    empty table gives an empty result.
    """
    m = fit(vectors, components=components)
    if m is None or not len(m.values):
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    white = written(whiten(vectors, m), "whitened")
    error = identity_error(white, m.n)
    explained = F.array(*(F.lit(float(e / m.trace)) for e in m.values))
    d = white.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return d.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
