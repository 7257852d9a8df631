"""Periodic run detection: an online sparse diagonal DP finds all maximal periodic runs of words in linear memory.

A run is a stretch of words with smallest period q (words q apart are alike) that no neighbouring word extends. In the matrix of
a text against itself it is a stretch of the diagonal of lag q. The DP goes through the words once; a word's earlier
occurrences increment the match lengths of the lags that are active, and a lag that the next word does not continue ends: if its
match is long enough, the run is emitted at once.

The DP is sparse, as only few of a word's earlier occurrences can matter. In a run of four periods or more, all but the first
``k`` words of the second and later periods come with the same ``k`` words as their copy one period before. For ``k >= q``
that copy is the nearest occurrence of these ``k`` words: a nearer one would give a smaller period. So at the scale ``k``
a word has one earlier occurrence at most, that of the ``k`` words from it on, and one lag is active at a time. A run of period
q has ``3 q`` matches at least (five for q = 1), so the scales 5, 15, 45 and so on find all periods: those over a third of k at the scale k.
A text whose words nowhere come five in a row again has no run, and a scale without repeats ends the search. Work is
``n log n`` for any text, one word a million times included.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import text_of

#: A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The first scale, and the factor from one to the next: with four periods, no less than three of them match.
FIRST, FACTOR = 5, 3
#: Rows whose words are numbered together.
ROWS = 512

_M = np.uint64(0x9E3779B97F4A7C15)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers, alike for pairs alike."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _scales(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Scales ``k`` with the numbers of the ``k`` words from each word on, as long as some come again."""
    if len(words) < LEAST_WORDS:
        return
    two = _paired(words[:-1], words[1:])
    four = _paired(two[:-2], two[2:])
    k, grams = FIRST, _paired(four[:-1], words[4:])
    while int(grams.max()) + 1 < len(grams):
        yield k, grams
        if len(grams) <= 2 * k:
            return
        grams = _paired(_paired(grams[:-k], grams[k:])[:-k], grams[2 * k :])
        k *= FACTOR


def _diagonals(grams: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Goes through the words once: (lag, its first place, matches in a row) of each lag, as soon as it ends."""
    seen = [-1] * (int(grams.max()) + 1)
    lag = length = 0
    for i, gram in enumerate(grams.tolist()):
        earlier = seen[gram]
        seen[gram] = i
        at = i - earlier if earlier >= 0 else 0
        if at == lag:
            length += 1
        else:
            if lag:
                yield lag, i - length, length
            lag, length = at, 1
    if lag:
        yield lag, len(grams) - length, length


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text whose words are numbers, by start, then period."""
    found = []
    for k, grams in _scales(words):
        for lag, first, matches in _diagonals(grams):
            length = lag + matches + k - 1
            if (k == FIRST or lag * FACTOR > k) and lag <= k and length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((first - lag, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _repeating(words: np.ndarray, lengths: np.ndarray) -> set[int]:
    """The texts, of many whose words stand one after the other, in which some five words in a row (known by hash) come again."""
    if len(words) < FIRST:
        return set()
    text = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    inside = text[: 1 - FIRST] == text[FIRST - 1 :]
    x, some = words.astype(np.uint64), len(words) - FIRST + 1
    h = text[:some] * _M
    for j in range(FIRST):
        h = (h ^ (h >> np.uint64(29))) * _M + x[j : j + some]
    h = (h ^ (h >> np.uint64(32))) * _M
    h, text = h[inside], text[:some][inside]
    order = np.argsort(h)
    again = h[order[1:]] == h[order[:-1]]
    return set(text[order[1:]][again].tolist())


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, the text's runs, and its words without those that a run repeats."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = [t.as_py().split() for t in part.column(1)]  # of bytes: at ASCII white space
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            lengths = np.array([len(w) for w in texts])
            words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
            starts = np.cumsum(lengths) - lengths
            found: list[Sequence[tuple[int, int, int]]] = [()] * len(texts)
            for i in _repeating(words, lengths):
                if own := runs(np.unique(words[starts[i] : starts[i] + lengths[i]], return_inverse=True)[1]):
                    found[i] = own
                    texts[i] = [w for w, ok in zip(texts[i], kept(len(texts[i]), own).tolist(), strict=True) if ok]
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _RUNS), pa.array([b" ".join(w) for w in texts], pa.binary())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, its ``runs`` by start, then period (word numbers from 0), and ``collapsed``, its text's words
    but for those in a run after that run's first period, joined by spaces.

    Words are maximal runs of anything but ASCII white space. ``text``: what to read instead of the column ``text``. Null and empty texts
    have no runs and collapse to ``""``; repeated rows give a row each; an empty table gives an empty result. Texts are looked
    at one by one, where they are: nothing is shuffled, and a task holds a few hundred texts at a time.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text" if text is None else text).cast("binary").alias("text"))
    out = d.mapInArrow(_searched, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.select("doc_id", "runs", F.col("collapsed").cast("string").alias("collapsed"))
