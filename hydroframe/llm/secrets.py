"""Secret scans: fixed patterns, and formats that grammar inference learns from the credentials they find.

A prefix tree of labelled credentials is folded into a probabilistic automaton: states are merged while a Hoeffding bound cannot tell the
frequencies of what follows them apart (ALERGIA). One automaton is learned from credentials and one from other tokens; a
candidate is added if the first gives it the better likelihood, and one as good as credentials have.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import text_of, unit_hash, written

KINDS = ["assign", "access", "hex", "format"]

#: The base rules. Case is ignored in the first one's name alone, and for ASCII letters alone.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 and more, of all maximal runs.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates: tokens, and their parts beside base spans, of as many such characters as a credential has at least.
LEAST = 8
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{LEAST},}}")

#: Distinct strings that each automaton is learned from, least hashes first.
TRAIN_STRINGS = 2_000
#: ALERGIA's confidence: the smaller, the more states are merged.
ALPHA = 0.05
#: Share of the labelled credentials whose likelihood may be under the limit.
LOW_SHARE = 0.01
#: Bits a character by which a candidate may be less likely than that.
MARGIN = 0.25
SMOOTH = 0.01

#: Classes of characters, by which formats are learned, and their sizes; other characters are classes of their own.
_CLASSES = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G")}
_SIZES = Counter(_CLASSES.values())
_ALPHABET = len(_SIZES) + 6 + 1  # the classes, the candidates' other characters, and the end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base rules' spans, in order; code points, end exclusive."""
    out = []
    low = text.lower()  # only to rule texts out: a name of ASCII letters stays one
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[str], list[tuple[int, int, str]]]:
    """Base spans, the credentials in them, and the candidates ``(start, end, token)`` beside them."""
    base = base_spans(text)
    found = [ASSIGN.match(text, a)[2] if k == 0 else text[a:b] for a, k, b in base]
    free, i, taken = [], 0, []
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        while i < len(taken) and taken[i][0] < end:
            if taken[i][0] - at >= LEAST:
                free.append((at, taken[i][0], text[at : taken[i][0]]))
            at = taken[i][1]
            if at > end:  # the next token may be in it too
                break
            i += 1
        if end - at >= LEAST:
            free.append((at, end, text[at:end]))
    return base, found, free


class Automaton:
    """A probabilistic automaton: ``follow[state][symbol]`` is (times, next state), ``ends[state]`` how often it ends there."""

    def __init__(self, strings: Iterable[str]):
        self.follow: list[dict[str, list[int]]] = [{}]
        self.ends, self.times = [0], [0]
        for s in strings:
            at = 0
            self.times[0] += 1
            for c in s:
                step = self.follow[at].setdefault(_CLASSES.get(c, c), [0, len(self.follow)])
                if not step[0]:
                    self.follow.append({})
                    self.ends.append(0)
                    self.times.append(0)
                step[0] += 1
                at = step[1]
                self.times[at] += 1
            self.ends[at] += 1
        self._merge()

    def _alike(self, r: int, b: int) -> bool:
        factor, todo = math.sqrt(0.5 * math.log(2 / ALPHA)), [(r, b)]
        while todo:
            r, b = todo.pop()
            n, m = self.times[r], self.times[b]
            limit = factor * (1 / math.sqrt(max(n, 1)) + 1 / math.sqrt(max(m, 1)))
            if limit >= 1:  # nothing can be told apart here, and less so further on
                continue
            if abs(self.ends[r] / n - self.ends[b] / m) > limit:
                return False
            for c in {*self.follow[r], *self.follow[b]}:
                x, y = self.follow[r].get(c, (0, None)), self.follow[b].get(c, (0, None))
                if abs(x[0] / n - y[0] / m) > limit:
                    return False
                if x[0] and y[0]:
                    todo.append((x[1], y[1]))
        return True

    def _fold(self, r: int, b: int) -> None:
        """Adds the tree at ``b`` to what follows ``r``."""
        todo = [(r, b)]
        while todo:
            r, b = todo.pop()
            self.times[r] += self.times[b]
            self.ends[r] += self.ends[b]
            for c, (n, child) in self.follow[b].items():
                if c in self.follow[r]:
                    self.follow[r][c][0] += n
                    todo.append((self.follow[r][c][1], child))
                else:
                    self.follow[r][c] = [n, child]

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(self.times[t], r, c, t) for r in red for c, (_, t) in self.follow[r].items() if t not in red]
            if not blue:
                break
            _, parent, c, b = max(blue)
            same = next((r for r in red if self._alike(r, b)), None)
            if same is None:
                red.append(b)
            else:
                self.follow[parent][c][1] = same
                self._fold(same, b)
        number = {r: i for i, r in enumerate(red)}
        self.follow = [{c: [n, number[t]] for c, (n, t) in self.follow[r].items()} for r in red]
        self.ends, self.times = [self.ends[r] for r in red], [self.times[r] for r in red]

    def likelihood(self, s: str) -> float:
        """Mean log2 probability of the string's characters and its end."""
        at, total = 0, 0.0
        for c in [*s, ""]:
            k = _CLASSES.get(c, c)
            n, to = (self.ends[at], 0) if not c else self.follow[at].get(k, (0, 0))
            total += math.log2((n + SMOOTH) / (self.times[at] + SMOOTH * _ALPHABET) / _SIZES.get(k, 1))
            at = to
        return total / (len(s) + 1)


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FREE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        base = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in r[0]] for r in rows]
        free = [[dict(zip(("start", "end", "token"), s, strict=True)) for s in r[2]] for r in rows]
        data = [*batch.columns[:-1], pa.array(base, _SPANS), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array(free, _FREE)]
        yield pa.RecordBatch.from_arrays(data, [*batch.schema.names[:-1], "base", "found", "free"])


def _learned(found: DataFrame, strings: str) -> Automaton | None:
    """From the distinct strings with the least hashes: ``TRAIN_STRINGS`` of them go to the driver at most."""
    d = found.select(F.explode(strings).alias("s")).distinct().orderBy(unit_hash(F.col("s")), "s").limit(TRAIN_STRINGS)
    rows = [r["s"] for r in d.collect()]
    return Automaton(rows) if rows else None


def find_secrets(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` of each row (as ``_row``), its ``base`` spans and the ``added`` ones (``start``, ``kind`` number, ``end``).

    Texts are read once; each row's spans, credentials and candidates are written, then all candidates are scored. The limit that
    a candidate's likelihood must reach is the quantile ``LOW_SHARE`` of all credentials in the table, less ``MARGIN``. Null and empty texts have no spans; repeated
    rows are scanned each; without credentials nothing is added; an empty table gives an empty result.
    """
    d = docs.select(F.struct(*keep).alias("_row"), text_of().alias("text"))
    kind = d.schema["_row"].dataType.simpleString()
    found = written(d.mapInArrow(_scanned, f"_row {kind}, base {_SPAN}, found array<string>, free array<struct<start:int,end:int,token:string>>"), "scanned")
    good, other = _learned(found, "found"), _learned(found, "free.token")
    if good is None or other is None:
        return found.select("_row", "base", F.array().cast(_SPAN).alias("added"))

    @F.pandas_udf("double")
    def likelihood(s: pd.Series) -> pd.Series:
        return s.map(good.likelihood)

    known = found.select(F.explode("found").alias("s")).groupBy("s").agg(F.count("*").alias("n")).select("n", likelihood("s").alias("l"))
    limit = known.agg(F.percentile("l", LOW_SHARE, F.col("n")).alias("l")).first()["l"] - MARGIN

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(100_000)  # most are words that come again
        def likely(token: str) -> bool:
            return (x := good.likelihood(token)) >= limit and x > other.likelihood(token)

        for batch in batches:
            rows = [[s for s in r.as_py() if likely(s["token"])] for r in batch.column(batch.schema.names.index("free"))]
            added = pa.array([[{"start": s["start"], "kind": 3, "end": s["end"]} for s in r] for r in rows], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), added], ["_row", "base", "added"])

    return found.select("_row", "base", "free").mapInArrow(add, f"_row {kind}, base {_SPAN}, added {_SPAN}")


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the counts of base spans by kind, ``base_sha256``, and all ``spans`` as text."""
    d = find_secrets(docs, [F.col("doc_id")])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    sha = F.sha2(_listed(F.col("base")).cast("binary"), 256)
    return d.select("_row.doc_id", count(0), count(1), count(2), sha.alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"))
