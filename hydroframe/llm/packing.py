"""Best-fit packing by sums of squares: token pieces go into sequences of a fixed capacity.

A piece of ``s`` tokens may go into any open sequence with a gap ``g >= s``, or open a new one. The rule takes the choice after
which the sum over all gaps of the squared number of open sequences with that gap is least: moving a sequence from gap
``g`` to ``g - s`` changes it by ``2 (N[g - s] - N[g]) + 2``, a new one by ``2 N[capacity - s] + 1``, and full sequences
(gap 0) count no more. So sequences gather at no gap, and pieces of every size keep finding one that they fill exactly. Of
equal choices the smallest gap is taken.

Pieces are packed where they are tokenized, a block at a time, the longest first. Sequences that did not get full come apart
again: their pieces, a few per cent of all, are dealt to tasks of ``BLOCK_TOKENS`` each, which pack them anew, and what
stays open there again and again until that saves no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import text_of
from hydroframe.llm.tokens import _chunks, _worker_encoder

CAPACITY = 2048
END_ID = 0
#: Tokens of pieces that a task holds and packs at once.
BLOCK_TOKENS = 1 << 23

_SEQUENCES = pa.schema([("sequence_id", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("loose", pa.bool_())])
_SEQUENCES_SQL = "sequence_id bigint, wide boolean, ids binary, doc_ids array<bigint>, pieces array<int>, lengths array<int>, loose boolean"


@dataclass(frozen=True)
class Piece:
    """Part ``number`` of a document: ``ids`` is never empty and never longer than the capacity."""

    doc_id: int | None
    number: int
    ids: np.ndarray


class Open:
    """Open sequences by gap, and how many there are of each."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, np.zeros(capacity + 1, np.int64)
        self.by_gap: dict[int, list[list[Piece]]] = {}

    def choice(self, size: int) -> int:
        """The gap that a piece of ``size`` goes into; the capacity stands for a new sequence."""
        gaps = np.flatnonzero(self.count[size : self.capacity]) + size
        new = 2 * int(self.count[self.capacity - size]) + 1 if size < self.capacity else 0
        if not len(gaps):
            return self.capacity
        change = 2 * (self.count[gaps - size] - self.count[gaps]) + 2
        if gaps[0] == size:
            change[0] = 1 - 2 * self.count[size]
        best = int(np.argmin(change))
        return int(gaps[best]) if change[best] <= new else self.capacity

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts the piece into a sequence; returns the sequence if that is full now."""
        size = len(piece.ids)
        gap = self.choice(size)
        if gap < self.capacity:
            held = self.by_gap[gap].pop()
            self.count[gap] -= 1
        else:
            held = []
        held.append(piece)
        if gap == size:
            return held
        self.by_gap.setdefault(gap - size, []).append(held)
        self.count[gap - size] += 1
        return None

    def sequences(self) -> list[list[Piece]]:
        return [x for gap in sorted(self.by_gap) for x in self.by_gap[gap]]


def packed(pieces: list[Piece], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[list[Piece]]]:
    """Full and open sequences of the pieces, the longest placed first."""
    held = Open(capacity)
    full = [x for p in sorted(pieces, key=lambda p: -len(p.ids)) if (x := held.place(p))]
    return full, held.sequences()


def finished(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of the pieces; those that stay open are packed anew as long as that saves some."""
    done, left = packed(pieces, capacity)
    while left:
        full, rest = packed([p for x in left for p in x], capacity)
        if len(full) + len(rest) >= len(left):
            return done + left
        done, left = done + full, rest
    return done


# ---- tasks ------------------------------------------------------------------------------------------------------


class _Out:
    """Rows of one task: sequences get the round, the task and a running number as their id."""

    def __init__(self, round_: int, wide: bool):
        self.next, self.kind, self.wide, self.rows = (round_ << 60) + (TaskContext.get().partitionId() << 32), "<u4" if wide else "<u2", wide, []

    def add(self, pieces: list[Piece], loose: bool) -> None:
        ids = np.concatenate([p.ids for p in pieces]).astype(self.kind).tobytes()
        self.rows.append((None if loose else self.next, self.wide, ids, [p.doc_id for p in pieces], [p.number for p in pieces], [len(p.ids) for p in pieces], loose))
        self.next += not loose

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*self.rows, strict=True), _SEQUENCES, strict=True)], schema=_SEQUENCES)
            self.rows = []


def _tokenized(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> full sequences, and the pieces of those that did not get full, a loose row each."""
        encoder = _worker_encoder(tokenizer)
        out, block, size = _Out(0, encoder.tokenizer.get_vocab_size() > 1 << 16), [], 0
        end = np.array([end_id], "<u4")

        def close() -> None:
            full, left = packed(block, capacity)
            for x in full:
                out.add(x, loose=False)
            for p in (p for x in left for p in x):
                out.add([p], loose=True)

        for doc_ids, texts in _chunks(batches):
            for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                ids = np.concatenate([ids, end])
                for number, at in enumerate(range(0, len(ids), capacity)):
                    piece = Piece(doc_id, number, ids[at : at + capacity])
                    if len(piece.ids) == capacity:
                        out.add([piece], loose=False)
                    else:
                        block.append(piece)
                        size += len(piece.ids)
                yield from out.flush(1000)
            if size >= BLOCK_TOKENS:
                close()
                block, size = [], 0
                yield from out.flush()
        close()
        yield from out.flush()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Piece]]]:
    """Sequences, or loose pieces as sequences of one, with their ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            key, wide, ids, docs, numbers, lengths = (batch.column(c)[i].as_py() for c in range(6))
            parts = np.split(np.frombuffer(ids, "<u4" if wide else "<u2"), np.cumsum(lengths)[:-1])
            yield key, [Piece(d, n, x) for d, n, x in zip(docs, numbers, parts, strict=True)]


def _repacked(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Loose pieces -> sequences, ``BLOCK_TOKENS`` twice over at most at once."""
        out, block, size = None, [], 0
        for batch in batches:
            out = out or _Out(1, batch.column(1)[0].as_py()) if batch.num_rows else out
            for _, (piece,) in _rows([batch]):
                block.append(piece)
                size += len(piece.ids)
                if size >= 2 * BLOCK_TOKENS:
                    for x in finished(block, capacity):
                        out.add(x, loose=False)
                    block, size = [], 0
                    yield from out.flush()
        for x in finished(block, capacity):
            out.add(x, loose=False)
        if out:
            yield from out.flush()

    return run


_PLACES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences -> a row for each piece, with the crc32 of its ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        rows = []
        for key, pieces in _rows([batch]):
            at = 0
            for p in pieces:
                rows.append((p.doc_id, p.number, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), key, at))
                at += len(p.ids)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _PLACES, strict=True)], schema=_PLACES)


# ---- jobs -------------------------------------------------------------------------------------------------------


def write_sequences(docs: DataFrame, path: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> str:
    """Tokenize ``text`` of each row, append ``end_id``, and write all rows' ids as sequences of at most ``capacity`` ids to the folder ``path``.

    Only documents longer than the capacity are cut, into pieces of it; the last piece may be shorter. ``tokenizer``: a file of
    the tokenizers library that all executors have. Null text counts as empty and has the end id alone; null ids stay null;
    repeated rows are packed each; an empty table gives an empty folder. No key deals the rows, so
    no value, however frequent, lands in one task. Beside the encoder a task holds ``BLOCK_TOKENS`` of pieces and one text.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    d.mapInArrow(_tokenized(tokenizer, capacity, end_id), _SEQUENCES_SQL).write.partitionBy("loose").parquet(f"{path}/round=0")
    loose = _round(spark, path, 0, loose=True)
    size = F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)), F.lit(0))
    tasks = max(1, -(-loose.agg(size.alias("n")).first()["n"] // BLOCK_TOKENS))
    loose.repartition(tasks).mapInArrow(_repacked(capacity), _SEQUENCES_SQL).write.partitionBy("loose").parquet(f"{path}/round=1")
    return path


def _round(spark: SparkSession, path: str, k: int, loose: bool) -> DataFrame:
    return spark.read.schema(_SEQUENCES_SQL).parquet(f"{path}/round={k}").where(F.col("loose") == loose)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``sequence_id``, its ``ids`` (little-endian, four bytes each if ``wide``, else two), and in their order the ``doc_ids``, piece
    numbers ``pieces`` and ``lengths`` of what is in it."""
    return _round(spark, path, 0, loose=False).unionByName(_round(spark, path, 1, loose=False)).drop("loose")


def read_places(spark: SparkSession, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece, from the files: ``doc_id``, ``piece``, ``start`` (its document's ids before it), ``length``, ``ids_crc32``, and
    where it is: ``sequence_id`` and ``offset``."""
    d = read_sequences(spark, path).mapInArrow(_placed, "doc_id bigint, piece int, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return d.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32", "sequence_id", "offset")
