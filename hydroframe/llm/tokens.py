"""Token-id files: documents are tokenized in order and packed as patched frame-of-reference blocks.

A token folder is a Parquet table, so Spark's commit protocol makes it whole however many executors are lost, and any
store that Spark reaches will do. Each row is a segment: whole documents, in order, as one binary payload::

    header   4s magic "PFR1", u32 ids, u32 blocks
    index    u32 for each block: byte at which it starts
    block    u32 minimum, u32 exceptions, u8 width, packed offsets from the minimum (``width`` bits each, highest bit
             first), then for each exception u16 place and u32 whole offset

All integers are little-endian. A block has ``BLOCK`` ids, a segment's last one what is left.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.llm.common import small, text_of

MAGIC = b"PFR1"
BLOCK = 1024
#: Share of a block's offsets that its width must hold; the others are exceptions.
PERCENTILE = 0.98
#: A segment is closed when it has so many ids; a document is never split.
SEGMENT_IDS = 1 << 17
#: Words, and pieces of words, whose ids a Python worker keeps, in each of two generations.
CACHED_WORDS = 100_000
CACHED_PIECES = 250_000
#: Characters that are encoded at once.
CHUNK_CHARS = 1 << 20
END_ID = 1

SEGMENTS = "shard int, segment int, first bigint, n bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


# ---- the block format -------------------------------------------------------------------------------------------


def _pack(offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows of offsets under 2**width as rows of bytes."""
    rows, n = offsets.shape
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    raw = np.unpackbits(offsets.astype(kind).view(np.uint8).reshape(rows, n, bits // 8), axis=2)[:, :, bits - width :]
    return np.packbits(raw.reshape(rows, n * width), axis=1)


def _unpack(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    rows = raw.shape[0]
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    full = np.zeros((rows, n, bits), np.uint8)
    full[:, :, bits - width :] = np.unpackbits(raw, axis=1)[:, : n * width].reshape(rows, n, width)
    return np.packbits(full, axis=2).view(kind).reshape(rows, n).astype(np.uint32)


def _widths(offsets: np.ndarray) -> np.ndarray:
    """Bits that ``PERCENTILE`` of each row's offsets fit in."""
    lengths = np.frexp(offsets.astype(np.float64))[1]
    counts = np.bincount((lengths + np.arange(len(offsets))[:, None] * 33).ravel(), minlength=33 * len(offsets)).reshape(-1, 33)
    return np.argmax(np.cumsum(counts, axis=1) >= PERCENTILE * offsets.shape[1], axis=1)


def _blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of equally long rows of ids."""
    low = ids.min(axis=1)
    offsets = ids - low[:, None]
    widths = _widths(offsets)
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        part, limit = offsets[at], np.uint64(1) << np.uint64(width)
        large = part >= limit
        packed = _pack(np.where(large, 0, part), int(width)) if width else np.zeros((len(at), 0), np.uint8)
        for i, row in enumerate(at):
            places = np.flatnonzero(large[i])
            head = np.array([low[row], len(places)], "<u4").tobytes() + bytes([width])
            out[row] = head + packed[i].tobytes() + places.astype("<u2").tobytes() + part[i, places].astype("<u4").tobytes()
    return out


def pack(ids: np.ndarray) -> bytes:
    """A segment's payload."""
    ids = np.asarray(ids, np.uint32)
    whole = len(ids) // BLOCK * BLOCK
    blocks = _blocks(ids[:whole].reshape(-1, BLOCK)) if whole else []
    blocks += _blocks(ids[None, whole:]) if whole < len(ids) else []
    starts = 12 + 4 * len(blocks) + np.cumsum([0, *map(len, blocks)])[:-1]
    return MAGIC + np.array([len(ids), len(blocks)], "<u4").tobytes() + starts.astype("<u4").tobytes() + b"".join(blocks)


def unpack(payload: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a payload, or of some of its blocks alone: the index says where they start."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, count = np.frombuffer(payload, "<u4", 2, 4).tolist()
    starts = np.frombuffer(payload, "<u4", count, 12).tolist()
    raw, wanted = np.frombuffer(payload, np.uint8), blocks if blocks is not None else range(count)
    sizes = [min(BLOCK, n - BLOCK * k) for k in wanted]
    out = np.zeros(sum(sizes), np.uint32)
    rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, k in enumerate(wanted):
        rows.setdefault((sizes[i], int(raw[starts[k] + 8])), []).append((starts[k], BLOCK * i))
    for (size, width), found in rows.items():
        bytes_ = (size * width + 7) // 8
        if width:
            values = _unpack(np.stack([raw[s + 9 : s + 9 + bytes_] for s, _ in found]), size, width)
        else:
            values = np.zeros((len(found), size), np.uint32)
        for (s, at), row in zip(found, values, strict=True):
            low, extra = np.frombuffer(payload, "<u4", 2, s).tolist()
            if extra:
                places = np.frombuffer(payload, "<u2", extra, s + 9 + bytes_)
                row[places] = np.frombuffer(payload, "<u4", extra, s + 9 + bytes_ + 2 * extra)
            out[at : at + size] = row + np.uint32(low)
    return out


# ---- encoding ---------------------------------------------------------------------------------------------------


class _Cache(dict):
    """Keys -> what ``make`` makes of them, in two generations of about ``size`` entries: what is used again moves to the
    newer one, and when that is full the older one goes. So what comes often stays."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


#: What a tokenizer file must say for its words to be looked up one by one. Such a tokenizer drops white
#: space and looks at nothing across it, so a text's ids are its words' ids in turn.
WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts of such characters alone (ASCII and Latin-1 letters, each its own NFC form and lower-cased by itself) are cut into
#: the tokenizer's pieces here; in others, each word is left to the tokenizer.
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*\Z").match
_PIECES = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s0-9a-z\u00DF-\u00F6\u00F8-\u00FF]+").findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + rest.index(b)) for b in rest}


class _Encoder:
    """Texts -> ids. Most pieces come again and again: they are looked up, new ones are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        steps = (said["normalizer"] or {}).get("normalizers", [])
        cut = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (
            [x["type"] for x in steps] == WORD_NORMALIZER and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": WORD_PATTERN} and cut[0]["invert"]
            and cut[0]["behavior"] == "Removed" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
            and said["post_processor"] is None and not any(x["lstrip"] or x["rstrip"] for x in said["added_tokens"])
        )
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words, self.pieces = _Cache(CACHED_WORDS, self._new_word), _Cache(CACHED_PIECES, self._new_piece)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new_word(self, word: str) -> bytes:
        return self._whole([word])[0].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        out, pieces, words = [], self.pieces.__getitem__, self.words.__getitem__
        for t in texts:
            simple = _SIMPLE(t) and "<|" not in t
            found = map(pieces, _PIECES(t.lower())) if simple else map(words, t.replace("\n", " ").split(" "))
            out.append(np.frombuffer(b"".join(found), "<u4"))
        self.pieces.turn()
        self.words.turn()
        return out


def _worker_encoder(path: str) -> _Encoder:
    """The worker's encoder: Spark uses a Python worker for many tasks, and what one has looked up serves the next."""
    held = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders")).__dict__
    if path not in held:
        held[path] = _Encoder(path)
    return held[path]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _encoder(tokenizer: str, end_id: int):
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = _worker_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        first, segment, size, held, docs = 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            row = [[shard], [segment], [first], [size], [docs], [[len(x) for x in held]], [pack(np.concatenate(held))]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for doc_ids, texts in _chunks(batches):
            for doc_id, ids in zip(doc_ids, words.encode(texts), strict=True):
                docs.append(doc_id)
                held.append(np.concatenate([ids, end]))
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield close()
                    first, segment, size, held, docs = first + size, segment + 1, 0, [], []
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, order: list[Column] | None = None, end_id: int = END_ID) -> str:
    """Encode ``text`` of each row, append ``end_id``, and write the token folder ``path``, in the order of ``order``
    (default: ``doc_id``, nulls first). ``tokenizer``: a file of the tokenizers library that all executors have.

    Rows are dealt by ranges of the order and sorted within them. Ties go by the text's hash, then by the row's place in
    its input partition, so that no value, however frequent, lands in one task. Null text counts as empty and has
    the end id alone; repeated rows are encoded each; an empty table gives an empty folder.
    """
    keys = [F.col("doc_id")] if order is None else order
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *(k.alias(f"_o{i}") for i, k in enumerate(keys)))
    d = d.withColumn("_h", F.xxhash64("text")).withColumn("_i", F.monotonically_increasing_id())
    by = [*(f"_o{i}" for i in range(len(keys))), "_h", "_i"]
    d = d.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    d.mapInArrow(_encoder(tokenizer, end_id), SEGMENTS).write.parquet(path)
    return path


def file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_file`` and ``_place``, by which rows of written Parquet files stand as they were written."""
    return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))


def _decoder(make, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, lengths, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, lengths = unpack(payload.as_py()), np.array(lengths.as_py())
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                values = [doc_ids.as_py(), first.as_py() + ends - lengths, lengths, make(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return run


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The folder's segments, with the number of ids before each in ``first``: a shard's are known once all shards'
    sizes are (a row for each writing task, summed up before they meet)."""
    d = spark.read.schema(SEGMENTS).parquet(path)
    sizes = d.groupBy("shard").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(small(sizes.select("shard", before.alias("before"))), "shard").select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "lengths", "payload")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return _segments(spark, path).mapInArrow(_decoder(list, schema), "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of its ids as
    little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    crc = lambda parts: [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
    return _segments(spark, path).mapInArrow(_decoder(crc, schema), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
