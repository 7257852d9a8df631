"""N-gram Jaccard join by parity sketches: all pairs of texts whose sets of 5-word shingles have a Jaccard similarity of
0.75 or more, as connected components.

A parity sketch deals a set's shingles to cells by hash and keeps the XOR of each cell. Shingles in both sets cancel out,
so the number of cells in which two sketches differ is at most the size of the sets' symmetric difference, and for
two sets of a and b shingles with that similarity this is at most ``(a + b) / 7``. Sketches are used at three widths:

* with wide cells, to find the sets that may have a partner: pigeonhole says that two such sets with more than ``(a + b) / 7`` non-empty
  cells have all others alike. A set is filed under all its non-empty cells, per band of sizes (one near a band's lower end is
  filed in the one below, too), and is a candidate if more of them than it can do without hold another set, too;
* with the widest cells, of one shingle each, to pair the candidates: sorted by how many candidates have them, the rarest
  cell that two linked sets have in common stands early in both (``_open``), or they could not have enough in common;
* with one-bit cells, to rule pairs out: the Hamming distance must not be over the bound.

What is left is verified shingle by shingle. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.llm.common import small, text_of, written

WORDS = 5
#: Each cell's sets are held against one of them, round by round, as long as a round settles this share of the rows or of the components.
SETTLED = 0.1
#: Portions that the partners of one text are dealt to; the text goes with each portion that has some.
SALTS = 4096

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all its words, if they are fewer than five."""
    from xxhash import xxh64_intdigest

    words = text.encode(errors="surrogatepass").lower().split()  # of bytes: A-Z alone, and ASCII white space
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    size = min(WORDS, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _M1 + w[i : len(w) - size + 1 + i])
    return np.unique(out)


def bound(a: int, b: int) -> int:
    """Most shingles in just one of two linked sets of a and b shingles."""
    return (a + b) // 7


def cells(found: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
    """By band of sizes: the keys under which a set is filed, and in how many of them it can do without a partner.

    A band has cells for five quarters of its least size, so that a frequent shingle mostly shares its cell with others. (Sets
    of a band have half as many non-empty cells again as they need, but for a chance under that of a hash collision;
    small sets have a cell for each shingle.)
    """
    n, out = len(found), []
    band = n.bit_length() - 1
    for k in (band, band - 1) if 3 * n < 4 << band and band else (band,):
        partner = n * 4 // 3 if k == band else min(n, (2 << k) - 1)
        m = np.uint64(4096 if k <= 6 else 5 << k >> 2)
        cell = (_mix(found + np.uint64(k)) >> np.uint64(20)) % m
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=m))
        value = np.bitwise_xor.reduceat(found[order], first)
        key = _mix(_mix(value) + cell[order[first]]) >> np.uint64(16) | np.uint64(k << 48)
        out.append((k, key.astype(np.int64), len(first) - bound(n, partner) - 1))
    return out


def bits(found: np.ndarray) -> bytes:
    """One-bit cells, twice to four times as many as shingles."""
    size = max(64, 2 << len(found).bit_length())
    return np.packbits((np.bincount((found >> np.uint64(7)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded to the size of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


# ---- tasks ------------------------------------------------------------------------------------------------------


def _set_id(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes()) - (1 << 63)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> doc_id, h, n, node, sketch; a set that this task has had before gets no sketch again."""
    seen: set[int] = set()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for text in part.column(2):
                found = shingles(text.as_py())
                if not len(found):
                    rows.append((0, None, None))
                elif (node := _set_id(found)) in seen:
                    rows.append((len(found), node, None))
                else:
                    seen.add(node)
                    rows.append((len(found), node, bits(found)))
            data = [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(data, ["doc_id", "h", "n", "node", "sketch"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> node, key, room: a row for each cell of each set that this task has not had before, with the number of
    cells of its band that the set can do without."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
            for text in batch.slice(at, 256).column(0):
                found = shingles(text.as_py())
                if len(found) and (node := _set_id(found)) not in seen:
                    seen.add(node)
                    for _, key, room in cells(found):
                        out.append((np.full(len(key), node), key, np.full(len(key), room, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "key", "room"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, n, keys: the set's shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *found]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, found)), pa.int64()), lists], ["node", "n", "keys"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and sketches -> those whose sketches are near enough."""
    for batch in batches:
        a, b, n, m, s, t = (batch.column(i).to_pylist() for i in range(6))
        keep = [i for i in range(len(a)) if distance(s[i], t[i]) <= bound(n[i], m[i])]
        yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of group, role, node and text, sorted: each group's hub comes first, its partners after it."""
    group, hub, at = None, np.zeros(0, np.uint64), None
    for batch in batches:
        a, b = [], []
        for key, salt, role, node, text in zip(*(batch.column(i) for i in range(5)), strict=True):
            found = shingles(text.as_py())
            if not role.as_py():
                group, hub, at = (key.as_py(), salt.as_py()), found, node.as_py()
            elif (key.as_py(), salt.as_py()) == group and linked(hub, found):
                a.append(at)
                b.append(node.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# ---- jobs -------------------------------------------------------------------------------------------------------


def filed(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return written(d.mapInArrow(_file, "doc_id bigint, h bigint, n int, node bigint, sketch binary"), "filed")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) among candidate pairs of sets: sketches first, then the texts of those left."""
    of = lambda p: sets.select(F.col("node").alias(p), F.col("n").alias(f"n_{p}"), F.col("sketch").alias(f"s_{p}"))
    p = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    p = p.where("4 * n_a >= 3 * n_b AND 4 * n_b >= 3 * n_a")
    p = written(p.mapInArrow(_near, "a bigint, b bigint"), "near")
    p = p.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    member = p.select(F.col("a").alias("key"), "salt", F.lit(1).alias("role"), F.col("b").alias("node"))
    member = member.unionByName(p.select(F.col("a").alias("key"), "salt", F.lit(0).alias("role"), F.col("a").alias("node")).distinct())
    # a text may be in the table more than once under one id: the hub's row or a link then comes twice, to no effect
    m = _texts_of(docs, sets, member).select("key", "salt", "role", "node", "text")
    m = m.repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
    return written(m.mapInArrow(_verify, "a bigint, b bigint").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of all nodes with links.

    Each round, a node takes the least label around it and that of its own label, so that long chains halve; a round is one table.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = labels.join(around, "node").join(jump, "label", "left").select("node", F.col("label").alias("old"), F.least("label", "around", "next").alias("label"))
        new = written(new, "labels")
        if not new.where("label != old").take(1):
            return new.select("node", "label")
        labels = new.select("node", "label")


def _candidates(docs: DataFrame) -> DataFrame:
    """Sets (``node``) of which in some band more cells hold other sets, too, than they can do without. One shuffle of all
    cells; what comes back of it are the cells with more than one set, counted by set."""
    cell = Window.partitionBy("key")
    k = docs.select(text_of().alias("text")).mapInArrow(_cells, "node bigint, key bigint, room int")
    k = k.withColumns({"least": F.min("node").over(cell), "most": F.max("node").over(cell)}).where("least != most")
    k = k.groupBy("node", F.shiftright("key", 48).alias("band")).agg(F.count_distinct("key").alias("cells"), F.max("room").alias("room"))
    return written(k.where("cells > room").select("node").distinct(), "candidates")


def _texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (any columns, ``node`` among them) with a ``text`` of each node's set; a text that is in the table more
    than once under one id comes as often."""
    member = small(written(nodes.join(sets.select("node", F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "node"), "members"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    return d.join(member, F.col("h").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select(*nodes.columns, "text")


def _early(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingles of the candidate sets that may be the rarest one in common with a partner: ``key``, ``node``, ``n``, ``place``.

    ``place`` counts a set's shingles from 1, those of the fewest candidate sets first. Two linked sets of a and b shingles have
    at least ``3 (a + b) / 7`` in common, so of the one at most ``(4 a - 3 b) / 7`` stand before the rarest common one, a
    quarter of the set at most, as b is at least three quarters of a.
    """
    d = _texts_of(docs, sets, nodes).select("node", "text").mapInArrow(_listed, "node bigint, n bigint, keys array<bigint>")
    rows = written(d.dropDuplicates(["node"]), "listed").select("node", "n", F.explode("keys").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(often, "key")
    by_node = Window.partitionBy("node")
    before = F.col("n") - F.count("*").over(by_node)  # shingles that no other candidate has come first
    rows = rows.withColumn("place", before + F.row_number().over(by_node.orderBy("size", "key")))
    return written(rows.where("4 * (place - 1) <= n").select("key", "node", "n", "place"), "early")


def _open(met: DataFrame) -> DataFrame:
    """Of rows with ``label``, those that still may find a partner: the cell's smallest set is small enough for the row's
    place, and the cell has sets of several components."""
    least = met.groupBy("key").agg(F.min("n").alias("low"))
    met = met.join(least, "key").where("3 * low <= 4 * n - 7 * (place - 1)").drop("low")
    mixed = met.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l != m").select("key")
    return met.join(mixed, "key")


def _labelled(met: DataFrame, links: DataFrame) -> DataFrame:
    met = met.drop("label").join(small(components(links)), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return written(_open(met), "open")


def _left(met: DataFrame) -> tuple[int, int]:
    """Rows and components that are left."""
    return tuple(met.agg(F.count("*"), F.count_distinct("label")).first())


#: Whether rows a and b of one cell may be a linked pair of two components whose rarest common shingle this is.
_MAY_LINK = "label_a != label_b AND 3 * n_b <= 4 * n_a - 7 * (place_a - 1) AND 3 * n_a <= 4 * n_b - 7 * (place_b - 1)"


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    of = lambda d, p: d.select("key", *(F.col(c).alias(f"{c}_{p}") for c in ("node", "label", "n", "place")))
    return of(left, "a").join(of(right, "b"), "key").where(_MAY_LINK).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def links(docs: DataFrame, file: DataFrame) -> DataFrame:
    """Links enough to connect all sets that any links connect.

    In rounds, each cell's sets are held against one of them: the smallest first (if two sets of a cell are linked by
    what the cell's sets all have in common, so are both with the smallest), then the one in its middle, with the fewest shingles that are
    rarer than the cell's (all that are linked with most of a group of near copies are linked with that), then one picked by hash, another
    in each cell, so that a large group grows together wherever its middle is. Cells left with one component, and rows that can have no
    partner any more, go. When a round settles few rows and joins few components, all pairs that their places allow are candidates.
    """
    has = file.where(F.col("sketch").isNotNull())
    sets = has.groupBy("node").agg(F.min(F.struct("doc_id", "h", "n")).alias("d"), F.first("sketch").alias("sketch"))
    sets = written(sets.select("node", "d.*", "sketch"), "sets")
    met = _early(docs, sets, _candidates(docs))
    met = written(_open(met.withColumn("label", F.col("node"))), "open")
    found, k, (left, apart) = None, 0, _left(met)
    while k == 0 or left:
        order = [F.struct(-F.col("n"), -F.col("place"), "node"), F.struct(-F.col("place"), "n", "node"), F.struct(F.xxhash64("key", "node", F.lit(k)), "node")][min(k, 2)]
        hub = met.groupBy("key").agg(F.max_by(F.struct("node", "label", "n", "place"), order).alias("hub")).select("key", "hub.*")
        new = _verified(docs, sets, _pairs(hub, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = new if found is None else found.unionByName(new)
        met = _labelled(met, found)
        k, before, (left, apart) = k + 1, (left, apart), _left(met)
        if left > (1 - SETTLED) * before[0] and apart > (1 - SETTLED) * before[1]:
            break
    if not left:
        return found
    pairs = _pairs(met, met).where("a < b").distinct()
    return found.unionByName(_verified(docs, sets, pairs))


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, text hash ``h``, ``n_shingles``, ``label`` (null: no words), ``component_id`` (the
    least ``doc_id`` of all rows that links connect it with) and ``kept_h`` (with it, names the row that stands for all)."""
    file = filed(docs)
    label = components(links(docs, file))
    nodes = file.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("d"))
    nodes = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = written(nodes, "nodes")
    least = nodes.groupBy("label").agg(F.min("d").alias("least"))
    named = nodes.join(least, "label").select("node", "label", F.col("least.doc_id").alias("component_id"), F.col("least.h").alias("kept_h"))
    out = file.select("doc_id", "h", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "label", component.alias("component_id"), "kept_h")


def near_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    Null and empty texts have no shingles and are linked with nothing; rows alike in text are one set; null ids sort
    first, so a component with one has a null id; empty tables give an empty result.
    """
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least id, and all rows without words; all columns as they were."""
    c = written(classes(docs).select("doc_id", "h", "label", "component_id", "kept_h"), "classes")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("h").eqNullSafe(F.col("kept_h"))
    key = [F.col("doc_id").alias("_d"), F.col("h").alias("_h")]
    gone = small(written(c.where(F.col("label").isNotNull() & ~kept).select(*key).distinct(), "gone"))
    twice = small(written(c.where(F.col("label").isNotNull() & kept).groupBy(*key).count().where("count > 1").select("_d", "_h"), "twice"))
    d = docs.select(F.struct("*").alias("_row")).withColumn("_t", F.xxhash64(text_of("_row.text")))
    same = F.col("_t").eqNullSafe(F.col("_h")) & F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_d"))
    d = d.join(gone, same, "left_anti")
    if not twice.take(1):
        return d.select("_row.*")
    again = d.join(twice, same, "left_semi").withColumn("_d", F.col("_row.doc_id")).dropDuplicates(["_d", "_t"])
    return d.join(twice, same, "left_anti").select("_row.*").unionByName(again.select("_row.*"))
