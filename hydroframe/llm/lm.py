"""LM scoring: a gated recurrent language model in numpy, with a class-factored softmax over its output.

Words are counted over the whole corpus. The vocabulary grows with it: the most frequent words, ``VOCABULARY`` times the square root of
the number of distinct words, are outputs of their own, in classes whose number is the square root of that. All other words are outputs
by their form (their ending and the sign after it): the model predicts the form from context, and within a form a word
has its share of the form's tokens. So every word has context, and every text a probability. Training grows with the corpus: all training
documents are dealt to rounds and workers, each worker trains the model on its own by truncated backpropagation, and weights and moments
are averaged, round by round. Scoring carries the state from window to window through a whole document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import scratch, text_of, unit_hash, written

#: Known words by square root of the corpus' distinct words; width of the state.
VOCABULARY, HIDDEN = 2.0, 16
#: The end; after it come the forms of all other words, then the known words.
END = 0
#: Forms that are told apart when words are counted; the most frequent ones are outputs of their own, the others share some.
#: Form outputs by square root of the known words.
FORMS, FORM_OUTPUTS = 1024, 4.0
#: The end's place among the words; no word has a space.
END_WORD = b" "
#: Rounds of averaging at least, tokens that a worker takes a round, and how rounds grow with the number of such portions:
#: a round is a job that waits for the one before, the workers of a round run side by side.
ROUNDS, WORKER_TOKENS, ROUNDS_POWER = 2, 800_000, 0.4
STREAMS, WINDOW, RATE, CLIP = 512, 16, 0.03, 1.0
#: Characters of text in a bucket, whose words' counts are held at once, and tokens that are scored at once.
BUCKET_CHARS, SCORE_TOKENS = 8_000_000, 2_000_000
#: Pieces in which the workers' weights are averaged.
PIECES = 64
SEED = 11


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after the other, and how many each has: A-Z lower-cased, split at ASCII white space."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, lengths = found.flatten().cast(pa.binary()), pc.list_value_length(found).to_numpy()
    real = pc.binary_length(flat).to_numpy() > 0  # white space at a text's ends leaves empty words
    if not real.all():
        lengths = np.diff(np.cumsum(np.append(0, real))[np.cumsum(np.append(0, lengths))])
        flat = flat.filter(pa.array(real))
    return flat, lengths


def words(text: str) -> list[bytes]:
    """A text's words, and the end."""
    return [*split(pa.array([text], pa.string()))[0].to_pylist(), END_WORD]


def numbers(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, in order, and each word's place among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _letters(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, end to end, and where each word starts, with the last one's end."""
    _, at, data = found.buffers()
    at = np.frombuffer(at, np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def part_of(found: pa.Array, parts: int) -> np.ndarray:
    """A part for each word, by a hash of its bytes."""
    data, at = _letters(found)
    sizes = np.diff(at)
    powers = np.multiply.accumulate(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(at[:-1], sizes)], at[:-1])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


_IS_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def forms_of(found: pa.Array) -> np.ndarray:
    """The words' forms: the last two bytes before a word's closing signs, and the first of these."""
    if not len(found):
        return np.zeros(0, np.int64)
    data, at = _letters(found)
    last = np.maximum.reduceat(np.where(_IS_SIGN[data], -1, np.arange(len(data))), at[:-1])  # of the core; -1: signs alone
    last = np.where(last < at[:-1], at[:-1] - 1, last)
    three = np.zeros(len(found), np.int64)
    for i in (-1, 0, 1):  # each byte and one, 0 where there is none
        own = last + i
        there = (own >= at[:-1]) & (own < at[1:])
        three = 257 * three + np.where(there, data[np.where(there, own, 0)].astype(np.int64) + 1, 0)
    seen, places = np.unique(three, return_inverse=True)
    byte = lambda n: bytes([n - 1]) if n else b""
    return np.array([crc32(byte(x // 257**2) + byte(x // 257 % 257) + b" " + byte(x % 257)) % FORMS for x in seen.tolist()], np.int64)[places]


def form(word: bytes) -> int:
    return int(forms_of(pa.array([word], pa.binary()))[0])


# ---- the model --------------------------------------------------------------------------------------------------


def layout(classes: np.ndarray) -> dict[str, tuple[int, ...]]:
    n, h = len(classes), HIDDEN
    return {"x": (n, 3 * h), "u": (h, 3 * h), "c": (h + 1, int(classes.max()) + 1), "w": (n, h + 1)}


class Model:
    """Parameters as one vector: ``x`` input table by word, ``u`` recurrence, ``c`` classes, ``w`` words in their class.

    States and gates have a row a token and lie in memory column by column (Fortran order): so the gates are parts without gaps,
    and sums and maxima over classes run along whole rows of tokens. Numpy is several times as fast that way.
    """

    def __init__(self, classes: np.ndarray, values: np.ndarray):
        self.classes, self.values = classes, values.astype(np.float32)
        ends = np.searchsorted(classes, np.arange(int(classes.max()) + 2))  # a class is a run of words
        self.members = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        self.place = np.arange(len(classes)) - ends[classes]
        self.parts = self.split(self.values)

    def split(self, values: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in layout(self.classes).items():
            out[name] = values[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def steps(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from state ``h`` on words ``x``: the gates and the new state."""
        n = HIDDEN
        a, b = np.asfortranarray(self.parts["x"].take(x, 0)), (self.parts["u"].T @ h.T).T
        b[:, : 2 * n] += a[:, : 2 * n]
        zr, m = b[:, : 2 * n], b[:, 2 * n :]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.divide(1, zr, out=zr)
        z, r = zr[:, :n], zr[:, n:]
        c = r * m
        c += a[:, 2 * n :]
        np.tanh(c, out=c)
        after = h - c
        after *= z
        after += c
        return z, r, m, c, after

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]], np.ndarray]:
        """Places of ``y`` in order of their classes, each class of several words that occurs (its places, its words), and by place
        the word's number in its class."""
        k = self.classes[y]
        order = np.argsort(k.astype(np.uint16) if len(self.members) <= 1 << 16 else k, kind="stable")  # short numbers are sorted by radix
        ends = np.cumsum(np.bincount(k, minlength=len(self.members))).tolist()
        runs = [(slice(a, b), m) for a, b, m in zip([0, *ends], ends, self.members, strict=False) if b > a and m.stop - m.start > 1]
        return order, runs, self.place[y[order]]

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of words ``y`` after states ``h``."""
        rows = _with_ones(h)
        logits = self.parts["c"].T @ rows
        out = logits[self.classes[y], np.arange(len(y))]
        out -= _logsum(logits)
        order, runs, places = self.by_class(y)
        rows, inner = np.ascontiguousarray(rows.T).take(order, 0), np.zeros_like(out)  # a class is a part without gaps
        for at, own in runs:
            logits = self.parts["w"][own] @ rows[at].T
            inner[at] = logits[places[at], np.arange(logits.shape[1])]
            inner[at] -= _logsum(logits)
        out[order] += inner
        return out

    def gradient(self, xs: np.ndarray, ys: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss a token, its gradient over one window (``xs``, ``ys``: steps by streams) from the carried state, and the state after it."""
        n, steps, hs = HIDDEN, [], []
        goes = (xs != END).astype(h.dtype)[:, :, None]  # a document starts from nothing
        for x, on in zip(xs, goes, strict=True):
            before = h * on
            z, r, m, c, h = self.steps(x, before)
            steps.append((before, z, r, m, c))
            hs.append(h.T)
        rows, y = _with_ones(np.concatenate(hs, axis=1).T), ys.ravel()
        grads = np.zeros_like(self.values)
        g, p = self.split(grads), self.parts
        prob = p["c"].T @ rows
        mine = (self.classes[y], np.arange(len(y)))
        loss = -np.log(_softmax(prob)[mine]).sum()
        prob[mine] -= 1
        g["c"][:] = rows @ prob.T
        dh = p["c"][:-1] @ prob
        order, runs, places = self.by_class(y)
        rows = np.ascontiguousarray(rows.T).take(order, 0)  # a class is a part without gaps
        back = np.zeros((len(y), n), h.dtype)
        for at, own in runs:
            w, seen = p["w"][own], rows[at]
            q = w @ seen.T
            mine = (places[at], np.arange(q.shape[1]))
            loss -= np.log(_softmax(q)[mine]).sum()
            q[mine] -= 1
            g["w"][own] = q @ seen
            back[at] = q.T @ w[:, :-1]
        places = np.empty_like(order)
        places[order] = np.arange(len(order))
        dh += np.asfortranarray(back.take(places, 0)).T
        dh, later = np.ascontiguousarray(dh.reshape(n, *xs.shape).transpose(1, 0, 2)), 0
        da = np.empty((len(xs), 3 * n, xs.shape[1]), h.dtype)
        for t in range(len(xs) - 1, -1, -1):
            before, z, r, m, c = steps[t]
            d, gates = dh[t].T + later, da[t].T
            rest = d * (1 - z)
            dc = rest * (1 - c * c)
            gates[:, :n] = rest * (before - c) * z
            gates[:, n : 2 * n] = dc * m * r * (1 - r)
            gates[:, 2 * n :] = dc
            db = gates.copy("K")
            db[:, 2 * n :] *= r
            g["u"] += before.T @ db
            later = (p["u"] @ db.T).T
            later += d * z
            later *= goes[t]
        x = xs.ravel()
        g["x"][:] = np.array([np.bincount(x, gate, len(self.classes)) for gate in da.transpose(1, 0, 2).reshape(3 * n, -1)]).T
        grads /= len(y)
        return float(loss) / len(y), grads, h

    def train(self, ids: np.ndarray, moments: np.ndarray | None = None, steps: int = 0) -> float:
        """One pass over a stream of documents (each ends with END), cut into parallel streams; the last loss a token.

        ``moments``: first and second moments of the gradient (two rows), updated in place, after ``steps`` steps.
        """
        width = min(STREAMS, max(1, len(ids) // (2 * WINDOW)))
        length = len(ids) // width
        if not length:
            return math.nan
        y = ids[: width * length].reshape(width, length).T
        x = np.concatenate([np.full((1, width), END), y[:-1]])
        x[0, 1:] = y[-1, :-1]
        h, loss = np.zeros((width, HIDDEN), np.float32, "F"), math.nan
        first, second = np.zeros((2, len(self.values)), np.float32) if moments is None else moments
        for i, t in enumerate(range(0, length, WINDOW), steps + 1):
            loss, grad, h = self.gradient(x[t : t + WINDOW], y[t : t + WINDOW], h)
            grad *= min(1.0, CLIP / (float(np.linalg.norm(grad)) + 1e-9))
            first *= 0.9
            first += 0.1 * grad
            grad *= grad
            second *= 0.999
            second += 0.001 * grad
            np.sqrt(second, out=grad)
            grad += 1e-8 * math.sqrt(1 - 0.999**i)
            np.divide(first, grad, out=grad)
            grad *= RATE * math.sqrt(1 - 0.999**i) / (1 - 0.9**i)
            self.values -= grad
        return loss

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of the probability of each whole document: all go on together, window by window, the
        longest first, so that those still going on are the first ones."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[i]) for i in order])
        flat = np.concatenate([docs[i] for i in order])
        starts = np.cumsum(lengths) - lengths
        total, h, x = np.zeros(len(docs)), np.zeros((len(docs), HIDDEN), np.float32, "F"), np.full(len(docs), END)
        kept: list[tuple[np.ndarray, np.ndarray, int]] = []
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # documents longer than t
        for t, k in enumerate(active):
            h = self.steps(x[:k], h[:k])[-1]
            x = flat[starts[:k] + t]
            kept.append((h, x, k))
            if len(kept) == 256 or k * len(kept) >= 1 << 14 or t + 1 == len(active):
                p = self.log_probability(np.concatenate([a.T for a, _, _ in kept], axis=1).T, np.concatenate([b for _, b, _ in kept]))
                at = 0
                for _, _, n in kept:
                    total[:n] += p[at : at + n]
                    at += n
                kept = []
        out = np.zeros(len(docs))
        out[order] = total
        return out


def _with_ones(h: np.ndarray) -> np.ndarray:
    """States as columns, with a row of ones below that takes the biases."""
    out = np.ones((h.shape[1] + 1, len(h)), h.dtype)
    out[:-1] = h.T
    return out


def _logsum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the columns' sums of exponentials; ``x`` is overwritten."""
    top = x.max(axis=0)
    x -= top
    np.exp(x, out=x)
    return top + np.log(_sums(x))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns."""
    return np.ones(len(x), x.dtype) @ x


def _softmax(x: np.ndarray) -> np.ndarray:
    """Each column's probabilities, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= 1 / _sums(x)
    return x


def classes_of(counts: np.ndarray, forms: int = 1) -> np.ndarray:
    """END is a class of its own; forms and known words, each most frequent first, fill classes of one sum of square roots, as
    many as the square root of their number."""
    out = np.zeros(len(counts), np.int64)
    for at in (slice(1, 1 + forms), slice(1 + forms, None)):
        if len(own := counts[at]):
            most = max(1, math.isqrt(len(own)))
            root = np.cumsum(np.sqrt(np.maximum(own, 1)))
            out[at] = out.max() + 1 + np.unique(np.minimum(root / root[-1] * most, most - 1).astype(int), return_inverse=True)[1]
    return out


def initial(counts: np.ndarray, forms: int = 1) -> Model:
    """Small random weights; the output starts as the words' frequencies."""
    classes = classes_of(counts, forms)
    size = sum(math.prod(s) for s in layout(classes).values())
    model = Model(classes, np.random.default_rng(SEED).normal(0, 0.1, size))
    share = np.log(np.maximum(counts, 0.1))
    model.parts["w"][:, -1] = share
    model.parts["w"][:, :-1] *= 0.3
    model.parts["c"][-1] = [np.log(np.exp(share[m]).sum()) for m in model.members]
    return model


# ---- tasks ------------------------------------------------------------------------------------------------------

_WORDS = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_WORDS_SQL = "bucket bigint, part bigint, words binary, counts binary"


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Runs of rows with one key."""
    return groupby((row for b in batches for i in range(0, b.num_rows, 64) for row in b.slice(i, 64).to_pylist()), lambda r: r[key])


def _pieces(b: pa.RecordBatch, keys: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with one key and about ``BUCKET_CHARS`` characters of text at most (one text may be longer)."""
    chars = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64) // BUCKET_CHARS
    cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (chars[1:] != chars[:-1])) + 1
    for i, j in pairwise([0, *cuts.tolist(), len(keys)]):
        if j > i:
            yield int(keys[i]), b.slice(i, j - i)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of rows with one key, in pieces."""
    for k, own in groupby((x for b in batches for x in _pieces(b, b.column(key).to_numpy())), itemgetter(0)):
        yield k, map(itemgetter(1), own)


def _words(blob: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([blob], pa.binary()), "\n").flatten()


def _read(row: dict) -> tuple[pa.Array, np.ndarray]:
    return _words(row["words"]), np.frombuffer(row["counts"], "<i8")


def _counted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by bucket -> the bucket's distinct words with their counts in training documents, by part."""
        for bucket, pieces in _runs(batches, "bucket"):
            found, total = pa.array([END_WORD], pa.binary()), np.zeros(1, np.int64)
            for b in pieces:
                flat, lengths = split(b.column("text"))
                trained = ~b.column("held_out").to_numpy(zero_copy_only=False)
                own, places = numbers(flat)
                n = np.bincount(places[np.repeat(trained, lengths)], minlength=len(own))
                total[0] += trained.sum()
                if len(found) > 1:
                    found, total, _ = _merged([(found, total), (own, n)])
                else:  # the end is no word of a text
                    found, total = pa.concat_arrays([found, own]), np.concatenate([total, n])
            part = part_of(found, parts)
            order = np.argsort(part, kind="stable")
            sizes = np.bincount(part, minlength=parts)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found.take(pa.array(order)))
            blobs, total = pc.binary_join(lists, b"\n").to_pylist(), total[order].astype("<i8")
            own = np.flatnonzero(sizes).tolist()
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "part": p, "words": blobs[p], "counts": total[ends[p] - sizes[p] : ends[p]].tobytes()} for p in own], _WORDS)

    return run


def _merged(read: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words with the sums of their counts, and the places of all words among these."""
    found, places = numbers(pa.concat_arrays([x for x, _ in read]))
    total = np.zeros(len(found), np.int64)
    np.add.at(total, places, np.concatenate([n for _, n in read]))
    return found, total, places


def _summed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Words by part -> the same rows with the counts of the whole corpus, and for each part a row without bucket: its
    words that may be among the most frequent of all (words are dealt to parts by hash, so a part has about its share of all
    distinct words), and by form the tokens (``b" t<form>"``) and the distinct words (``b" d<form>"``) in training documents."""
    for part, group in _rows(batches, "part"):
        rows = [*group]
        read = [_read(r) for r in rows]
        found, total, places = _merged(read)
        at = 0
        for r, (x, _) in zip(rows, read, strict=True):
            own = total[places[at : at + len(x)]]
            at += len(x)
            yield pa.RecordBatch.from_pylist([{"bucket": r["bucket"], "part": part, "words": r["words"], "counts": own.astype("<i8").tobytes()}], _WORDS)
        found, total = found.filter(pa.array(total > 0)), total[total > 0]
        most = 64 + math.ceil(2 * VOCABULARY * math.sqrt(parts * len(found)))
        no_end = pc.not_equal(found, pa.scalar(END_WORD, pa.binary())).to_numpy(zero_copy_only=False)
        top = np.lexsort((-total, no_end))[:most]
        forms, (tokens, distinct) = forms_of(found), np.zeros((2, FORMS), np.int64)
        np.add.at(tokens, forms, total)
        np.add.at(distinct, forms, 1)
        sums = [(b" %s%d" % (name, f), by[f]) for name, by in ((b"t", tokens), (b"d", distinct)) for f in np.flatnonzero(by).tolist()]
        if not len(found):
            continue
        blob = b"\n".join([*found.take(pa.array(top)).to_pylist(), *(w for w, _ in sums)])
        counts = np.array([*total[top], *(n for _, n in sums)], "<i8").tobytes()
        yield pa.RecordBatch.from_pylist([{"bucket": None, "part": part, "words": blob, "counts": counts}], _WORDS)


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without bucket -> their words and sums."""
    for _, rows in _rows(batches, "part"):
        for r in rows:
            found, n = _read(r)
            yield pa.RecordBatch.from_arrays([found, pa.array(n, pa.int64())], ["word", "n"])


class Outputs:
    """Words -> the model's outputs: the end, known words, and forms by ``of_form``."""

    def __init__(self, known: dict[bytes, int], of_form: list[int]):
        self.known, self.of_form = known, np.array(of_form, np.int64)
        self.names, self.ids = pa.array([*known], pa.binary()), np.array([*known.values()], np.int64)

    def __call__(self, found: pa.Array | list[bytes]) -> np.ndarray:
        found = found if isinstance(found, pa.Array) else pa.array(found, pa.binary())
        place = pc.fill_null(pc.index_in(found, self.names), -1).to_numpy()
        return np.where(place < 0, self.of_form[forms_of(found)], self.ids[place])


def _numbered(outputs: Outputs, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> their words' outputs."""
        for whole in batches:
            for _, b in _pieces(whole, np.zeros(whole.num_rows, np.int8)):
                flat, lengths = split(b.column("text"))
                found, places = numbers(flat)
                ends = np.cumsum(lengths)
                ids = np.insert(outputs(found).astype(kind)[places], ends, END)
                texts = [x.tobytes() for x in np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1])]
                yield pa.RecordBatch.from_arrays([b.column("round"), b.column("worker"), b.column("u"), pa.array(texts, pa.binary())], ["round", "worker", "u", "ids"])

    return run


def _kind(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _trained(classes: np.ndarray, state: np.ndarray, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A worker's documents -> weights and moments after them, in pieces."""
        rows = [(r["worker"], r["u"], r["ids"]) for _, own in _rows(batches, "worker") for r in own]
        if rows:
            own = state.copy()
            model = Model(classes, own[0])
            model.train(np.frombuffer(b"".join(ids for _, _, ids in sorted(rows)), _kind(len(classes))).astype(np.int64), own[1:], steps)
            own[0] = model.values
            pieces = np.array_split(own, PIECES, axis=1)
            yield pa.RecordBatch.from_pydict({"worker": pa.array([rows[0][0]] * PIECES, pa.int32()), "piece": pa.array(range(PIECES), pa.int32()), "weights": pa.array([x.tobytes() for x in pieces], pa.binary())})

    return run


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean of the workers' pieces, in order of the workers, so that it is the same however they come."""
    rows = rows.sort_values("worker")
    mean = np.mean([np.frombuffer(w, np.float32) for w in rows["weights"]], axis=0, dtype=np.float64)
    return pd.DataFrame({"piece": rows["piece"].iloc[:1], "weights": [mean.astype(np.float32).tobytes()]})


class Language:
    """What was gathered from the corpus: the model and what it calls words, and the sums that scoring needs.
    ``form_tokens`` and ``form_types``: tokens and distinct words by form output, without known words."""

    def __init__(self, model: Model, outputs: Outputs, tokens: int, types: int, form_tokens: np.ndarray, form_types: np.ndarray):
        self.model, self.outputs, self.tokens, self.types, self.form_tokens, self.form_types = model, outputs, tokens, types, form_tokens, form_types

    def coverage(self) -> float:
        """Share of the training tokens that are outputs of their own."""
        return 1 - float(self.form_tokens.sum()) / max(1, self.tokens)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(m: Language):
    classes, values, outputs, tokens, types = m.model.classes, m.model.values, m.outputs, m.tokens, m.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket, the words' counts and then the documents -> the documents' scores."""
        model = Model(classes, values)
        in_form, all_forms = np.log10(m.form_tokens + 0.1 * (m.form_types + 1)), len(m.form_tokens)
        for _, pieces in _runs(batches, "bucket"):
            found, counts, held, size = [], [], [], 0

            def scores(held=held) -> pa.RecordBatch:
                ids, held_out, n_known, base_score, outside, docs = zip(*held, strict=True)
                model_scores = model.score(docs) / math.log(10)
                out = [ids, held_out, [len(d) for d in docs], n_known, base_score, [float(s + x) for s, x in zip(model_scores, outside, strict=True)]]
                return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _SCORES, strict=True)], schema=_SCORES)

            for b in pieces:
                counted = b.column("words").is_valid()
                for r in b.filter(counted).select(["words", "counts"]).to_pylist():
                    x, n = _read(r)
                    found.append(x)
                    counts.append(n)
                b = b.filter(pc.invert(counted))
                if not b.num_rows:
                    continue
                if counts:  # all words of the bucket have come
                    known, c, counts = pa.concat_arrays(found), np.concatenate(counts), []
                    ids = outputs(known)
                    base = np.log10((c + 0.1) / (tokens + 0.1 * (types + 1)))
                    rare = (ids > END) & (ids <= all_forms)
                    share = np.where(rare, np.log10(c + 0.1) - in_form[np.where(rare, ids - 1, 0)], 0.0)
                    end = int(np.flatnonzero(ids == END)[0])
                flat, lengths = split(b.column("text"))
                ends = np.cumsum(lengths)
                places = numbers(pa.concat_arrays([known, flat]))[1][len(known) :]  # all are known
                places = np.insert(places, ends, end)
                cuts = (ends + np.arange(1, len(ends) + 1))[:-1]
                by_text = [np.split(x[places], cuts) for x in (c > 0, base, share, ids)]
                for i, h, known_, base_, share_, doc in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), *by_text, strict=True):
                    held.append((i, h, int(known_.sum()), float(base_.sum()), share_.sum(), doc))
                    size += len(doc)
                    if size >= SCORE_TOKENS:
                        yield scores()
                        held.clear()
                        size = 0
            if held:
                yield scores()

    return run


# ---- jobs -------------------------------------------------------------------------------------------------------


def _buckets(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with ``held_out`` and a ``bucket`` by id and text; there are buckets for ``BUCKET_CHARS`` characters each."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    chars = d.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BUCKET_CHARS))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return d.select("doc_id", "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("bucket")), n


def _dealt(docs: DataFrame, outputs: Outputs, kind: str, rounds: int, workers: int, tasks: int) -> DataFrame:
    """The documents' words as numbers, each document in one round and with one worker; a folder a round, so that a round
    reads its own documents alone. ``tasks`` tasks write, each some workers of one round."""
    slot = lambda seed, n: F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(n)).cast("int")
    d = docs.select(slot(SEED, rounds).alias("round"), slot(SEED + 1, workers).alias("worker"), unit_hash(F.col("doc_id"), seed=SEED).alias("u"), "text")
    d = d.mapInArrow(_numbered(outputs, kind), "round int, worker int, u double, ids binary")
    d = d.repartition(tasks, "round", F.pmod("worker", F.lit(max(1, tasks // rounds))))
    path = scratch(docs.sparkSession, "train")
    d.write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(d.schema).parquet(path)


def _vocabulary(counted: DataFrame) -> tuple[Outputs, np.ndarray, int, int, np.ndarray, np.ndarray]:
    """Outputs and their counts, tokens and distinct words of the training documents, and tokens and words by form output."""
    top = counted.where("bucket IS NULL").mapInArrow(_unfolded, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = written(top, "top")
    is_sum = F.substring("word", 1, 1) == F.lit(b" ")
    form_tokens, form_types, ends = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64), 0
    for r in top.where(is_sum).collect():  # two rows a form, and the end
        name = bytes(r["word"])
        if name == END_WORD:
            ends = r["n"]
        else:
            (form_tokens if name[1:2] == b"t" else form_types)[int(name[2:])] = r["n"]
    tokens, types = int(form_tokens.sum()), int(form_types.sum())
    size = math.ceil(VOCABULARY * math.sqrt(types))
    best = top.where(~is_sum).orderBy(F.desc("n"), "word").limit(size).collect()
    for w, n in [*((bytes(r["word"]), r["n"]) for r in best), *([(END_WORD, ends)] if ends else [])]:
        form_tokens[form(w)] -= n
        form_types[form(w)] -= 1
    forms = max(1, int(FORM_OUTPUTS * math.sqrt(size)))
    own = max(1, forms * 3 // 4)  # the most frequent forms; the others are dealt to the rest by hash
    order = np.argsort(-form_tokens, kind="stable")
    of_form = np.zeros(FORMS, np.int64)
    of_form[order[:own]] = np.arange(min(own, FORMS))
    of_form[order[own:]] = own + order[own:] % (forms - own) if forms > own else 0
    counts = np.zeros(1 + forms + len(best))
    counts[END], counts[1 + forms :] = ends, [r["n"] for r in best]
    by_output = [np.bincount(of_form, x, forms) for x in (form_tokens, form_types)]
    counts[1 : 1 + forms] = by_output[0]
    known = {bytes(r["word"]): i for i, r in enumerate(best, 1 + forms)} | {END_WORD: END}
    return Outputs(known, (1 + of_form).tolist()), counts, tokens, types, *by_output


def learn(docs: DataFrame, n: int) -> tuple[Language, DataFrame]:
    """Counts all words of all buckets, then fits the model to all training documents, each once; also returns each
    bucket's counted words."""
    d, parts = docs.repartition(n, "bucket").sortWithinPartitions("bucket").select("bucket", "held_out", "text"), max(8, n)
    counted = d.mapInArrow(_counted(parts), _WORDS_SQL).repartition(parts, "part").sortWithinPartitions("part")
    counted = written(counted.mapInArrow(lambda b: _summed(b, parts), _WORDS_SQL), "counted")
    outputs, counts, tokens, types, form_tokens, form_types = _vocabulary(counted)
    model = initial(counts, len(form_tokens))
    rounds = max(ROUNDS, math.ceil((tokens / WORKER_TOKENS) ** ROUNDS_POWER))
    workers = max(1, math.ceil(tokens / rounds / WORKER_TOKENS))
    train = _dealt(docs.where(~F.col("held_out")), outputs, _kind(len(counts)), rounds, workers, max(n, rounds))
    state, steps = np.stack([model.values, *np.zeros((2, len(model.values)), np.float32)]), 0
    for k in range(rounds):
        done = train.where(F.col("round") == k).repartitionById(workers, "worker").mapInArrow(_trained(model.classes, state, steps), "worker int, piece int, weights binary")
        mean = done.groupBy("piece").applyInPandas(_averaged, "piece int, weights binary").collect()
        if mean:
            state = np.concatenate([np.frombuffer(r["weights"], np.float32).reshape(3, -1) for r in sorted(mean, key=lambda r: r["piece"])], axis=1)
            steps += math.ceil(tokens / rounds / workers / STREAMS / WINDOW)
    return Language(Model(model.classes, state[0]), outputs, tokens, types, form_tokens, form_types), counted


def scores(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Rows whose crc32 of the id (as text; null: empty) is a multiple of 10 are held out of all learning. Texts are dealt to
    buckets by id and text, and each bucket's distinct words travel, not its tokens: to be counted with the other buckets'
    and back. Null and empty texts are an end alone; repeated rows are scored each; an empty table gives an empty result.
    """
    d, n = _buckets(docs)
    m, counted = learn(d, n)
    none = lambda kind: F.lit(None).cast(kind)
    rows = counted.where("bucket IS NOT NULL").select("bucket", F.lit(0).alias("kind"), "words", "counts", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    rows = rows.unionByName(d.select("bucket", F.lit(1).alias("kind"), none("binary").alias("words"), none("binary").alias("counts"), "doc_id", "held_out", "text"))
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    out = rows.mapInArrow(_scored(m), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
