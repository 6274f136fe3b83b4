"""Katz backoff language model of any order, scored over whole texts.

The corpus is cut into chunks of about ``chunk_tokens`` tokens where it is
read.  A chunk is stored once as its distinct words and a stream of word
numbers.  Everything global is asked for: a chunk sends each distinct key once
with what it knows (a count, a partial sum) to the key's bucket, and the bucket
answers each chunk in the order of its keys.  The rounds are:

1. words and pairs -> their counts in the training texts;
2. for each order k from two up: (k-1)-grams as histories -> the discounted mass
   and the lower-order mass of all their successors, which give the backoff
   weights; and, below the model's order, (k+1)-grams -> their counts.

A gram is asked for only if its history was seen in training.  A history that
occurs once in the whole corpus has one successor, whose count is one: that is
known where it stands, and asked for no further.  Backoff weights are summed up
only for histories that held-out texts have too, as every gram of a training text
was seen, and told to the chunks that need them.  A key occurs once per chunk,
however frequent it is, so there are no hot keys, and the number of buckets
follows the number of keys.  The tables are written to shared storage by kind
and bucket; chunks are stored in a bucketed table, so only answers are shuffled to
them.  No table is broadcast or collected.  The driver holds counts of counts, a
dozen numbers for each order.

P(w | h) = d(c(hw)) c(hw) / c(h) if the gram was seen, else alpha(h) P(w | h')
with h' the history without its first word, evaluated from the lowest order up;
P(w) = d(c(w)) c(w) / N, and unknown words share what is left.  Histories do not
reach beyond the end mark that stands before each text.  Discounts are
Good-Turing with Katz's limit; alpha makes P(. | h) sum to one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bucketed, forget, remainder, save, tuned

U64 = np.uint64
CHUNK_TOKENS = 1 << 20
BUCKET_KEYS = 1_000_000
#: Counts above this are not discounted.
KATZ_LIMIT = 5
#: The hash of the end of a text, which is also the history of its first word.
END = U64(0xE17A1465B1D8F3C7)
MESSAGE = "chunk long, kind int, bucket int, a binary, b binary"
CHUNK = "chunk long, words binary, taught binary, stream binary, texts binary"
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
#: Kinds of messages; GRAM + k are counts of k-grams, HISTORY + k weights of histories of k-grams, STATS + k counts of counts.
ENCODED, STREAM, GRAM, HISTORY, STATS = 0, 1, 100, 200, 300


def discounts(n: np.ndarray, limit: int = KATZ_LIMIT) -> np.ndarray:
    """Discount of counts 1..limit from the counts of counts n[1..limit + 1]; n[0] is ignored.

    Good-Turing with Katz's renormalisation; where sparse counts of counts put
    that outside (0, 1], the absolute discount n1 / (n1 + 2 n2) is used for that count.
    """
    r = np.arange(1, limit + 1)
    off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
    out = (r - off) / r
    rest = (limit + 1) * n[limit + 1] / n[1] if n[1] > 0 else 1.0
    if rest < 1:
        turing = ((r + 1) * n[r + 1] / np.maximum(1, n[r]) / r - rest) / (1 - rest)
        out = np.where((turing > 0) & (turing <= 1), turing, out)
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= len(d), np.append(0.0, d)[np.minimum(c, len(d))], 1.0) * c


def rounded(x: np.ndarray, bits: int = 34) -> np.ndarray:
    """To ``bits`` binary digits, so to 1e-10 of itself: the other bytes are zero and cost nothing in a message."""
    cut = U64(52 - bits)
    with np.errstate(over="ignore"):
        return ((x.view(U64) + (U64(1) << (cut - U64(1)))) >> cut << cut).view(np.float64)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    whole = np.ascontiguousarray(x).view(f"u{x.itemsize}")
    planes = np.empty((x.itemsize, len(whole)), np.uint8)
    for k in range(x.itemsize):
        planes[k] = (whole >> whole.dtype.type(8 * k)).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return _pack(np.diff(x, prepend=U64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, U64), dtype=U64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    chunk, kind, bucket, a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["chunk", "kind", "bucket", "a", "b"])


def _encode(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, held to one row for each chunk."""
    part, made = TaskContext.get().partitionId(), 0
    hashes, lengths, ids, flags, held = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal hashes, lengths, ids, flags, held, made
        h, n = np.concatenate(hashes), np.concatenate(lengths)
        flag = np.concatenate(flags)
        order = np.argsort(h)
        begins = ta.runs(h[order])
        size = ta.run_lengths(begins, len(h))
        by_size = np.argsort(-size, kind="stable")
        number = np.empty(len(begins), np.uint32)
        number[by_size] = np.arange(len(begins), dtype=np.uint32)
        stream = np.empty(len(h), np.uint32)
        stream[order] = np.repeat(number, size)
        taught = np.bincount(stream[np.repeat((flag & 1) == 0, n)], minlength=len(begins))
        chunk = (part << 32) | made
        texts = zstandard.ZstdCompressor(level=1).compress(np.concatenate(ids).tobytes() + n.astype(np.int64).tobytes() + flag.tobytes())
        out = pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in (h[order[begins]][by_size].tobytes(), _pack(taught.astype(np.int64)), _pack(stream), texts))],
            ["chunk", "words", "taught", "stream", "texts"],
        )
        hashes, lengths, ids, flags, held, made = [], [], [], [], 0, made + 1
        return out

    for batch in batches:
        for t in ta.slices(batch.column(1)):
            w = ta.words_of(t, lower=True)
            n = w.counts + 1
            h = np.full(len(w.hash) + len(t), END)
            h[np.arange(len(w.hash)) + w.doc] = w.hash
            key, out = batch.column(0).slice(t.first, len(t)), batch.column(2).slice(t.first, len(t))
            hashes.append(h)
            lengths.append(n)
            ids.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            flags.append(out.to_numpy(zero_copy_only=False).astype(np.uint8) | (key.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1))
            held += len(h)
            if held >= chunk_tokens:
                yield flush()
    if held:
        yield flush()


class Chunk:
    """One chunk's rows, by kind, and what they say about its tokens."""

    def __init__(self, rows: dict[int, list[tuple[int, bytes, bytes]]]):
        self.rows = rows
        self.words = np.frombuffer(rows[ENCODED][0][1], U64)
        self.stream = _unpack(rows[STREAM][0][1], np.uint32)
        raw = zstandard.ZstdDecompressor().decompress(rows[STREAM][0][2])
        docs = len(raw) // 17
        self.ids = np.frombuffer(raw, np.int64, docs)
        self.lengths = np.frombuffer(raw, np.int64, docs, 8 * docs)
        self.flags = np.frombuffer(raw, np.uint8, docs, 16 * docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.end = np.flatnonzero(self.words == END)[0]

    def taught(self) -> np.ndarray:
        return np.repeat((self.flags & 1) == 0, self.lengths)

    def histories(self, k: int, before: np.ndarray) -> np.ndarray:
        """What ``before`` has at the token before each; at a text's start the end mark for pairs, else -1."""
        out = np.empty(len(before), np.int32)
        out[1:] = before[:-1]
        out[self.starts] = self.end if k == 2 else -1
        return out

    def level(self, k: int, before: Level) -> Level:
        """The k-grams whose history is among ``before``'s grams that were asked for."""
        history = self.histories(k, before.at)
        if before.count is None:
            single, asked = np.zeros(len(history), bool), np.flatnonzero(history >= 0)
        else:
            state = np.append(np.where(before.count > 0, np.where(before.lone, 1, 2), 0), 0).astype(np.uint8).take(history)
            single = state == 1
            after = before.single[:-1].copy()
            after[self.starts[1:] - 1] = False
            single[1:] |= after
            asked = np.flatnonzero(state == 2)
        of = history.take(asked)
        key = ta.combine(before.keys, np.zeros(len(before.keys), U64)).take(of)
        key += self.words.take(self.stream.take(asked))
        key = ta.mix(key)
        order = np.argsort(key)
        key = key.take(order)
        begins = ta.runs(key)
        at = np.full(len(history), -1, np.int32)
        at[asked.take(order)] = np.repeat(np.arange(len(begins), dtype=np.int32), ta.run_lengths(begins, len(key)))
        one = order.take(begins)  # a place of each gram; grams are in the order of their keys
        return Level(at, single, of.take(one), asked.take(one), key.take(begins))

    def answer(self, kind: int, keys: np.ndarray, *types) -> list[np.ndarray]:
        """Answers of the buckets, in the order of ``keys``."""
        order = slice(None) if len(keys) < 2 or (keys[1:] >= keys[:-1]).all() else np.argsort(keys)
        out = []
        rows = sorted(self.rows.get(kind, ()), key=lambda r: r[0])
        for k, of in enumerate(types):
            x = np.empty(len(keys), of)
            if len(keys):
                x[order] = np.concatenate([_unpack(r[1 + k], of) for r in rows])
            out.append(x)
        return out

    def levels(self, order: int) -> list[Level]:
        """Levels 1 to ``order``, those that have been answered with counts."""
        first = Level(self.stream.astype(np.int32), np.zeros(len(self.stream), bool), None, None, self.words)
        out = [first]
        for k in range(1, order + 1):
            if k > 1:
                # Every pair is asked for, whatever its history's count.
                out.append(self.level(k, out[-1] if k > 2 else Level(first.at, first.single, None, None, first.keys)))
            if GRAM + k in self.rows:
                count, flags = self.answer(GRAM + k, out[-1].keys, np.int64, np.uint8)
                out[-1].count, out[-1].own, out[-1].lone, out[-1].tested = count, (flags & 1) > 0, (flags & 2) > 0, (flags & 4) > 0
        return out


class Level:
    """The k-grams of a chunk: which one ends at each token (-1: not asked for), whether it is its history's only successor anywhere, and of each distinct one its history, a place, and its key."""

    def __init__(self, at: np.ndarray, single: np.ndarray, history: np.ndarray | None, place: np.ndarray | None, keys: np.ndarray):
        self.at, self.single, self.history, self.place, self.keys = at, single, history, place, keys
        self.count = self.own = self.lone = self.tested = None

    def spread(self, of_gram: np.ndarray, of_single: float, place: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A value of each gram, or of a single successor, or zero, at each token or at some."""
        out = np.append(of_gram, of_gram.dtype.type(0)).take(self.at[place])
        out[self.single[place]] = of_single
        return out


def _in_room(f):
    """``f`` over batches, with freed arrays kept for its whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ta.roomy():
            yield from f(batches)

    return run


def _on_chunks(f, schema: pa.Schema):
    """``f(chunk number, Chunk)`` over cogroups of a stored chunk and its answers."""

    def on(stored: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, words, taught, stream, texts = (stored.column(k)[0].as_py() for k in range(5))
        rows = {ENCODED: [(0, words, taught)], STREAM: [(0, stream, texts)]}
        for kind, bucket, x, y in zip(*(answers.column(k).to_pylist() for k in range(1, 5))):
            rows.setdefault(kind, []).append((bucket, x, y))
        with ta.roomy():
            return pa.Table.from_batches(list(f(chunk, Chunk(rows))), schema)

    return on


def _asked(chunk: int, kind: int, keys: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys in order, cut by bucket: (chunk, kind, bucket, packed keys, packed values)."""
    if not len(keys):
        return
    if not (keys[1:] >= keys[:-1]).all():
        order = np.argsort(keys)
        keys, values = keys[order], [v[order] for v in values]
    bucket = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    begins = ta.runs(bucket)
    rows = []
    for lo, hi in zip(begins, np.append(begins[1:], len(keys))):
        rows.append((chunk, kind, int(bucket[lo]), _pack_keys(keys[lo:hi]), _pack(np.concatenate([v[lo:hi] for v in values]))))
    yield _rows(rows)


def _ask_first(buckets: int, order: int):
    """Words and pairs of each stored chunk."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                chunk, words, taught, stream, texts = (batch.column(k)[row].as_py() for k in range(5))
                c = Chunk({ENCODED: [(0, words, taught)], STREAM: [(0, stream, texts)]})
                every = np.bincount(c.stream, minlength=len(c.words))
                yield from _asked(chunk, GRAM + 1, c.words, buckets, _unpack(taught, np.int64), every)
                yield from _ask_counts(chunk, c, 2, c.levels(2)[1], buckets, order == 2)

    return ask


def _ask_counts(chunk: int, c: Chunk, k: int, level: Level, buckets: int, last: bool) -> Iterator[pa.RecordBatch]:
    """How often each gram was seen in training, and, where longer ones follow, in all texts."""
    n = len(level.keys)
    values = [np.bincount(level.at[c.taught()] + 1, minlength=n + 1)[1:]]
    if not last:
        values.append(np.bincount(level.at + 1, minlength=n + 1)[1:])
    yield from _asked(chunk, GRAM + k, level.keys, buckets, *values)
    if k > 2:  # grams that are not asked for and have count one
        n = int(level.single.sum())
        yield _rows([(-1, STATS + k, 0, np.array([n, n, n, *[0] * KATZ_LIMIT], np.int64).tobytes(), b"")])


def _ask_next(k: int, order: int, buckets: int, model: Model):
    """Weights of the histories of k-grams and, below the order, counts of (k + 1)-grams."""

    def ask(chunk: int, c: Chunk) -> Iterator[pa.RecordBatch]:
        levels = c.levels(k)
        below, here = levels[k - 2], levels[k - 1]
        own = here.own
        of, place = here.history[own], here.place[own]
        if k == 2:
            lower = model.word_probability(below.count[c.stream[place]])
        else:  # a seen gram's shorter form was seen too
            history = levels[k - 3].at[place - 1]
            total = _weights(c, levels, k - 1, model)[1]
            lower = discounted(below.spread(below.count, 1, place), model.grams[k - 1]) / np.where(below.single[place], model.single(k - 1), total[np.maximum(history, 0)])
        n = len(below.keys)
        mass = np.bincount(of, discounted(here.count[own], model.grams[k]), n)
        lower = np.bincount(of, lower, n)
        want = _wanted(c, levels, k, model)
        some = want | (mass > 0) & ~below.lone & (below.tested | _inexact(below.count, k, model))
        yield from _asked(chunk, HISTORY + k, below.keys[some], buckets, below.count[some].astype(np.float64), rounded(mass[some]), rounded(lower[some]), want[some].astype(np.float64))
        if k < order:
            yield from _ask_counts(chunk, c, k + 1, c.level(k + 1, here), buckets, k + 1 == order)

    return ask


def _inexact(count: np.ndarray, k: int, model: Model) -> np.ndarray:
    """Histories of k-grams that may have nothing to leave, so that their total is not sure to be their count."""
    return count > (KATZ_LIMIT if (model.grams[k] < 1 - 1e-6).all() else 0)


def _wanted(c: Chunk, levels: list[Level], k: int, model: Model) -> np.ndarray:
    """The (k - 1)-grams whose weights this chunk cannot do without: those that are left for an unseen k-gram, which occurs in texts held out alone, and those whose total is not sure."""
    of, here = levels[k - 2], levels[k - 1]
    want = (of.count > 0) & ~of.lone & _inexact(of.count, k, model)
    at = np.flatnonzero(~c.taught())
    left = c.histories(k, of.at)[at[here.spread(here.count, 1, at) == 0]]
    left = left[left >= 0]
    want[left[of.count[left] > 0]] = True
    return want


def _weights(c: Chunk, levels: list[Level], k: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and total of each (k - 1)-gram as a history; a weight of one where it was not seen or is not left."""
    of = levels[k - 2]
    alpha, total = np.ones(len(of.keys)), np.where(of.lone, model.single(k), of.count)
    some = _wanted(c, levels, k, model)
    alpha[some], total[some] = c.answer(HISTORY + k, of.keys[some], np.float64, np.float64)
    return alpha, total


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's totals, told to each chunk in the order of its keys; and counts of counts."""
    for kind, bucket, rows in _buckets(batches):
        if kind >= STATS:
            yield _rows([(-1, kind, bucket, a, b) for _, a, b in rows])
            continue
        keys = [_unpack_keys(a) for _, a, _ in rows]
        number = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every)
        begins = ta.runs(every.take(order))
        size = ta.run_lengths(begins, len(every))
        bounds = np.searchsorted(number, np.arange(len(rows) + 1))
        split = [_unpack(b, np.int64 if kind < HISTORY else np.float64).reshape(-1, len(k)) for (_, _, b), k in zip(rows, keys)]
        parts = len(split[0])
        values = [np.concatenate([x[k] for x in split]).take(order) for k in range(parts)]
        want = np.ones(len(every), bool)

        def told(x: np.ndarray) -> np.ndarray:
            out = np.empty(len(every), x.dtype)
            out[order] = np.repeat(x, size)
            return out

        if kind < HISTORY:
            total = np.add.reduceat(values[0], begins)
            seen = np.add.reduceat(values[-1], begins)
            count = total[total > 0]
            stats = np.concatenate(([count.sum(), len(count)], np.bincount(np.minimum(count, KATZ_LIMIT + 2), minlength=KATZ_LIMIT + 3)[1 : KATZ_LIMIT + 2])).astype(np.int64)
            yield _rows([(-1, STATS + kind - GRAM, bucket, stats.tobytes(), b"")])
            flags = told((seen == 1).astype(np.uint8) << 1 | (seen > total).astype(np.uint8) << 2)
            flags[order[begins]] |= total > 0  # one chunk with the key owns it, if it was seen in training
            answers = told(total), flags
        else:
            count, mass, lower = values[0][begins], np.add.reduceat(values[1], begins), np.add.reduceat(values[2], begins)
            known = np.maximum(1, count)
            want[order] = values[3] > 0
            # A history whose successors are all frequent has no mass to give: it counts one occurrence more.
            total = np.where(known - mass < 1e-6, mass + 1, known)
            answers = told(rounded(np.where(count > 0, (total - mass) / total / np.maximum(1 - lower, 1e-15), 1.0))), told(total)
        for k, (chunk, _, _) in enumerate(rows):
            at = bounds[k] + np.flatnonzero(want[bounds[k] : bounds[k + 1]])
            if len(at):
                yield _rows([(chunk, kind, bucket, _pack(answers[0][at]), _pack(answers[1][at]))])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[int, bytes, bytes]]]]:
    """(kind, bucket, its rows) in turn; the input is sorted by bucket and kind."""
    now, rows = None, []
    for batch in batches:
        for k in range(len(batch)):
            at = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            if at != now and rows:
                yield *now, rows
                rows = []
            now = at
            rows.append((batch.column(0)[k].as_py(), batch.column(3)[k].as_py(), batch.column(4)[k].as_py()))
    if rows:
        yield *now, rows


class Model:
    """What every task knows: totals, and discounts by order."""

    def __init__(self):
        self.grams: dict[int, np.ndarray] = {}

    def learn(self, k: int, stats: np.ndarray) -> None:
        n = np.append(0, stats[2:])
        self.grams[k] = discounts(n)
        if k == 1:
            self.tokens, self.distinct = int(stats[0]), int(stats[1])
            r = np.arange(1, KATZ_LIMIT + 1)
            lost = float(((1 - self.grams[1]) * r * n[r]).sum())
            self.scale = 1.0
            if self.tokens and not 0 < lost < self.tokens:  # nothing rare: keep half a token for the unknown
                self.grams[1], lost = np.ones(KATZ_LIMIT), 0.5
                self.scale = (self.tokens - lost) / self.tokens
            self.unknown = lost / self.tokens if self.tokens else 1.0

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * discounted(c, self.grams[1]) / max(1, self.tokens), self.unknown)

    def single(self, k: int) -> float:
        """The total of a history that occurs once."""
        mass = float(self.grams[k][0])
        return 1.0 if 1 - mass >= 1e-6 else mass + 1


def _score(order: int, model: Model):
    def score(_: int, c: Chunk) -> Iterator[pa.RecordBatch]:
        levels = c.levels(order)
        count = levels[0].count
        p = model.word_probability(count).take(c.stream)
        for k in range(2, order + 1):
            alpha, total = _weights(c, levels, k, model)
            here, of = levels[k - 1], levels[k - 2]
            cut = model.grams[k]
            longer = here.spread(discounted(here.count, cut) / np.maximum(1, total[here.history]), float(cut[0]) / model.single(k))
            unseen = np.flatnonzero(longer == 0)
            longer[unseen] = np.append(alpha, 1.0).take(c.histories(k, of.at).take(unseen)) * p.take(unseen)
            p = longer
        base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        n = len(c.ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(c.ids, mask=(c.flags & 2) > 0),
                pa.array((c.flags & 1) > 0),
                pa.array(c.lengths),
                pa.array(np.add.reduceat((count[c.stream] > 0).astype(np.int64), c.starts)),
                pa.array(np.full(n, model.tokens, np.int64)),
                pa.array(np.add.reduceat(base[c.stream], c.starts)),
                pa.array(np.add.reduceat(np.log10(p), c.starts)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def _stats(answers: DataFrame) -> dict[int, np.ndarray]:
    """By order: sum of the buckets' counts of counts (sum, distinct, counts 1.. limit + 1); folded in Spark, a dozen numbers arrive for each."""
    rows = answers.filter(F.col("kind") >= STATS).select("kind", "a").mapInArrow(_fold, "kind int, k int, n long").groupBy("kind", "k").agg(F.sum("n").alias("n")).collect()
    out: dict[int, np.ndarray] = {}
    for kind, k, n in rows:
        out.setdefault(kind - STATS, np.zeros(KATZ_LIMIT + 3, np.int64))[k] = n
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in batch.column(1)])
        width = KATZ_LIMIT + 3
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(batch))), pa.array(x)], ["kind", "k", "n"])


def score_texts(documents: DataFrame, *, order: int = 3, divisor: int = 5, held: int = 1, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``documents``.

    Words are lower-cased A-Z; every text ends with one end token, so a null or
    empty text has one token.  Learns from all whole texts outside the held-out
    part; rows without doc_id teach and are not held out.  ``base_score`` is the
    add-half unigram, ``score`` the Katz model of ``order`` (two or more), both
    log10.  Repeated rows are rows of their own, and each teaches.  With nothing
    to learn from, every token is unknown and has probability one.  There are no
    ties to break: equal texts have equal scores.  A long text is one chunk, in memory
    at once.  An empty table gives an empty result.  Other columns, whatever their
    names, are ignored.

    Chunks and buckets both follow the input, so messages between them grow with
    its square: beyond some 10**10 tokens choose larger chunks (about 200 bytes
    of memory for a token).
    """
    if order < 2:
        raise ValueError("the order is two or more")
    tuned(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", divisor) == held).alias("held"))
    made = save(docs.mapInArrow(_in_room(lambda batches: _encode(batches, chunk_tokens)), CHUNK))
    chunks = made.count()
    encoded = bucketed(made, "chunk", max(1, min(chunks, 10_000)))  # chunks stay where they are; answers come to them
    forget(made)
    buckets = max(8, int(chunks * chunk_tokens * 0.6 / BUCKET_KEYS) + 1)
    told: list[DataFrame] = []

    def answered(asked: DataFrame) -> dict[int, np.ndarray]:
        told.append(save(asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(_answer, MESSAGE)))
        return _stats(told[-1])

    def on_chunks(f, kind: str) -> DataFrame:
        answers = functools.reduce(DataFrame.union, told).filter("chunk >= 0")
        schema = pa.schema([(x.split()[0], ARROW[x.split()[1]]) for x in kind.split(", ")])
        return encoded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_on_chunks(f, schema), kind)

    model = Model()
    none = np.zeros(KATZ_LIMIT + 3, np.int64)
    stats = answered(encoded.mapInArrow(_in_room(_ask_first(buckets, order)), MESSAGE))
    for k in (1, 2):
        model.learn(k, stats.get(k, none))
    for k in range(2, order + 1):
        stats = answered(on_chunks(_ask_next(k, order, buckets, model), MESSAGE))
        if k < order:
            model.learn(k + 1, stats.get(k + 1, none))
    return on_chunks(_score(order, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
