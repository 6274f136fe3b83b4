"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree up to ``order`` bytes deep, kept as one
table of counts per depth.  The code length of a byte is that of escape method
C: in a context seen n times with d different successors, a successor seen c
times costs log2((n + d) / c) bits and an escape to the next shorter context
log2((n + d) / d); a context never seen costs nothing to leave, and below depth
zero each of 256 bytes costs 8 bits.  Statistics are frozen after training, so
the code length of a byte depends on the ``order`` bytes before it alone, and
the tables can hold the finished sums of all languages side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import packed, remainder, tuned

U64 = np.uint64


class Lookup:
    """Position of 64-bit keys in a fixed key list (-1: absent), by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, ~U64(0))
        self.bits = max(4, int(np.ceil(np.log2(2.5 * max(1, len(keys))))))
        self.slots = np.full(1 << self.bits, len(keys), np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] == len(keys)
            self.slots[at[left[free]]] = left[free]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        none, at = len(self.keys) - 1, self._slot(keys)
        out = self.slots[at]
        left = np.flatnonzero((out != none) & (self.keys[out] != keys))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[at[left]]
            left = left[(out[left] != none) & (self.keys[out[left]] != keys[left])]
        return np.where(out == none, -1, out)


def padded(t: ta.Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with ``order`` spaces before each document, and where each document's own bytes begin."""
    n = np.diff(t.offsets)
    out = np.full(len(t.data) + order * len(t), 0x20, np.uint8)
    out[np.arange(len(t.data)) + order * (np.repeat(np.arange(len(t)), n) + 1)] = ta.LOWER[t.data]
    return out, t.offsets[:-1] + order * (np.arange(len(t)) + 1)


def grams(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each position, as one number."""
    key = np.zeros(len(at), U64)
    for k in range(size - 1, -1, -1):
        key = (key << U64(8)) | data[at - k].astype(U64)
    return key


class Trees:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[str]], order: int):
        self.order, self.langs = order, sorted(texts)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for lang in self.langs:
            held: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
            for t in ta.slices(pa.array(texts[lang], pa.large_string())):
                data, first = padded(t, order)
                at = _positions(first, np.diff(t.offsets))
                for k in range(order + 1):
                    held[k].append(grams(data, at, k + 1))
            for k in range(order + 1):
                keys = np.sort(np.concatenate(held[k]))
                begins = ta.runs(keys)
                counts[k].append((keys[begins], ta.run_lengths(begins, len(keys))))
        self.cost: list[tuple[Lookup, np.ndarray]] = []  # bits of the last byte, from this depth down
        self.escape: list[tuple[Lookup, np.ndarray]] = []  # bits to leave the context of this depth
        for k in range(order + 1 if self.langs else 0):
            every = ta.distinct(np.concatenate([keys for keys, _ in counts[k]]))
            contexts = ta.distinct(every >> U64(8))
            n, d = np.zeros((len(contexts), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            own = np.zeros((len(every), len(self.langs)))
            for j, (keys, c) in enumerate(counts[k]):
                own[np.searchsorted(every, keys), j] = c
                where = np.searchsorted(contexts, keys >> U64(8))
                n[:, j] += np.bincount(where, c, len(contexts))
                d[:, j] += np.bincount(where, minlength=len(contexts))
            leave = np.where(n > 0, np.log2(np.maximum(1, n + d) / np.maximum(1, d)), 0)
            of = np.searchsorted(contexts, every >> U64(8))
            below = self._bits(every & ((U64(1) << U64(8 * k)) - U64(1)), k - 1) if len(every) else np.zeros((0, len(self.langs)))
            seen = np.log2(np.maximum(1, n + d)[of] / np.maximum(1, own))
            self.cost.append((Lookup(every), np.where(own > 0, seen, leave[of] + below).astype(np.float32)))
            self.escape.append((Lookup(contexts), leave.astype(np.float32)))

    def _bits(self, key: np.ndarray, depth: int) -> np.ndarray:
        """Code length of the last byte of each key in every language, starting at ``depth``."""
        out = np.zeros((len(key), len(self.langs)), np.float32)
        left = np.arange(len(key))
        for k in range(depth, -1, -1):
            lookup, cost = self.cost[k]
            found = lookup(key[left])
            hit = found >= 0
            out[left[hit]] += cost[found[hit]]
            left = left[~hit]
            if not len(left):
                return out
            lookup, leave = self.escape[k]
            found = lookup(key[left] >> U64(8))
            out[left[found >= 0]] += leave[found[found >= 0]]
            key = key & ((U64(1) << U64(8 * k)) - U64(1)) if k else key
        out[left] += 8
        return out

    def bits(self, t: ta.Texts) -> np.ndarray:
        """Bits of each whole text in each language."""
        data, first = padded(t, self.order)
        n = np.diff(t.offsets)
        at = _positions(first, n)
        out = np.zeros((len(t), len(self.langs)))
        if len(at):
            each = self._bits(grams(data, at, self.order + 1), self.order)
            full = n > 0
            out[full] = np.add.reduceat(each, t.offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def _positions(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def has_letter(t: ta.Texts) -> np.ndarray:
    low = ta.LOWER[t.data]
    total = np.concatenate(([0], np.cumsum((low >= 0x61) & (low <= 0x7A))))
    out = total[t.offsets[1:]] > total[t.offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(t.offsets) > 0)):
        out[k] = any(c.isalpha() for c in t.data[t.offsets[k] : t.offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(trees: Trees, t: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Language (object array) and score of each text."""
    names = np.array([*trees.langs, "und"], object)
    known = has_letter(t)
    best, score = np.full(len(t), len(trees.langs)), np.zeros(len(t))
    if trees.langs:
        bits = trees.bits(t)
        best = np.where(known, bits.argmin(1), best)
        odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        score = np.where(known, 1 / odds, 0.0)
    return names[best], score


def _tag(model):
    """doc_id, held_out and text to the prediction."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in ta.slices(batch.column(2)):
                lang, score = predict(model.value, t)
                part = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return tag


def _sure(model, least: float, text: int, names: list[str]):
    """Whole rows, packed, to those whose language is sure; the text is field ``text``."""

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(0).flatten()
            for t in ta.slices(fields[text]):
                lang, score = predict(model.value, t)
                keep = pa.array((score >= least) & (lang != "und"))
                yield pa.RecordBatch.from_arrays([f.slice(t.first, len(t)).filter(keep) for f in fields], names)

    return sure


def identify_language(documents: DataFrame, *, order: int = 4, sample_rows: int = 300, sample_bytes: int = 2 << 20, max_langs: int = 200, divisor: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``documents``.

    Learns, outside the held-out part, from rows with text, doc_id and lang: of
    each of the ``max_langs`` most frequent languages (ties: by name), about
    ``sample_rows`` whole texts, ``sample_bytes`` at most, chosen by a hash of the doc_id; texts
    longer than an eighth of ``sample_bytes`` are not learnt from.  Every text is
    scored whole, in one pass over its bytes, however long.  The score is the
    posterior of the language at equal priors; ties go to the first name.  A null
    text, or one without a letter, is ``und`` with score 0, and so is every text
    when nothing could be learned.  A null doc_id is not held out.  Repeated rows
    are rows of their own; an empty table gives an empty result.  Other columns,
    whatever their names, are ignored.
    """
    model = _learn(documents, order, sample_rows, sample_bytes, max_langs, divisor, held)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", divisor) == held).alias("held_out"), "text")
    return docs.mapInArrow(_tag(model), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(documents: DataFrame, *, least: float = 0.5, order: int = 4, sample_rows: int = 300, sample_bytes: int = 2 << 20, max_langs: int = 200, divisor: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``documents`` whose language is recognised: not ``und``, and scored ``least`` or more.

    Rows are otherwise untouched, repeats included, and so are columns, whatever
    their names.  What is learnt, and nulls, ties, very long texts and empty tables, are as in
    ``identify_language``: null and letterless texts go, null doc_ids stay.
    """
    model = _learn(documents, order, sample_rows, sample_bytes, max_langs, divisor, held)
    names = documents.columns
    return packed(documents).mapInArrow(_sure(model, least, names.index("text"), names), documents.schema)


def _learn(documents: DataFrame, order: int, sample_rows: int, sample_bytes: int, max_langs: int, divisor: int, held: int):
    """Broadcast trees.  The driver holds a count for each language and then the sample: languages x ``sample_bytes`` at most."""
    tuned(documents.sparkSession)
    size = F.octet_length("text")
    teaching = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", divisor) != held) & (size <= sample_bytes // 8))
    teaching = teaching.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    langs = teaching.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    texts: dict[str, list[str]] = {}
    share = {r["lang"]: min(1.0, sample_rows / r["n"], 0.75 * sample_bytes / max(1, r["bytes"])) for r in langs}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    while share:  # an unlucky draw that is too large is made again at half the share
        wanted = F.create_map(*(F.lit(x) for item in share.items() for x in item))
        drawn = teaching.filter(draw < F.coalesce(wanted[F.col("lang")], F.lit(0.0)))
        found = {r["lang"]: r["bytes"] for r in drawn.groupBy("lang").agg(F.sum(size).alias("bytes")).collect()}
        large = {lang for lang, n in found.items() if n > sample_bytes}
        fits = drawn.filter(~F.col("lang").isin(*large)) if large else drawn
        for lang, text, _ in sorted(fits.select("lang", "text", "doc_id").collect(), key=lambda x: (x[0], x[2], x[1])):
            texts.setdefault(lang, []).append(text)
        share = {lang: share[lang] / 2 for lang in large}
    return documents.sparkSession.sparkContext.broadcast(Trees(texts, order))
