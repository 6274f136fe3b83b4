"""Quality rules: hashed word and character n-gram logistic regression over plain counts.

The model is trained on a bounded sample of labelled rows by AdaGrad, then its
log-odds are calibrated (Platt) on rows of the sample that it has not seen, and
every text is scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import tuned
from .features import characters, characters_of, collect_rows, distinct_rows, labelled, pairs_of

BITS = 20
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def features_of(t: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    w = ta.words_of(t)
    chars = characters(t)
    each = [pairs_of(w, 0, 11, BITS), pairs_of(w, 1, 12, BITS), characters_of(*chars, 3, 13, BITS), characters_of(*chars, 5, 14, BITS)]
    return np.concatenate([d for d, _ in each]), np.concatenate([f for _, f in each])


def counts_of(t: ta.Texts) -> dict[str, np.ndarray]:
    """Per document: words, characters in words, symbols, repeated lines, and words in repeated 3-word windows."""
    w, n = ta.words_of(t), len(t)
    doc_of_byte = np.repeat(np.arange(n), np.diff(t.offsets))
    begins = (t.data & 0xC0) != 0x80
    chars = np.bincount(doc_of_byte[begins & ~ta.IS_SPACE[t.data]], minlength=n)
    symbols = np.bincount(doc_of_byte[_SYMBOL[t.data]], minlength=n)

    # A line is the hash of all its bytes; lines without a word do not count.
    starts = np.unique(np.concatenate((t.offsets[:-1], np.flatnonzero(t.data == 0x0A) + 1)))
    starts = starts[starts < len(t.data)]
    lines = ta.Texts(0, t.data, np.append(starts, len(t.data)))
    has = np.diff(np.searchsorted(w.start, lines.offsets)) > 0
    h, doc = line_hashes(lines), np.searchsorted(t.offsets, starts, "right") - 1
    h, doc = h[has], doc[has]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    dup_lines = np.bincount(doc[order][1:][same], minlength=n)

    h, at = ta.window_hashes(w, 3)
    doc = w.doc[at]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.hash), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(w.doc[covered], minlength=n)}


def line_hashes(lines: ta.Texts) -> np.ndarray:
    """Hash of the bytes of each line without its newline."""
    powers, inverses = ta._power_tables(len(lines.data) + 1)
    start, end = lines.offsets[:-1], lines.offsets[1:].copy()
    cut = (end > start) & (lines.data[np.maximum(end - 1, 0)] == 0x0A)
    end[cut] -= 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ta._SALT[lines.data] * powers[: len(lines.data)], dtype=np.uint64)))
        return ta.mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))


def train(rows: list[np.ndarray], labels: np.ndarray, *, epochs: int = 5, rate: float = 0.5, l2: float = 1e-6, seed: int = 5) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, offset): the calibrated probability is sigmoid(slope * (w.x + bias) + offset)."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-4)
    bias, bias2 = 0.0, 1e-4
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(rows))
    cut = len(rows) - len(rows) // 5
    fit, rest = order[:cut], order[cut:]

    def margin(r: int) -> float:
        return w[rows[r]].sum() / max(1.0, np.sqrt(len(rows[r]))) + bias

    for _ in range(epochs):
        for r in rng.permutation(fit):
            i, scale = rows[r], 1 / max(1.0, np.sqrt(len(rows[r])))
            g = 1 / (1 + np.exp(-np.clip(margin(r), -35, 35))) - labels[r]
            step = g * scale
            g2[i] += step * step
            w[i] -= rate * (step + l2 * w[i]) / np.sqrt(g2[i])
            bias2 += g * g
            bias -= rate * g / np.sqrt(bias2)
    slope, offset = 1.0, 0.0
    if len(rest):
        x, y = np.array([margin(r) for r in rest]), labels[rest]
        if 0 < y.sum() < len(y):
            y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
            for _ in range(50):  # Newton steps on two parameters
                p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -35, 35)))
                d, v = p - y, p * (1 - p)
                h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
                a, b = np.linalg.solve(h, [(d * x).sum() + 1e-3 * (slope - 1), d.sum() + 1e-3 * offset])
                slope, offset = slope - np.clip(a, -2, 2), offset - np.clip(b, -2, 2)
    return w, bias, float(slope), float(offset)


def _judge(model, threshold: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, value, bias, slope, offset = model.value
        dense = np.zeros(1 << BITS)
        dense[where] = value
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                c = counts_of(t)
                doc, feature = distinct_rows(*features_of(t), BITS)
                size = np.bincount(doc, minlength=len(t))
                total = np.bincount(doc, dense[feature], len(t)) / np.sqrt(np.maximum(1, size)) + bias
                p = 1 / (1 + np.exp(-np.clip(slope * total + offset, -35, 35)))
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, len(t)), *(pa.array(x.astype(np.int64)) for x in c.values()), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)],
                    ["doc_id", *c, "base_failed", "kept", "quality"],
                )

    return judge


def judge_quality(documents: DataFrame, labels: DataFrame, *, sample_rows: int = 4000, most_bytes: int = 1 << 17, threshold: float = 0.4) -> DataFrame:
    """Counts, base rules, calibrated probability and verdict of every row of ``documents``.

    Learns ``labels.quality`` from the whole texts of at most ``sample_rows``
    labelled documents of ``most_bytes`` at most; all texts are scored whole,
    however long.  A null text counts as empty and fails the base rules.  With no
    labelled row the probability is 0.5.  A doc_id labelled twice counts as good
    if either label says so; one with several texts teaches one of them; a null
    one teaches nothing and is judged like all others.  A probability at the
    threshold is kept.  Repeated rows are judged each; an empty table gives an
    empty result.  Other columns, whatever their names, are ignored.
    """
    tuned(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = labelled(docs, labels, "quality", sample_rows, most_bytes, F.lit(True))
    w, *rest = train(*collect_rows(sample, features_of, BITS))
    some = np.flatnonzero(w)
    model = documents.sparkSession.sparkContext.broadcast((some, w[some], *rest))
    return docs.mapInArrow(_judge(model, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double")
