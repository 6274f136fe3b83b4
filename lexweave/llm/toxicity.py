"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presences of words, neighbouring pairs and pairs with one word
between; a word, here a run of letters and digits, is also known by its stems,
its first bytes, so that inflected forms share weights.  Each coordinate has its own learning rate and an L1 penalty, so most
weights are exactly zero; what is broadcast is the list of the others, at most
2**bits numbers whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import remainder, tuned
from .features import collect_rows, distinct_rows, labelled, pairs_of

BITS = 20
BIAS = 1 << BITS
#: Bytes of a word that make its stems.
STEMS = (4, 5, 6)


def features_of(t: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    w = ta.words_of(t, lower=True, breaks=ta.IS_BREAK)
    each = [pairs_of(w, gap, gap + 1, BITS) for gap in (0, 1, 2)]
    for size in STEMS:
        at, h = ta.prefix_hashes(t, w, size)
        each.append((w.doc[at], (ta.mix(h + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64)))
    return np.concatenate([d for d, _ in each]), np.concatenate([f for _, f in each])


def ftrl(rows: list[np.ndarray], labels: np.ndarray, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of the non-zero weights; feature ``BIAS`` is the unpenalised bias.

    Rate and penalty have the fewest errors in four-fold cross-validation inside
    the rows that may be learnt from (README).
    """
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    penalty = np.full(BIAS + 1, l1)
    penalty[BIAS] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - penalty[i], 0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = np.append(rows[r], BIAS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[r]
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    w = weights(np.arange(BIAS + 1))
    some = np.flatnonzero(w)
    return some, w[some]


def _scorer(model, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, value = model.value
        dense = np.zeros(BIAS + 1)
        dense[where] = value
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                doc, feature = features_of(t)
                some = dense[feature] != 0
                doc, feature = distinct_rows(doc[some], feature[some], BITS)
                total = dense[BIAS] + np.bincount(doc, dense[feature], len(t))
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), batch.column(2).slice(t.first, len(t)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def score_toxicity(documents: DataFrame, labels: DataFrame, *, sample_rows: int = 8000, most_bytes: int = 1 << 17, threshold: float = 0.3, divisor: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``.

    Learns ``labels.toxic`` from at most ``sample_rows`` labelled documents of
    ``most_bytes`` at most outside the held-out part, their whole texts; all texts
    are scored whole, however long.  A null or empty text has the score of the
    bias alone.  With no labelled row the score is 0.5.  A doc_id labelled twice
    counts as toxic if either label says so; one with several texts teaches one of
    them; a null one is not held out and teaches nothing.  A score at the
    threshold is predicted 1.  Repeated rows are scored each; an empty table gives
    an empty result.  Other columns, whatever their names, are ignored.
    """
    tuned(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = labelled(docs, labels, "toxic", sample_rows, most_bytes, remainder("doc_id", divisor) != held)
    model = documents.sparkSession.sparkContext.broadcast(ftrl(*collect_rows(sample, features_of, BITS)))
    out = docs.withColumn("held_out", remainder("doc_id", divisor) == held)
    return out.mapInArrow(_scorer(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
