"""Hashed features of whole texts, shared by the linear models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

U64 = np.uint64


def pairs_of(w: ta.Words, gap: int, salt: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each pair of words ``gap`` apart; gap 0 is the word alone."""
    n = max(0, len(w.hash) - gap)
    with np.errstate(over="ignore"):
        if gap:
            at = np.flatnonzero(w.doc[:n] == w.doc[gap:])
            h = ta.mix(w.hash[:n] * U64(0x9FB21C651E98DF25) + w.hash[gap:] + U64(salt))[at]
            return w.doc[at], (h >> U64(64 - bits)).astype(np.int64)
        return w.doc, (ta.mix(w.hash + U64(salt)) >> U64(64 - bits)).astype(np.int64)


def characters(t: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of each code point; the number is its UTF-8 bytes."""
    at = np.flatnonzero((t.data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(t.data)))
    number = t.data[at].astype(U64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        number[more] |= t.data[at[more] + k].astype(U64) << U64(8 * k)
    return np.repeat(np.arange(len(t)), np.diff(t.offsets))[at], number


def characters_of(doc: np.ndarray, number: np.ndarray, size: int, salt: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each run of ``size`` characters inside one document."""
    n = len(number) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.full(n, salt, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key = key * U64(0x9FB21C651E98DF25) + number[k : k + n]
    same = doc[:n] == doc[size - 1 :]
    return doc[:n][same], (ta.mix(key)[same] >> U64(64 - bits)).astype(np.int64)


def distinct_rows(doc: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = ta.distinct((doc.astype(U64) << U64(bits)) | feature.astype(U64))
    return (key >> U64(bits)).astype(np.int64), (key & U64((1 << bits) - 1)).astype(np.int64)


def labelled(documents: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, wanted) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label), chosen by a hash of the id: the same rows on every run.

    A text longer than ``most_bytes`` is not learnt from; of a doc_id with
    several texts the one with the least hash is.  The chosen ids, at most
    ``rows`` of them, are the only thing broadcast.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & wanted)
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    found = documents.filter(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"), F.max("label").alias("label"))


def collect_rows(sample: DataFrame, of, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct hashed features and label of each row of a bounded sample, in doc_id order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                doc, feature = distinct_rows(*of(t), bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, len(t)), batch.column(2).slice(t.first, len(t)), ta.binaries(feature.astype(np.int32), np.searchsorted(doc, np.arange(len(t) + 1)))],
                    ["doc_id", "label", "features"],
                )

    got = sample.mapInArrow(rows, "doc_id long, label int, features binary").toArrow()
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending")]))
    return [np.frombuffer(x.as_buffer(), np.int32) for x in got["features"]], got["label"].to_numpy().astype(float)
