"""Substring deduplication on a log-structured fingerprint index.

Every run of ``window`` words is stood for by its *fingerprint*: the least hash
among its runs of ``stem`` words.  Equal windows have equal fingerprints, and
neighbouring windows mostly share one, so a text of n words has about
2n / (window - stem + 2) postings (fingerprint, doc_id).

The index is a list of immutable runs of postings sorted by fingerprint and cut
into buckets by range, stored so that runs meet without a shuffle.  Documents
arrive in batches of rising doc_id.  A batch becomes a new run, is merge-joined
bucket by bucket with the runs before it, and runs of one level are compacted
into a run of the next.  An index can be kept and opened for later batches.  A fingerprint in
two texts makes their windows under it candidates; candidates are verified on
the hash of the whole window, which also finds the smallest doc_id of each.

Only postings, candidates and, per document, its own hits are shuffled, in
sorted blocks.  The number of buckets follows the number of postings, so a task
holds about a million of them at any input size, and no key's postings are
held more than once per document.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bucketed, forget, fresh_path, remove, save, tuned

U64 = np.uint64
#: Keys that one task merges at once, on average.
BUCKET_KEYS = 1_000_000


def fingerprints(w: ta.Words, window: int, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every window inside one document."""
    h, at = ta.window_hashes(w, stem)
    span = window - stem + 1
    n = len(w.hash) - window + 1
    if n <= 0 or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    every = np.full(len(w.hash), ~U64(0))
    every[at] = h
    starts = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    least = every[:n].copy()
    for k in range(1, span):
        np.minimum(least, every[k : k + n], out=least)
    return starts, ta.mix(least[starts])  # a minimum is small; mixed, it falls into all buckets alike


def sequence_hashes(w: ta.Words, docs: int) -> np.ndarray:
    """128-bit hash of the word sequence of each document; zero without words."""
    b = w.bounds
    seq = np.zeros((docs, 2), U64)
    place = np.arange(len(w.hash)) - np.repeat(b[:-1], w.counts)
    full = w.counts > 0
    if full.any():
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x9E3779B9, 0x85EBCA6B)):
                seq[full, k] = np.add.reduceat(ta.mix(w.hash + ta.mix(place.astype(U64) * U64(salt) + U64(k))), b[:-1][full])
    return seq


def _postings(window: int, stem: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                w = ta.words_of(t)
                starts, prints = fingerprints(w, window, stem)
                doc = w.doc[starts]
                order = np.lexsort((prints, doc))
                doc, prints = doc[order], prints[order]
                new = np.ones(len(doc), bool)
                new[1:] = (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])
                doc, prints = doc[new], prints[new]
                seq = sequence_hashes(w, len(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, len(t)),
                        pa.array(w.counts.astype(np.int64)),
                        ta.binaries(seq.reshape(-1), np.arange(len(t) + 1) * 2),
                        ta.binaries(prints, np.searchsorted(doc, np.arange(len(t) + 1))),
                    ],
                    ["doc_id", "n_words", "seq", "prints"],
                )

    return postings


def _blocks(keys: np.ndarray, docs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted (key, doc) pairs cut by key range into one row per bucket that has any."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    bucket = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
    begins = ta.runs(bucket)
    bounds = np.append(begins, len(keys))
    return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), ta.binaries(keys, bounds), ta.binaries(docs, bounds)], ["bucket", "keys", "docs"])


BLOCK = "bucket int, keys binary, docs binary"


def _read(batch: pa.RecordBatch, name: str, kind=np.uint64) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid and len(x.as_buffer())]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _scatter(buckets: int, flush: int = 1 << 20):
    """(doc_id, prints) rows to sorted blocks, a bounded number of postings at a time."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                n = np.array([len(x.as_buffer()) // 8 if x.is_valid else 0 for x in part.column(1)], np.int64)
                keys.append(_read(part, part.schema.names[1]))
                docs.append(np.repeat(part.column(0).to_numpy(zero_copy_only=False), n))
                held += int(n.sum())
                if held >= flush:
                    yield _blocks(np.concatenate(keys), np.concatenate(docs), buckets)
                    keys, docs, held = [], [], 0
        if held:
            yield _blocks(np.concatenate(keys), np.concatenate(docs), buckets)

    return scatter


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket in turn; the input is sorted by bucket."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        begins = ta.runs(bucket)
        for lo, hi in zip(begins, np.append(begins[1:], len(bucket))):
            if now is not None and bucket[lo] != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = bucket[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    b = t.combine_chunks().to_batches()
    return np.concatenate([_read(x, "keys") for x in b]), np.concatenate([_read(x, "docs", np.int64) for x in b])


#: Rows that a bucket's part of a run is cut into, so that no row is large.
CELLS = 8
RUN = "bucket int, cell int, keys binary, docs binary"


def _cells(bucket: int, keys: np.ndarray, docs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A bucket's pairs, sorted and distinct, cut by key range."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    cell = ((keys >> U64(32)) * U64(buckets * CELLS) >> U64(32)).astype(np.int64) - bucket * CELLS
    begins = ta.runs(cell)
    bounds = np.append(begins, len(keys))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), bucket, np.int32)), pa.array(cell[begins].astype(np.int32)), ta.binaries(keys, bounds), ta.binaries(docs, bounds)], ["bucket", "cell", "keys", "docs"])


def _compact(buckets: int):
    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_bucket(batches):
            yield _cells(t.column(0)[0].as_py(), *_columns(t), buckets)

    return compact


def _pair(batch: pa.RecordBatch, row: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and documents in columns ``at`` and ``at + 1`` of one row; empty where null."""
    keys, docs = batch.column(at)[row], batch.column(at + 1)[row]
    return (np.frombuffer(keys.as_buffer(), U64), np.frombuffer(docs.as_buffer(), np.int64)) if keys.is_valid else (np.zeros(0, U64), np.zeros(0, np.int64))


def _merged(buckets: int):
    """Two runs' blocks of each cell to one."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                a, b = _pair(batch, row, 2), _pair(batch, row, 4)
                yield _cells(batch.column(0)[row].as_py(), np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])), buckets)

    return merged


def _merge_join(own: list[bool]):
    """A cell of the new run and of each old one to the postings whose fingerprint is in two documents, one of them new.

    Old postings of this call (``own``) are told only when their fingerprint was
    alone so far, as they are told already otherwise; those of earlier calls always.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, docs = _pair(batch, row, 2)
                begins = ta.runs(keys)
                size = ta.run_lengths(begins, len(keys))
                told = np.repeat(size, size) > 1
                alone = np.zeros(len(begins), np.int64)
                out = []
                late = []
                for k, mine in enumerate(own):
                    old, of = _pair(batch, row, 4 + 2 * k)
                    lo, hi = np.searchsorted(old, keys[begins], "left"), np.searchsorted(old, keys[begins], "right")
                    n = hi - lo
                    told |= np.repeat(n > 0, size)
                    if mine:
                        alone += n
                        late.append((old, of, lo, n))
                    else:
                        at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        out.append((of[at], old[at]))
                for old, of, lo, n in late:
                    at = lo[(n == 1) & (alone == 1)]
                    out.append((of[at], old[at]))
                out.append((docs[told], keys[told]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([x for _, x in out]).view(np.int64))], ["doc_id", "hit"])

    return join


class FingerprintIndex:
    """A log-structured index of postings in a shared folder.

    Runs are immutable external tables, bucketed by key range, one sorted block a
    row; a manifest lists them, and its last whole version is the index.  ``add``
    makes a run of a batch, merge-joins it in place with the runs before it (none
    of them is shuffled) and returns the hits as (doc_id, hit); two runs of a level
    are compacted into one of the next.  ``open`` finds an index that an earlier
    session has left.  Choose ``buckets`` for the size to come, about a million postings each.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, runs: list[tuple[int, int, str]] = (), version: int = 0):
        self.spark, self.path, self.buckets, self.version = spark, path, buckets, version
        self.parts = 4 * buckets  # key ranges, hashed to the buckets, so that these are about equal
        self.runs, self.tables = list(runs), {}
        self.call = 1 + max((call for _, call, _ in self.runs), default=0)

    @classmethod
    def create(cls, spark: SparkSession, buckets: int, path: str | None = None) -> FingerprintIndex:
        out = cls(spark, path or fresh_path(spark), buckets)
        out._commit()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        versions = [int(re.search(r"manifest-([0-9]+)/", str(f.getPath().toString()))[1]) for f in found]
        if not versions:
            raise ValueError(f"no index in {path}")
        rows = spark.read.parquet(f"{path}/manifest-{max(versions)}").orderBy("place").collect()  # a row for each run
        return cls(spark, path, rows[0]["buckets"], [(r["level"], r["call"], r["run"]) for r in rows if r["run"]], max(versions))

    def _commit(self) -> None:
        self.version += 1
        rows = [(k, self.buckets, *run) for k, run in enumerate(self.runs)] or [(0, self.buckets, 0, 0, None)]
        self.spark.createDataFrame(rows, "place int, buckets int, level int, call int, run string").coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")

    @contextlib.contextmanager
    def _in_place(self) -> Iterator[None]:
        """Joins on (bucket, cell) take the layout by bucket as it is."""
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "false")
        try:
            yield
        finally:
            self.spark.conf.set(key, before) if before is not None else self.spark.conf.unset(key)

    def _table(self, run: str) -> DataFrame:
        if run not in self.tables:
            self.tables[run] = name = f"lexweave_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (bucket INT, cell INT, keys BINARY, docs BINARY) USING parquet CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(self.tables[run])

    def _write(self, blocks: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        self.tables[run] = bucketed(blocks, "bucket", self.buckets, f"{self.path}/{run}")._table
        return run

    def _forget(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}") if run in self.tables else None
        remove(self.spark, f"{self.path}/{run}")

    def add(self, postings: DataFrame) -> DataFrame:
        """``postings``: doc_id long, prints binary (64-bit values).  Only they are shuffled."""
        dealt = postings.mapInArrow(_scatter(self.parts), BLOCK).repartition(self.buckets, "bucket").sortWithinPartitions("bucket")
        run = self._write(dealt.mapInArrow(_compact(self.parts), RUN))
        both = self._table(run)
        for k, (_, _, old) in enumerate(self.runs):
            both = both.join(self._table(old).toDF("bucket", "cell", f"keys{k}", f"docs{k}").hint("merge"), ["bucket", "cell"], "left")
        with self._in_place():
            hits = save(both.mapInArrow(_merge_join([call == self.call for _, call, _ in self.runs]), "doc_id long, hit long"))
        self.runs.append((0, self.call, run))
        self._commit()
        while len(self.runs) > 1 and self.runs[-1][:2] == self.runs[-2][:2]:
            self._merge(len(self.runs) - 2)
        return hits

    def _merge(self, at: int) -> None:
        (level, _, a), (_, call, b) = self.runs[at : at + 2]
        both = self._table(a).join(self._table(b).toDF("bucket", "cell", "more", "of").hint("merge"), ["bucket", "cell"], "full")
        with self._in_place():
            self.runs[at : at + 2] = [(level + 1, call, self._write(both.mapInArrow(_merged(self.parts), RUN)))]
        self._commit()
        self._forget(a)
        self._forget(b)

    def finish(self) -> None:
        """End a call: what it added is history for the next one, and runs of one level are compacted across calls."""
        k = len(self.runs) - 2
        while k >= 0:
            if self.runs[k][0] <= self.runs[k + 1][0]:
                self._merge(k)
            k -= 1
        self.call += 1

    def drop(self) -> None:
        for run in list(self.tables):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
        remove(self.spark, self.path)


def _windows(window: int, stem: int, buckets: int):
    """Blocks of whole-window hashes of the windows whose fingerprint is among the document's hits."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                h, doc = candidates(batch, t, window, stem)
                keys.append(h)
                docs.append(batch.column(0).slice(t.first, len(t)).to_numpy(zero_copy_only=False)[doc])
                held += len(h)
                if held >= 1 << 20:
                    yield _blocks(np.concatenate(keys), np.concatenate(docs), buckets)
                    keys, docs, held = [], [], 0
        if held:
            yield _blocks(np.concatenate(keys), np.concatenate(docs), buckets)

    return windows


def candidates(batch: pa.RecordBatch, t: ta.Texts, window: int, stem: int) -> tuple[np.ndarray, np.ndarray]:
    w = ta.words_of(t)
    starts, prints = fingerprints(w, window, stem)
    lists = batch.column(2).slice(t.first, len(t))
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    hit = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
    owner = np.repeat(np.arange(len(t)), n)
    keep = _in_pairs(w.doc[starts], prints, owner, hit)
    h, at = ta.window_hashes(w, window)
    return h[keep], w.doc[at][keep]


def _in_pairs(doc: np.ndarray, value: np.ndarray, owner: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which (doc, value) are among the (owner, of) pairs."""
    if not len(of):
        return np.zeros(len(doc), bool)
    a, b = ta.combine(doc.astype(U64), value), np.sort(ta.combine(owner.astype(U64), of))
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hit) of windows that a smaller doc_id also has."""
    for t in _by_bucket(batches):
        keys, docs = _columns(t)
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        begins = ta.runs(keys)
        first = np.repeat(docs[begins], ta.run_lengths(begins, len(keys)))
        late = docs > first
        yield pa.RecordBatch.from_arrays([pa.array(docs[late]), pa.array(keys[late].view(np.int64))], ["doc_id", "hit"])


def _strip(window: int, texts: bool):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(3).to_pylist()
            for t in ta.slices(batch.column(1)):
                w = ta.words_of(t)
                h, at = ta.window_hashes(w, window)
                lists = batch.column(2).slice(t.first, len(t))
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                begin = at[_in_pairs(w.doc[at], h, np.repeat(np.arange(len(t)), n), lists.flatten().to_numpy(zero_copy_only=False).view(U64))]
                depth = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + window, -1)
                copy = np.array([x is not None and own.tobytes() in x for x, own in zip(whole[t.first : t.first + len(t)], sequence_hashes(w, len(t)))], bool)
                gone = (np.cumsum(depth)[:-1] > 0) | (copy & (w.counts >= window))[w.doc]
                kept = np.flatnonzero(~gone)
                data = t.data.copy()
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, w.start[kept], 1)
                np.add.at(inside, w.end[kept], -1)
                stay = np.cumsum(inside)[:-1] > 0
                more = kept[:-1][w.doc[kept[:-1]] == w.doc[kept[1:]]]
                data[w.end[more]] = 0x20
                stay[w.end[more]] = True
                edge = np.concatenate(([0], np.cumsum(stay)))[t.offsets]
                left = data[stay].tobytes()
                out = [left[a:b] for a, b in zip(edge[:-1], edge[1:])]
                removed = np.bincount(w.doc[gone], minlength=len(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, len(t)),
                        pa.array(w.counts.astype(np.int64)),
                        pa.array(removed.astype(np.int64)),
                        pa.array([x.decode("utf-8", "replace") for x in out], pa.string()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text" if texts else "kept_sha256"],
                )

    return strip


def remove_repeats(
    documents: DataFrame, *, window: int = 13, stem: int = 6, batches: int = 4, texts: bool = True, doc_id: str = "doc_id", text: str = "text",
    index: FingerprintIndex | None = None, history: DataFrame | None = None,
) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_words, n_removed, kept_text), or the SHA-256 of the kept
    text instead of it when ``texts`` is false; kept words are joined by one
    space.  A null or empty text has no words; a row without doc_id loses none and
    is no source.  Rows that repeat a doc_id are no source for each other, and
    each is judged by its own words; there are no other ties.  Windows are judged
    on the input.  A long text is handled whole, in one task at a time.  Other
    columns, whatever their names, are ignored; an empty table gives an empty result.

    With an ``index``, the documents are added to it, and windows of documents
    added by earlier calls count too; ``history`` has those documents, of which
    only the ones with shared fingerprints are read.  The index is left for the
    next call.  Adding in two calls, the smaller doc_ids first, equals one call.
    """
    spark = documents.sparkSession
    tuned(spark)
    if index is not None and index.runs and history is None:
        raise ValueError("an index with runs needs the documents that are in it")

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    docs = named(documents)
    posted = save(docs.filter("doc_id is not null").mapInArrow(_postings(window, stem), "doc_id long, n_words long, seq binary, prints binary"))
    firsts = save(posted.filter(F.col("n_words") >= window).groupBy("seq").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    sources = firsts.select(F.col("first").alias("doc_id")).distinct()
    row = posted.agg(F.coalesce(F.sum(F.length("prints")), F.lit(0)) / 8, F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()
    at = index or FingerprintIndex.create(spark, max(8, int(row[0] / BUCKET_KEYS) + 1))
    cuts, hits = sorted(set(row[1] or [])), []
    unique = posted.join(sources, "doc_id", "left_semi").select("doc_id", "prints")
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = unique
        if lo is not None:
            part = part.filter(F.col("doc_id") > lo)
        if hi is not None:
            part = part.filter(F.col("doc_id") <= hi)
        hits.append(at.add(part))
    at.finish() if index else at.drop()
    copies = save(posted.join(firsts.filter("copies > 1"), "seq").filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("seq").alias("copy")))
    forget(posted, firsts)
    asked = functools.reduce(DataFrame.union, hits).groupBy("doc_id").agg(F.collect_set("hit").alias("hits"))
    known = docs if history is None else docs.union(named(history))
    blocks = known.join(asked, "doc_id").select("doc_id", "text", "hits").mapInArrow(_windows(window, stem, at.buckets), BLOCK)
    found = save(blocks.repartitionById(at.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeats, "doc_id long, hit long"))
    forget(*hits)
    found = found.groupBy("doc_id").agg(F.collect_set("hit").alias("hits"))
    marked = docs.filter("doc_id is not null").join(found, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "hits", "copy")
    free = docs.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("hits"), F.lit(None).cast("array<binary>").alias("copy"))
    return marked.union(free).mapInArrow(_strip(window, texts), f"doc_id long, n_words long, n_removed long, {'kept_text' if texts else 'kept_sha256'} string")
