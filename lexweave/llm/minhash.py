"""MinHash near-duplicate detection.

One-permutation hashing with optimal densification gives each text a signature
of ``bands * rows`` bins from a single hash pass over its shingles.  Texts that
agree on all bins of a band share a bucket.  A bucket of m texts yields a star,
m - 1 edges from its most central member, not m * (m - 1) / 2 pairs.  Every
edge is confirmed on the full shingle sets.  Buckets whose members are not yet
one component get further centres until each pair in them is compared or
proven too different, so the stars lose no link that any bucket holds.

The proof is exact: of text u, with ``size`` shingles of which ``common`` occur
in another text that still has an open bucket, overlap with v is at most
min(common(u), common(v)), hence a link at threshold t needs
``size(v) <= common(u) * (1 + 1 / t) - size(u)`` and the same with u and v swapped.
It also needs the sets to differ in at most (1 - t) / (1 + t) * (size(u) + size(v))
elements, of which the odd sketches of the two sets give a lower bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from . import common as storage
from .common import components, forget, only_ids, packed, tuned, without_keys

U64 = np.uint64
#: Bits of an odd sketch.
SKETCH = 1024


def plan(threshold: float, bands: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows per band at which a pair at the threshold misses all bands with probability 1e-4 at most."""
    return bands, max(1, int(math.log(1 - 1e-4 ** (1 / bands)) / math.log(threshold)))


def shingle_sets(t: ta.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin.  Fewer words than ``size`` make one shingle."""
    w = ta.words_of(t, lower=True)
    h, at = ta.window_hashes(w, size)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        bounds, more = w.bounds, np.zeros(len(short), U64)
        for k in range(size - 1):
            has = w.counts[short] > k
            at = bounds[short[has]] + k
            more[has] = ta.combine(more[has], w.hash[at])
        h, doc = np.concatenate((h, more)), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(t) + 1))


def odd_sketches(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each non-empty set, ``SKETCH`` bits: the parity of the number of elements that hash to each.

    Elements that two sets share cancel out, so their sketches differ in no
    more bits than the sets differ in elements.
    """
    n = np.diff(bounds)
    full = n > 0
    at = np.repeat(np.arange(int(full.sum())), n[full]) * SKETCH + (ta.mix(h ^ U64(0x2545F4914F6CDD1D)) >> U64(32)).astype(np.int64) % SKETCH
    odd = (np.bincount(at, minlength=int(full.sum()) * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, SKETCH), axis=1).view(np.int64)


def band_keys(h: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` bucket keys for each non-empty set."""
    bins, full = bands * rows, np.flatnonzero(np.diff(bounds))
    n = len(full)
    sig = np.full(n * bins, ~U64(0))
    slot = np.repeat(np.arange(n), np.diff(bounds)[full]) * bins + ((h >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    value = ta.mix(h)
    order = np.lexsort((value, slot))
    first = order[ta.runs(slot[order])]
    sig[slot[first]] = value[first]
    filled = np.zeros(n * bins, bool)
    filled[slot[first]] = True
    open_, tries = np.flatnonzero(~filled), 0
    while len(open_):  # a bin of its own pseudorandom sequence, until one that was filled from the start
        tries += 1
        to = (ta.mix((open_ % bins).astype(U64) * U64(0x9E3779B1) + U64(tries << 40)) >> U64(32)) * U64(bins) >> U64(32)
        source = open_ // bins * bins + to.astype(np.int64)
        hit = filled[source]
        sig[open_[hit]] = sig[source[hit]]
        open_ = open_[~hit]
    sig = sig.reshape(n, bands, rows)
    return ta.combine(np.broadcast_to(np.arange(bands, dtype=U64), (n, bands)).reshape(-1), *(sig[:, :, k].reshape(-1) for k in range(rows))).reshape(n, bands)


def _signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                h, bounds = shingle_sets(t, size)
                n = np.diff(bounds)
                full = n > 0
                two = [np.add.reduceat(ta.mix(h ^ U64(salt)), bounds[:-1][full]) if full.any() else np.zeros(0, U64) for salt in (0, 0x5851F42D4C957F2D)]
                cls = np.full((len(t), 2), 0, U64)
                cls[full] = np.stack(two, 1) if full.any() else cls[full]
                keys, sketch = band_keys(h, bounds, bands, rows), odd_sketches(h, bounds)
                offsets = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, len(t)),
                        pa.array(n.astype(np.int64)),
                        ta.binaries(cls.reshape(-1), np.arange(len(t) + 1) * 2),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(offsets // bands * sketch.shape[1]), pa.array(sketch.reshape(-1))),
                    ],
                    ["doc_id", "n_shingles", "cls", "bands", "sketch"],
                )

    return sign


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                h, bounds = shingle_sets(t, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array(np.diff(bounds)), ta.binaries(h, bounds)], ["doc_id", "size", "shingles"])

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(2), batch.column(3), []
            for k in range(len(batch)):
                x, y = (np.frombuffer(c[k].as_buffer(), U64) for c in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    return confirm


def near_duplicates(documents: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 64, centres: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of texts whose shingle sets overlap: (doc_id, n_shingles, component_id, kept), one row per input row.

    Two documents are linked when 100 * intersection >= percent * union of their
    sets of distinct ``size``-word shingles (words lower-cased A-Z).  A text of
    fewer words is one shingle; null or blank texts are linked with nothing and
    are their own component.  Equal sets are one class and never make pairs.  A
    row without doc_id is linked with nothing: component_id null, kept false.
    A repeated doc_id is one document with the links of any of its texts; each of
    its rows is returned with its own n_shingles.  Similarities at the threshold
    are links.  A long text is one set of 8-byte hashes, in one task at a time.
    Other columns, whatever their names, are ignored; an empty table gives an
    empty result.
    """
    tuned(documents.sparkSession)
    made: list[DataFrame] = []

    def save(df: DataFrame) -> DataFrame:
        made.append(storage.save(df))
        return made[-1]

    bands, rows = plan(percent / 100, bands)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = save(docs.mapInArrow(_signer(size, bands, rows), "doc_id long, n_shingles long, cls binary, bands array<long>, sketch array<long>"))
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = save(some.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("sign")).select("cls", "rep", "sign.*"))
    rows_ = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = save(rows_.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"))
    members = save(rows_.join(shared, "bucket").select("bucket", "rep", "members"))
    forget(shared)

    # The centre of a bucket is the member that meets most others over all buckets.
    degree = members.groupBy("rep").agg(F.sum(F.col("members") - 1).alias("degree"))
    ranked = save(members.join(degree, "rep").select("bucket", "rep", F.struct(-F.col("degree"), "rep").alias("rank")))
    heads = save(ranked.groupBy("bucket").agg(F.min("rank")["rep"].alias("centre")))
    edges = save(ranked.join(heads, "bucket").filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    ends = save(edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct())
    sets = save(only_ids(docs, ends, "doc_id").mapInArrow(_sets(size), "doc_id long, size long, shingles binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"), F.col("size").alias("ny")), "b")
        with_a = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"), F.col("size").alias("nx")), "a")
        fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
        return with_a.filter(fits).select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")

    # A doc_id with several texts is in several classes: their representatives are linked through it.
    several = save(some.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("doc_id"))
    through = some.select("doc_id", "cls").join(several, "doc_id", "left_semi").distinct().join(reps.select("cls", "rep"), "cls").select("doc_id", "rep")
    least = through.groupBy("doc_id").agg(F.min("rep").alias("a"))
    through = through.join(least, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    links = save(confirmed(edges).union(through))
    linked = save(components(links))
    forget(members, heads)
    done, common, tested = 0, None, edges
    sketches = reps.select(F.col("rep").alias("doc_id"), "sketch")
    words = SKETCH // 64
    differ = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("ka", F.lit(k)))) for k in range(words)), F.lit(0))
    most = (100 - percent) / (100 + percent) * (F.col("size") + F.col("sa"))
    while True:
        # Buckets with more than one component whose members may still be linked.
        now = ranked.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        if common is None:
            mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
            now = save(now.join(save(mixed), "bucket"))
            full = now
            for _ in range(3):  # texts that prove unlinkable make more shingles of the others their own
                unsure = full.select(F.col("rep").alias("doc_id")).distinct()
                once = sets.join(unsure, "doc_id", "left_semi").mapInArrow(_exploded, "doc_id long, shingle long")
                alone = once.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
                common = save(
                    sets.select("doc_id", "size").join(unsure, "doc_id", "left_semi").join(alone, "doc_id", "left").join(sketches, "doc_id")
                    .select("sketch", F.col("doc_id").alias("rep"), "size", ((F.col("size") - F.coalesce("alone", F.lit(0))) * (1 + 100 / percent) - F.col("size") + 1e-6).alias("cap"))
                )
                full = save(full.select("bucket", "rep", "component").join(common, "rep"))
                frame = full.groupBy("bucket").agg(F.min("size").alias("least"), F.max("cap").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo < hi")
                full = save(full.join(save(frame), "bucket").filter("least <= cap and most >= size").select("bucket", "rep", "component", "size", "cap", "sketch", "members"))
            # Places are dealt out by a hash, without a sort per bucket; a few members may share one.
            full = full.withColumn("place", F.floor(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30) * F.col("members")))
            ranked = save(full.select("bucket", "rep", "size", "cap", "place", "sketch"))
            sets = save(sets.join(common.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
            continue
        heads = now.filter(F.col("place").between(done, done + centres - 1)).select("bucket", F.col("rep").alias("a"), F.col("place").alias("at"), F.col("component").alias("ca"), F.col("size").alias("sa"), F.col("cap").alias("pa"), F.col("sketch").alias("ka"))
        pairs = now.join(save(heads), "bucket").filter("(place > at or place = at and rep > a) and component <> ca and size <= pa and sa <= cap").filter(differ <= most)
        pairs = save(pairs.select("a", F.col("rep").alias("b")).filter("a <> b").distinct().join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        new = save(confirmed(pairs))
        if new.head(1):
            links = save(links.union(new))
            linked = save(components(links))
        done, centres = done + centres, centres * 4
        if not ranked.filter(F.col("place") >= done).head(1):
            break
    classes = reps.select("cls", "rep").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    classes = save(classes)
    forget(*(df for df in made if df is not signed and df is not classes))
    out = some.join(classes, "cls").select("doc_id", "n_shingles", "component")
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component"))
    return out.union(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def deduplicated(documents: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one document of each group of near copies: the smallest doc_id, in the first of its rows by a hash of the whole row.

    Rows without doc_id stay, and so do blank texts, one row for each doc_id.
    Columns are untouched, whatever their names; links, ties, very long texts and
    empty tables are as in ``near_duplicates``.
    """
    key = F.col("doc_id").cast("long")
    found = near_duplicates(documents, size=size, percent=percent).filter("doc_id is not null")
    marks = storage.save(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    stay = without_keys(documents, key, storage.save(marks.filter("not kept").select("doc_id")))
    again = storage.save(marks.filter("kept and n > 1").select("doc_id"))
    if not again.head(1):
        return stay
    rows = only_ids(packed(stay, key.alias("key")), again.toDF("key"), "key")
    first = rows.groupBy("key").agg(F.min_by("d", F.xxhash64(F.to_json("d"))).alias("d"))
    return without_keys(stay, key, again).union(first.select("d.*"))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 200):
            part = batch.slice(k, 200)
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(part)), [len(x) for x in each]))), pa.array(np.concatenate(each))], ["doc_id", "shingle"])
