"""Mixing sources to target weights by index permutation of fixed-length blocks.

The words of a source, in the order of doc_id, are one stream that is packed
into blocks of ``block`` words.  The mix has as many slots of each source as
its target needs.  Output shards of fixed size draw their source counts from
the multinomial law, conditioned on those totals (drawing without replacement),
so every shard is a random mix and the totals still meet the targets.  The draws
are made where the slots are made: shards are the leaves of binary trees whose
nodes split their counts in two, and a task draws the path to its own leaves.
Slot k of a source takes block ``permute(k mod n)`` of pass ``k div n``, where ``permute``
is a keyed pseudorandom permutation of the n whole blocks: no block comes
again before all others of its source came, and nothing is sorted or stored.
The short block at the end of a stream is the last of each pass, and the last slot of a
source takes only the words that its target still lacks.
Documents meet their slots by joining on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textarrays as ta
from .common import forget, packed, running_total, save, tuned

U64 = np.uint64
#: Weights of the sources in their order, repeating (fixed values).
WEIGHTS = (3, 1, 2)
#: Shards under one tree; trees share the totals in proportion, so the draws stay far below numpy's limit of 1e9.
TREE = 1024
#: Sources up to which their table (about 100 bytes each) is broadcast to the documents; beyond, it is joined by a shuffle.
FEW_SOURCES = 100_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [ta.words_of(t).counts for t in ta.slices(batch.column(2))]
        size = pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, batch.column(3), batch.column(4)], ["row", "source", "size", "doc_id", "tie"])


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares of ``share`` * total by weight; none above ``most`` times its size, the excess reshared by weight."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [k for k, n in enumerate(sizes) if n > 0]
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            return out
        for k in full:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 for each row: four Feistel rounds on the least even number of bits, repeated until the result is below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(2, n)) / 2).astype(np.int64)).astype(U64)
    mask = (U64(1) << half) - U64(1)
    out, todo = index.astype(U64), np.arange(len(index))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (ta.combine(right, key[todo], np.full(len(todo), r, U64)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(U64)]
    return out.astype(np.int64)


def halves(counts: np.ndarray, left: int, seed: list[int]) -> np.ndarray:
    """Of ``counts`` things of each kind, how many of each are among ``left`` drawn without replacement."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.multivariate_hypergeometric(counts, left, method="marginals")


def shard_counts(quotas: np.ndarray, shard: int, per_shard: int, seed: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, slots of each source) of ``most`` shards from ``shard`` on.

    Every shard's counts depend on the seed alone, whoever draws them.
    """
    total = int(quotas.sum())
    shards = -(-total // per_shard)
    trees = -(-shards // TREE)

    def leaves(tree: int, lo: int, hi: int, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= shard or lo >= shard + most:
            return
        if hi - lo == 1:
            yield lo, first, counts
            return
        mid = (lo + hi) // 2
        in_left = halves(counts, int(counts.sum()) * (mid - lo) // (hi - lo), [seed, tree, lo, hi])
        yield from leaves(tree, lo, mid, first, in_left)
        yield from leaves(tree, mid, hi, first + in_left, counts - in_left)

    for tree in range(shard // TREE, min(trees, (shard + most - 1) // TREE + 1)):
        lo, hi = tree * TREE, min(shards, (tree + 1) * TREE)
        begin, end = (np.array([int(q) * x // shards for q in quotas], np.int64) for x in (lo, hi))
        yield from leaves(tree, lo, hi, begin, end - begin)


def quota(size: int, goal: float, block: int, most: float) -> tuple[int, int]:
    """Slots of a source of ``size`` words, and the words that its last slot takes, so that all together take ``goal`` words."""
    if not size:
        return 0, 0
    words = min(round(goal), int(most * size))
    passes, rest = divmod(words, size)
    slots = passes * -(-size // block) + -(-rest // block)
    return slots, (rest or size) - ((rest or size) - 1) // block * block if slots else 0


def _slots(model, block_words: int, per_shard: int, per_task: int, seed: int):
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotas, whole, blocks, last = model.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for shard, first, counts in shard_counts(quotas, task * per_task, per_shard, seed, per_task):
                    some = np.flatnonzero(counts)
                    source = np.repeat(some, counts[some])
                    place = np.arange(len(source))
                    k = place - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some]) + first[source]
                    step, turn = k % blocks[source], k // blocks[source]
                    block, at = step.copy(), np.flatnonzero(step < whole[source])
                    block[at] = permute(step[at], whole[source[at]], ta.combine(source[at].astype(U64), turn[at].astype(U64)))
                    words = np.where(k == quotas[source] - 1, last[source], block_words)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard, np.int64)), pa.array(place), pa.array(source.astype(np.int32)), pa.array(turn), pa.array(block), pa.array(words)], ["mix_shard", "slot", "source_no", "pass", "block", "words"])

    return slots


class Mix:
    """Rows (row, doc_id, source, text) with their place in the source's stream, and the slots that take blocks of it.

    ``placed``: row, doc_id, source_no, size, source_size, target, start; one per
    input row.  ``slots``: mix_shard, slot, source_no, pass, block, words (taken of
    the block, from its begin).  The driver holds a name and a few numbers for each source, and
    raises an error beyond ``most_sources`` of them.
    """

    def __init__(self, rows: DataFrame, *, share: float = 1.5, most: float = 2.0, block: int = 256, slots_per_shard: int = 16384, shards_per_task: int = 4, seed: int = 11, most_sources: int = 1_000_000):
        spark = rows.sparkSession
        tuned(spark)
        self.block, self.saved = block, []
        named = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
        named = named.select("row", "source", "text", "doc_id", F.xxhash64("doc_id", "source", "text").alias("tie"))
        sized = self._save(named.mapInArrow(_sizes, "row long, source string, size long, doc_id long, tie long"))
        each = self._save(sized.groupBy("source").agg(F.sum("size").alias("size")))
        if (n := each.count()) > most_sources:
            raise ValueError(f"{n} sources; the plan is made for {most_sources} at most")
        found = {r[0]: r[1] for r in each.toLocalIterator()}
        names = sorted(x for x in found if x is not None) + [None] * (None in found)
        sizes = [found[x] for x in names]
        goals = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(names))], share, most)
        blocks, whole = (np.array([n // block + (up and n % block > 0) for n in sizes], np.int64) for up in (True, False))
        quotas, last = np.array([quota(n, t, block, most) for n, t in zip(sizes, goals)], np.int64).reshape(-1, 2).T
        shards = -(-int(quotas.sum()) // slots_per_shard)
        tasks = -(-shards // shards_per_task)
        model = spark.sparkContext.broadcast((quotas, whole, blocks, last))
        plan = spark.range(0, tasks, 1, max(1, min(tasks, 100_000)))
        self.slots = self._save(plan.mapInArrow(_slots(model, block, slots_per_shard, shards_per_task, seed), "mix_shard long, slot long, source_no int, pass long, block long, words long"))
        model.destroy()
        about = spark.createDataFrame([(x, k, sizes[k], float(goals[k])) for k, x in enumerate(names)], "name string, source_no int, source_size long, target double")
        known = sized.join(F.broadcast(about) if len(names) <= FEW_SOURCES else about, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
        self.placed = self._save(running_total(known, "source_no", ["doc_id", "tie", "row"], "size", "start"))

    def _save(self, df: DataFrame) -> DataFrame:
        self.saved.append(save(df))
        return self.saved[-1]

    def pieces(self) -> DataFrame:
        """(row, pass, lo, hi): spans of words of each row that slots take, hi exclusive; rows are cut at block borders, and a block is in two passes at most."""
        n, start, end = F.lit(self.block), F.col("start"), F.col("start") + F.col("size")
        cut = self.placed.filter("size > 0").select("row", "source_no", "start", "size", F.explode(F.sequence(F.floor(start / n), F.floor((end - 1) / n))).alias("block"))
        cut = cut.withColumn("lo", F.greatest(start, F.col("block") * n) - start).withColumn("hi", F.least(end, (F.col("block") + 1) * n) - start)
        taken = cut.join(self.slots.select("source_no", "block", "pass", "words"), ["source_no", "block"])
        return taken.withColumn("hi", F.least("hi", F.col("block") * n + F.col("words") - start)).filter("lo < hi").select("row", "pass", "lo", "hi")


def mix_report(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``documents``.

    ``size`` counts the words of the whole text, however long (null or empty
    text: 0).  Sources are ordered by code point, null last, and weigh 3, 1, 2,
    repeating; a source without words has target 0.  A word is taken once per
    pass of its block; a block is in two passes at most, so ``taken`` is at most
    twice ``size``.  Rows that repeat a doc_id, or whole rows that repeat, are
    rows of their own; among equal doc_ids the order is that of a hash of the
    row, and equal rows share out their places.  A null doc_id comes first in its
    source.  Reruns agree, however the table is partitioned.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    mix = Mix(rows, **options)
    took = mix.pieces().groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return mix.placed.join(took, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(columns: list[str]):
    """Rows (d: the document's columns, los, his: spans of words in order) to documents whose text is those words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                fields = dict(zip(columns, part.column(0).flatten()))
                los, his = (part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
                ends = np.cumsum(part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                out = []
                for t in ta.slices(fields["text"]):
                    w = ta.words_of(t)
                    bounds = w.bounds
                    for k in range(len(t)):
                        to = ends[t.first + k]
                        lo, hi = (x[ends[t.first + k - 1] if t.first + k else 0 : to] for x in (los, his))
                        if hi[-1] - lo[0] == w.counts[k] and (lo[1:] == hi[:-1]).all():
                            out.append(t.data[t.offsets[k] : t.offsets[k + 1]].tobytes())
                            continue
                        first = np.concatenate(([True], lo[1:] != hi[:-1]))  # spans that touch are one
                        runs = zip(w.start[bounds[k] + lo[first]], w.end[bounds[k] + hi[np.append(first[1:], True)] - 1])
                        out.append(b"\n".join(t.data[a:b].tobytes() for a, b in runs))
                fields["text"] = pa.array([x.decode("utf-8", "replace") for x in out], pa.string())
                if "n_chars" in fields:
                    fields["n_chars"] = pc.utf8_length(fields["text"]).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(list(fields.values()), columns)

    return cut


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents with the input's columns: one row per document and pass that takes words of it, its text cut to those words.

    A document whose words are taken twice comes twice; one that no slot takes,
    and so one without words, is left out.  ``n_chars``, where present, is that
    of the cut text, a long; other columns, whatever their names, are passed on.
    Words cut out of the middle leave a line break.  Nulls, repeats, ties, very long texts
    and empty tables are as in ``mix_report``.  Texts are written once with a
    row number and shuffled once, to meet their spans.
    """
    tuned(documents.sparkSession)
    kinds = StructType([StructField("n_chars", LongType()) if f.name == "n_chars" else StructField(f.name, f.dataType) for f in documents.schema.fields])
    rows = save(packed(documents, F.monotonically_increasing_id().alias("row")))
    mix = Mix(rows.select("row", *(F.col("d")[c].alias(c) for c in ("doc_id", "source", "text"))), **options)
    spans = mix.pieces().groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    spans = save(spans.select("row", F.col("spans.lo").alias("los"), F.col("spans.hi").alias("his")))
    forget(*mix.saved)
    return rows.join(spans, "row").select("d", "los", "his").mapInArrow(_cut(documents.columns), kinds)
