"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``least`` words shared by a document and a test item, found
by their hash.  For each (document, item) pair whose seeds could cover enough of
the item, running Karp-Rabin matching repeatedly marks the longest match that
overlaps no marked one, in either text, until none of ``least`` words is left.
Matches found by hash are verified word by word (words are 64-bit hashes).  A document that
covers enough of an item's words with tiles, in whatever order, is contaminated.

The item side is dealt out in blocks of a fixed number of words, each broadcast
by itself, so neither the benchmark's size nor the corpus's decides what a task
holds; all of a document's work on a block is done where the document is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import save, tuned, without_keys

U64 = np.uint64
#: Bytes of test items that one block, and so one broadcast, holds at most (a longer item is a block of its own).
BLOCK_BYTES = 8 << 20


#: Window pairs that are looked at together.
CHUNK = 1 << 20


def prefixes(x: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all prefixes: ``out[k]`` is the polynomial of the first k values."""
    powers, _ = ta._power_tables(len(x) + 1)
    out = np.zeros(len(x) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(ta.mix(x) * powers[: len(x)], out=out[1:])
    return out


def spans(p: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of ``size`` values from ``at`` on, wherever they are."""
    _, inverses = ta._power_tables(len(p))
    with np.errstate(over="ignore"):
        return (p[at + size] - p[at]) * inverses[at]


def matches(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches of ``least`` values or more: (begin in item, begin in doc, size).

    Windows of ``least`` values with one hash are paired, ``CHUNK`` pairs at a
    time; those that could begin one earlier are inside another match.  The rest
    is extended by bisection on span hashes, and then verified value by value.
    """
    pi, pd = prefixes(item), prefixes(doc)
    n = len(doc) - least + 1
    if n <= 0 or len(item) < least:
        return (np.zeros(0, np.int64),) * 3
    a = spans(pi, np.arange(len(item) - least + 1), np.full(1, least))
    b = spans(pd, np.arange(n), np.full(1, least))
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    some = np.flatnonzero(hi > lo)
    done = np.concatenate(([0], np.cumsum((hi - lo)[some])))
    out: list[list[np.ndarray]] = [[], [], []]
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(done, done[at] + CHUNK, "right")) - 1)
        now = some[at:to]
        count = (hi - lo)[now]
        j = np.repeat(now, count)
        i = order[np.repeat(lo[now], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
        begins = (i == 0) | (j == 0)
        begins |= item[i - 1] != doc[j - 1]
        i, j = i[begins], j[begins]
        low, high = np.full(len(i), least), np.minimum(len(item) - i, len(doc) - j)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = spans(pi, i, mid) == spans(pd, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        for x, y in zip(out, (i, j, low)):
            x.append(y)
        at = to
    i, j, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    true = np.array([(item[x : x + s] == doc[y : y + s]).all() for x, y, s in zip(i, j, size)], bool)
    return i[true], j[true], size[true]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (begin in item, begin in doc, words), longest first, ties by item then doc.

    Marking a match cuts the others, so each round takes the longest of what is left.
    """
    heap = [(-int(s), int(x), int(y)) for x, y, s in zip(*matches(item, doc, least))]
    heapq.heapify(heap)
    used_i, used_j = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while heap:
        size, x, y = heapq.heappop(heap)
        size = -size
        marked = used_i[x : x + size] | used_j[y : y + size]
        if not marked.any():
            used_i[x : x + size] = used_j[y : y + size] = True
            out.append((x, y, size))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], marked, [True]))))
        for p, q in zip(edge[::2], edge[1::2]):  # unmarked stretches
            if q - p >= least:
                heapq.heappush(heap, (-(int(q - p)), x + int(p), y + int(p)))
    return out


class Items:
    """A block of test items: word hashes end to end, and a sorted list of their seeds with the place of each."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.least, self.ids = least, ids
        words = [ta.words_of(t, lower=True, breaks=ta.IS_BREAK) for t in ta.slices(pa.array(texts, pa.large_string()))]
        self.hash = np.concatenate([w.hash for w in words])
        self.counts = np.concatenate([w.counts for w in words])
        self.bounds = np.concatenate(([0], np.cumsum(self.counts)))
        owner = np.repeat(np.arange(len(ids)), self.counts)
        seeds, at = ta.window_hashes(ta.Words(owner, owner, owner, self.hash, self.counts), least)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.place, self.owner = seeds[order], at[order], owner

    def of(self, k: int) -> np.ndarray:
        return self.hash[self.bounds[k] : self.bounds[k + 1]]

    def pairs(self, w: ta.Words, coverage: float) -> np.ndarray:
        """(document, item) pairs whose shared seeds cover enough of the item: tiles lie inside what seeds cover, so no other pair can pass."""
        h, at = ta.window_hashes(w, self.least)
        lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        some = np.flatnonzero(hi > lo)
        key = ta.combine(w.doc[at[some]].astype(U64), h[some])
        _, first = np.unique(key, return_index=True)  # a seed counts once per document
        some = some[np.sort(first)]
        done = np.concatenate(([0], np.cumsum((hi - lo)[some])))
        out, k = [], 0
        while k < len(some):  # whole documents, about ``CHUNK`` hits at a time
            to = max(k + 1, int(np.searchsorted(done, done[k] + CHUNK, "right")) - 1)
            docs = w.doc[at[some]]
            to = int(np.searchsorted(docs, docs[to - 1], "right"))
            now = some[k:to]
            n = (hi - lo)[now]
            place = self.place[np.repeat(lo[now], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            pair = np.repeat(w.doc[at[now]], n).astype(np.int64) * len(self.ids) + self.owner[place]
            order = np.lexsort((place, pair))
            pair, place = pair[order], place[order]
            gap = np.full(len(pair), self.least)
            follows = pair[1:] == pair[:-1]
            gap[:-1][follows] = np.minimum(self.least, place[1:] - place[:-1])[follows]
            begins = ta.runs(pair)
            covered = np.add.reduceat(gap, begins)
            out.append(pair[begins][covered >= coverage * self.counts[pair[begins] % len(self.ids)]])
            k = to
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _tiler(model, coverage: float):
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = model.value
        for batch in batches:
            ids = batch.column(0)
            for t in ta.slices(batch.column(1)):
                w = ta.words_of(t, lower=True, breaks=ta.IS_BREAK)
                bounds, rows = w.bounds, []
                for p in items.pairs(w, coverage):
                    d, k = divmod(int(p), len(items.ids))
                    found = tiles(items.of(k), w.hash[bounds[d] : bounds[d + 1]], items.least)
                    covered = sum(size for _, _, size in found)
                    if covered >= coverage * items.counts[k]:
                        rows.append((d, items.ids[k], len(found), covered, int(items.counts[k])))
                if rows:
                    d, k, n, c, m = (np.array(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays([ids.slice(t.first, len(t)).take(pa.array(d)), *(pa.array(x, pa.int64()) for x in (k, n, c, m))], ["doc_id", "item_id", "n_tiles", "covered_words", "item_words"])

    return tile


def item_blocks(benchmark: DataFrame, least: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of bounded size, read one block at a time; equal rows count once."""
    rows = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text")
    ids, texts, held = [], [], 0
    for item, text in rows.toLocalIterator():
        size = len(text.encode())
        if ids and held + size > block_bytes:
            yield Items(ids, texts, least)
            ids, texts, held = [], [], 0
        ids.append(item)
        texts.append(text)
        held += size
    if ids:
        yield Items(ids, texts, least)


def contaminated(documents: DataFrame, benchmark: DataFrame, *, least: int = 5, coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, coverage, contaminated) of each contaminated pair.

    Words are runs of letters and digits, lower-cased A-Z.  A pair is returned
    when tiles of ``least`` words or more cover at least ``coverage`` of the
    item's words; ``contaminated`` is true in every row.  Of tiles of one length
    the first in the item, then in the document, is marked first.  Items shorter
    than ``least`` words, and null or empty texts on either side, match nothing;
    a null item_id is no item.  Repeated document rows are judged each; equal
    item rows once, and one item_id with two texts is two items.  A long text is
    tiled whole, in memory proportional to its words and matches.  A document
    without doc_id is judged too.  Other columns, whatever their names, are
    ignored; an empty table on either side gives an empty result.

    The corpus is read once per ``block_bytes`` of items.  Of several blocks,
    each is done and written before the next is broadcast.
    """
    tuned(documents.sparkSession)
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, item_id long, n_tiles long, covered_words long, item_words long"
    out, blocks = spark.createDataFrame([], kind), item_blocks(benchmark, least, block_bytes)
    items = next(blocks, None)
    several = False
    while items is not None:
        after = next(blocks, None)
        several |= after is not None
        model = spark.sparkContext.broadcast(items)
        part = docs.mapInArrow(_tiler(model, coverage), kind)
        if several:
            part = save(part)
            model.destroy()
        out, items = out.union(part) if several else part, after
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words")).withColumn("contaminated", F.lit(True))


def without_contaminated(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that are in no contaminated pair; rows without doc_id stay, and so does every column, whatever its name."""
    return without_keys(documents, F.col("doc_id").cast("long"), save(found.filter("doc_id is not null").select("doc_id").distinct()))
