"""Jaccard join of n-gram sets by vertical partitioning.

All n-grams that may count are put into one global order, rare ones first, and
the order is cut into fragments of about equal weight.  A set becomes one
segment for each fragment it touches; the overlap of two sets is the sum of
their overlaps in the fragments, each counted on its own, so no task holds a whole
set, and a very common n-gram weighs on one fragment only.

Which pairs are counted follows from the same order.  A set of n grams that is
linked at threshold t has at least q = ceil(t * n) grams in common with its partner, so
the two share a gram among the first n - q + 1 of each.  Sets that cannot reach q
with grams of other sets are dropped before anything is paired.  Equal sets are
one.  The sets of a gram are paired with one centre first, not with each other; after
that only pairs of different components are looked at, and only if their sizes, the
grams that they share with any other set, and their odd sketches let them be linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as storage
from . import textarrays as ta
from .common import components, forget, only_ids, tuned
from .minhash import SKETCH, odd_sketches, shingle_sets

U64 = np.uint64
_SALTS = (0, 0x5851F42D4C957F2D)


def least_common(n, percent: int):
    """The smallest overlap of a linked set of ``n`` grams; whole numbers or a column."""
    return (n * percent + 99) // 100 if not isinstance(n, Column) else F.floor((n * percent + 99) / 100)


def _classes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set, zero for the empty one."""
    full = np.diff(bounds) > 0
    out = np.zeros((len(full), 2), U64)
    if full.any():
        out[full] = np.stack([np.add.reduceat(ta.mix(h ^ U64(salt)), bounds[:-1][full]) for salt in _SALTS], 1)
    return out


def _signer(size: int, percent: int):
    """Class and size of each set, and its lowest hashes: enough that two linked sets share at least a tenth of the smaller's least overlap among them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                h, bounds = shingle_sets(t, size)
                n = np.diff(bounds)
                low = np.minimum(n, n - least_common(n, percent) + np.maximum(1, n // 10))
                ends = np.cumsum(low)
                at = np.arange(int(ends[-1])) + np.repeat(bounds[:-1] - ends + low, low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, len(t)), pa.array(n), ta.binaries(_classes(h, bounds).reshape(-1), np.arange(len(t) + 1) * 2), ta.binaries(h[at], np.concatenate(([0], ends)))],
                    ["doc_id", "n", "cls", "low"],
                )

    return sign


def _sets(size: int):
    """Class, grams and odd sketch of each set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in ta.slices(batch.column(1)):
                h, bounds = shingle_sets(t, size)
                sketch = odd_sketches(h, bounds)
                ends = np.concatenate(([0], np.cumsum(np.diff(bounds) > 0))) * sketch.shape[1]
                columns = [batch.column(0).slice(t.first, len(t)), ta.binaries(_classes(h, bounds).reshape(-1), np.arange(len(t) + 1) * 2), ta.binaries(h, bounds), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sketch.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "cls", "grams", "sketch"])

    return sets


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, gram) of (node, n, binary), a bounded number of rows at a time."""
    for batch in batches:
        node, n, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for k in range(0, len(batch), 100):
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in grams.slice(k, 100)]
            size = [len(x) for x in each]
            columns = [np.repeat(node[k : k + 100], size), np.repeat(n[k : k + 100], size), np.concatenate(each)]
            for at in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in columns], ["node", "n", "gram"])


def _shared(sets: DataFrame, column: str) -> DataFrame:
    """(node, alone): how many grams of each set no other set has; a node without such grams is absent."""
    each = sets.select("node", "n", column).mapInArrow(_exploded, "node long, n long, gram long")
    return each.groupBy("gram").agg(F.count("*").alias("sets"), F.min("node").alias("node")).filter("sets = 1").groupBy("node").agg(F.count("*").alias("alone"))


def fragments_of(weights: dict[int, int], fragments: int) -> dict[int, tuple[int, int]]:
    """Level -> (first fragment, number of fragments), by weight, at least one each."""
    total, out, at = sum(weights.values()), {}, 0
    for level in sorted(weights):
        out[level] = (at, max(1, round(fragments * weights[level] / total)))
        at += out[level][1]
    return out


def segments_of(sets: DataFrame, fragments: int) -> DataFrame:
    """(node, n, fragment, grams): the grams of each set (node, n, grams) that other sets have too, cut by the global order, sorted inside a fragment.

    The order is (binary logarithm of the number of sets, gram).  Cuts lie at
    levels and, inside a level, at equal steps of the gram's hash.
    """
    each = sets.select("node", "n", "grams").mapInArrow(_exploded, "node long, n long, gram long")
    counts = storage.save(each.groupBy("gram").agg(F.count("*").alias("sets")).filter("sets > 1").select("gram", F.floor(F.log2("sets")).cast("int").alias("level"), "sets"))
    cuts = fragments_of({r.level: r.n for r in counts.groupBy("level").agg(F.sum("sets").alias("n")).collect()}, fragments)  # a level for each power of two
    if not cuts:
        return counts.sparkSession.createDataFrame([], "node long, n long, fragment int, grams array<long>")
    rank = F.col("gram").cast("double") / 2.0**64 + 0.5
    fragment = F.coalesce(*[F.when(F.col("level") == level, first + F.least(F.floor(rank * n), F.lit(n - 1))) for level, (first, n) in cuts.items()])
    placed = each.join(counts, "gram").select("node", "n", fragment.cast("int").alias("fragment"), "gram")
    out = storage.save(placed.groupBy("node", "n", "fragment").agg(F.sort_array(F.collect_list("gram")).alias("grams")))
    forget(counts)
    return out


#: Tasks over which the pairs of one centre spread.
SALTS = 64


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``pairs`` (a, b and more) that overlap, with ``common``: partial overlaps of the fragments, summed up.

    The pairs of a centre ``a`` spread over 64 salts, and its segments are
    joined once for each salt that needs them, so a centre with a million partners is no hot key.
    """
    parts = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    first = parts.select("a", "salt").distinct().join(segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("x")), "a")
    half = parts.join(first, ["a", "salt"])
    both = half.join(segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("y")), ["b", "fragment"])
    partial = both.select(*pairs.columns, F.size(F.array_intersect("x", "y")).cast("long").alias("partial")).filter("partial > 0")
    return partial.groupBy(*pairs.columns).agg(F.sum("partial").alias("common"))


def jaccard_components(documents: DataFrame, *, size: int = 5, percent: int = 80, fragments: int = 16, centres: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents reachable from each other by links: (doc_id, n_shingles, component_id), one row per input row.

    Two documents are linked when 100 * intersection >= percent * union of their
    sets of distinct ``size``-word shingles (words lower-cased A-Z); a similarity at the
    threshold is a link.  A text of fewer words is one shingle; a null or blank
    text is linked with nothing and is its own component.  A row without
    doc_id is linked with nothing and has no component.  A repeated doc_id is one
    document with the links of any of its texts; each of its rows is returned with its own
    n_shingles.  Other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    tuned(documents.sparkSession)
    made: list[DataFrame] = []

    def save(df: DataFrame) -> DataFrame:
        made.append(storage.save(df))
        return made[-1]

    docs = documents.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    signed = save(docs.mapInArrow(_signer(size, percent), "doc_id long, n long, cls binary, low binary"))
    some = signed.filter("n > 0 and doc_id is not null")
    classes = save(some.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    links, linked = _links(docs, some, classes, save, size, percent, fragments, centres)

    # A doc_id with several texts links their classes.
    several = save(some.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("doc_id"))
    if several.head(1):
        through = some.select("doc_id", "cls").join(several, "doc_id", "left_semi").distinct().join(classes.select("cls", "node"), "cls").select("doc_id", "node")
        through = through.join(through.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a < node").select("a", F.col("node").alias("b"))
        linked = components(save(links.union(through)))

    group = F.coalesce("component", "node")
    grouped = save(classes.join(linked, "node", "left").select("cls", "rep", group.alias("group")))
    names = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    final = save(grouped.join(names, "group").select("cls", "component_id"))
    forget(*(df for df in made if df is not signed and df is not final))
    found = some.select("doc_id", "n", "cls").join(final, "cls").select("doc_id", "n", "component_id")
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    return found.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _candidates(docs: DataFrame, some: DataFrame, classes: DataFrame, save, size: int, percent: int) -> DataFrame:
    """(node, n, grams, sketch) of the sets that other sets may reach: first by their lowest hashes, then by all."""
    mine = classes.select(F.col("rep").alias("doc_id"), "cls", "node", "n")
    low = only_ids_with(some.select("doc_id", "cls", "low"), mine, ["doc_id", "cls"]).select("node", "n", "low")
    low = save(low)
    reach = F.greatest(F.lit(1), F.floor(least_common(F.col("n"), percent) / 10))
    lows = low.select("node", "n", (F.octet_length("low") / 8).alias("lows")).join(_shared(low, "low"), "node", "left")
    near = save(lows.filter(F.col("lows") - F.coalesce("alone", F.lit(0)) >= reach).select("node").distinct())
    forget(low)
    mine = save(mine.withColumnRenamed("doc_id", "rep").join(near, "node", "left_semi"))
    sets = only_ids(docs, mine.select("rep").distinct(), "rep").mapInArrow(_sets(size), "rep long, cls binary, grams binary, sketch array<long>")
    sets = save(only_ids_with(sets, mine, ["rep", "cls"]).select("node", "n", "grams", "sketch"))
    if sets.count() > mine.count():  # a row of the table that is there twice
        sets = save(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("sketch").alias("sketch")))
    reached = save(sets.select("node", "n").join(_shared(sets, "grams"), "node", "left").filter(F.col("n") - F.coalesce("alone", F.lit(0)) >= least_common(F.col("n"), percent)).select("node"))
    return save(only_ids(sets, reached, "node", most=1_000_000))


def only_ids_with(df: DataFrame, ids: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """``df`` joined with ``ids`` on ``keys``; ids are counted first and broadcast up to ``most``, so that wide rows stay where they are."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, keys)


def _links(docs: DataFrame, some: DataFrame, classes: DataFrame, save, size: int, percent: int, fragments: int, centres: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between classes, enough of them that components are right; and these components (node, component)."""
    sets = _candidates(docs, some, classes, save, size, percent)
    segments = segments_of(sets, fragments)

    # One row for each set: its grams in the global order, of which the first matter; those that no other set has come before all.
    every = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("fragment", "grams"))), lambda x: x["grams"]))
    about = segments.groupBy("node", "n").agg(every.alias("grams")).withColumn("common", F.size("grams")).filter(F.col("common") >= least_common(F.col("n"), percent))
    left = F.col("n") - least_common(F.col("n"), percent) + 1 - (F.col("n") - F.col("common"))
    cap = F.col("common") * (1 + 100 / percent) - F.col("n") + 1e-6
    about = save(about.select("node", "n", cap.alias("cap"), "common", F.slice("grams", 1, left.cast("int")).alias("first")))
    index = about.select(F.explode("first").alias("gram"), "node", "n", "cap", "common")

    # Centre of a gram: the member with most grams in common with others; the same for the grams of a group.
    frame = index.groupBy("gram").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("cap").alias("most"), F.max(F.struct("common", "node", "n", "cap")).alias("head")).filter("members > 1")
    frame = save(frame.select("gram", "least", "most", F.col("head.node").alias("a"), F.col("head.n").alias("na"), F.col("head.cap").alias("ca")))
    listed = save(index.join(frame, "gram").filter("least <= cap and most >= n").select("gram", "node", "n", "cap", "a", "na", "ca"))
    pair = ["a", "b", "na", "nb"]

    def confirmed(pairs: DataFrame) -> DataFrame:
        found = overlaps(pairs, segments)
        return save(found.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"))

    tested = save(listed.filter("node <> a and n <= ca and na <= cap").withColumnsRenamed({"node": "b", "n": "nb"}).select(*pair).distinct())
    links = confirmed(tested)
    linked = save(components(links))

    # What is left: members outside the largest component of their gram, each with all members of other components.
    label = F.coalesce("component", "node")
    now = save(listed.select("gram", "node", "n", "cap").join(linked, "node", "left").select("gram", "node", "n", "cap", label.alias("component")))
    sizes = now.groupBy("gram", "component").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("cap").alias("most"))
    main = sizes.groupBy("gram").agg(F.max_by("component", F.struct("members", "component")).alias("main"), (F.sum("members") - F.max("members")).alias("others"), F.min("least").alias("least"), F.max("most").alias("most")).filter("others > 0")
    place = F.floor(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30) * F.col("others"))
    open_ = now.join(save(main), "gram").filter("least <= cap and most >= n")
    open_ = open_.select("gram", "node", "n", "cap", F.when(F.col("component") != F.col("main"), place).alias("place"))
    open_ = save(open_.join(sets.select("node", "sketch"), "node"))
    # Sets of a linked pair differ in few elements, and their odd sketches in no more bits.
    differ = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("ka", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
    most = (100 - percent) / (100 + percent) * (F.col("n") + F.col("na")) + 1e-6
    last, done = open_.agg(F.max("place")).first()[0], 0
    while last is not None and done <= last:
        now = open_.join(linked, "node", "left").withColumn("component", label)
        heads = save(now.filter(F.col("place").between(done, done + centres - 1)).select("gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("cap").alias("ca"), F.col("place").alias("at"), F.col("component").alias("of"), F.col("sketch").alias("ka")))
        once = F.col("place").isNull() | (F.col("place") > F.col("at")) | ((F.col("place") == F.col("at")) & (F.col("node") > F.col("a")))
        pairs = now.join(heads, "gram").filter(once).filter("component <> of and n <= ca and na <= cap").filter(differ <= most).withColumnsRenamed({"node": "b", "n": "nb"})
        pairs = save(pairs.select(*pair).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti").select(*pair))
        if pairs.head(1):
            tested = tested.union(pairs)
            new = confirmed(pairs)
            if new.head(1):
                links = save(links.union(new))
                linked = save(components(links))
        done, centres = done + centres, centres * 16
    return links, linked
