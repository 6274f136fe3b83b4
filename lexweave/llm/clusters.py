"""Centroid clustering with an annulus search, in exact integers.

The triangle inequality puts every centroid c that is no farther from x than
some u into the annulus ``| |c| - |x| | <= u``.  Centroids are sorted by norm; the
one whose norm is nearest to |x| gives u, two binary searches give the run of
centroids inside the annulus, and these alone are compared, by exact squared
distances.  Norms are rounded, so the annulus is a little wider than needed;
ties on its edge are inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, tuned

#: Scaled components beyond this have squared distances that no long can hold for certain.
LARGEST = 1 << 27
#: Rows of a partition whose sums fit a long.
MOST_ROWS = 1 << 30
#: Relative width added to an annulus, far above the rounding of a square root.
SLACK = 1e-9


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, np.int64)
        norm = np.sqrt((c * c).sum(1).astype(np.float64))
        self.number = np.argsort(norm, kind="stable")
        self.c, self.norm = c[self.number], norm[self.number]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each row, ties to the smaller, its squared distance, and how many distances were computed."""
        size = np.sqrt((v * v).sum(1).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norm, size), len(self.norm) - 1)
        below = np.maximum(above - 1, 0)
        first = np.where(np.abs(self.norm[above] - size) < np.abs(self.norm[below] - size), above, below)
        best = ((v - self.c[first]) ** 2).sum(1)
        who = self.number[first]
        reach = np.sqrt(best.astype(np.float64))
        reach += SLACK * (1 + size + reach)
        lo, hi = np.searchsorted(self.norm, size - reach, "left"), np.searchsorted(self.norm, size + reach, "right")
        done = len(v)
        for j in range(int(lo.min(initial=len(self.norm))), int(hi.max(initial=0))):
            at = np.flatnonzero((lo <= j) & (j < hi) & (first != j))
            if len(at):
                d, number = ((v[at] - self.c[j]) ** 2).sum(1), self.number[j]
                closer = (d < best[at]) | ((d == best[at]) & (number < who[at]))
                best[at[closer]], who[at[closer]] = d[closer], number
                done += len(at)
        return who, best, done


def _kept(dim: int, scale: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
            x = column.take(pa.array(right)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(scale * x)
                fits = (np.abs(v) <= LARGEST).all(1)  # false for what is not finite
            v = v[fits].astype(np.int32)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(v), [None, pa.py_buffer(np.ascontiguousarray(v))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[fits])), rows], ["vec_id", "v"])

    return kept


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.int32).reshape(-1, dim).astype(np.int64)


def _sums(centroids: list[list[int]], dim: int):
    """(cluster, n, sums) of a partition: one row for each centroid that is nearest to some vector of it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, k = Annulus(centroids), len(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)

        def out():
            some = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(total[some].reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists], ["cluster", "n", "sums"])

        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(1), dim)
            who, _, _ = ring.nearest(v)
            order = np.argsort(who, kind="stable")
            begins = np.flatnonzero(np.diff(who[order], prepend=-1))
            of = who[order][begins]
            total[of] += np.add.reduceat(v[order], begins, axis=0)
            n += np.bincount(who, minlength=k)
            if n.max() >= MOST_ROWS:
                yield out()
                n[:], total[:] = 0, 0
        yield out()

    return sums


def _assigned(centroids: list[list[int]], dim: int):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Annulus(centroids)
        for batch in batches:
            if len(batch):
                who, distance, _ = ring.nearest(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return assigned


def cluster_vectors(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k-means over ``floor(scale * x)``: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite, and
    none beyond 2**27 once scaled, where squared distances would leave a long.
    The start centroids are the ``k`` vectors (all, if fewer) with the smallest
    sha256 of ``seed`` and vec_id; repeated ids go by their components' bytes, and rows
    without vec_id come last; both are clustered like all others.  A round takes
    the exact floor of each component's mean; an empty cluster keeps its
    centroid; equal distances go to the smaller number.  An inertia that no long
    holds is null.  Other columns, whatever their names, are ignored; an empty
    table gives an empty result.

    Driver and closures hold k * dim numbers, whatever the table.  A task sends one
    row per cluster and round.
    """
    spark = vectors.sparkSession
    tuned(spark)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = save(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(_kept(dim, scale), "vec_id long, v binary"))
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    if not start:
        return spark.createDataFrame([], names)
    centroids = [np.frombuffer(r.v, np.int32).tolist() for r in start]
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    for _ in range(rounds):
        parts = kept.mapInArrow(_sums(centroids, dim), "cluster int, n long, sums array<long>")
        for r in parts.groupBy("cluster").agg(whole(F.col("n")).alias("n"), *[whole(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dim)]).collect():
            centroids[r.cluster] = [int(r[f"s{d}"]) // int(r.n) for d in range(dim)]
    found = save(kept.mapInArrow(_assigned(centroids, dim), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(whole(F.col("distance")).alias("d")).collect()}
    held = lambda x: x if x < 1 << 63 else None
    total = held(sum(inertia.values()))
    about = [(c, held(d), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(*[c.split()[0] for c in names.split(", ")])
