"""Nearest neighbours, analogies and comparison of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as A

#: Queries that one pass over the vectors answers; bounds what is broadcast.
BLOCK = 4096


def as_double(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, rank, vec_id, score): the ``k`` largest cosines for each query, its excluded ids left out, ties by id.

    ``vectors``: vec_id, vector.  ``queries``: query, vector, exclude (array).
    Queries are dealt out in blocks of ``BLOCK``, each against all vectors with
    one matrix product per Arrow batch; a batch passes on its best k for each
    query, so what is shuffled is k rows per query and batch.
    """
    spark, out = vectors.sparkSession, None
    rows, block = queries.select("query", "vector", "exclude").toLocalIterator(), []
    def answered(block):
        names = [r["query"] for r in block]
        matrix = np.array([r["vector"] for r in block], float)
        unit = matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-8)
        shared = spark.sparkContext.broadcast((names, unit, [set(r["exclude"] or ()) for r in block]))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, unit, exclude = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["vector"].to_numpy())
                score = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)) @ unit.T
                ids = pdf["vec_id"].to_numpy()
                place = np.argsort(ids, kind="stable")
                for q, left in enumerate(exclude):
                    if left:
                        gone = np.fromiter(left, ids.dtype)
                        lo, hi = (np.searchsorted(ids[place], gone, side) for side in ("left", "right"))
                        for a, b in zip(lo[hi > lo], hi[hi > lo]):
                            score[place[a:b], q] = -np.inf
                # All that reach the k-th best score of their query, equal ones too, and of these the first k by id.
                least = np.partition(score, max(0, len(ids) - k), axis=0)[max(0, len(ids) - k)]
                row, q = np.nonzero((score >= least) & (score > -np.inf))
                order = np.lexsort((ids[row], -score[row, q], q))
                row, q = row[order], q[order]
                begins = np.flatnonzero(np.diff(q, prepend=-1))
                rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
                row, q = row[rank < k], q[rank < k]
                yield pd.DataFrame({"query": np.array(names)[q], "vec_id": ids[row], "score": score[row, q]})

        return vectors.select("vec_id", "vector").mapInPandas(best, "query long, vec_id long, score double")

    for r in rows:
        block.append(r)
        if len(block) == BLOCK:
            part, block = answered(block), []
            out = part if out is None else out.union(part)
    if block or out is None:
        part = answered(block) if block else spark.createDataFrame([], "query long, vec_id long, score double")
        out = part if out is None else out.union(part)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def analogies(vectors: DataFrame, asked: DataFrame, unit: bool) -> DataFrame:
    """Query vectors of (query, positive, negative): sum of positives minus negatives, raw, or of unit vectors averaged.  Queries with a missing word are left out."""
    terms = asked.select("query", F.explode(F.concat(F.transform("positive", lambda x: F.struct(x.alias("vec_id"), F.lit(1.0).alias("sign"))), F.transform("negative", lambda x: F.struct(x.alias("vec_id"), F.lit(-1.0).alias("sign"))))).alias("t")).select("query", "t.*")
    vector = F.col("vector")
    each = terms.join(vectors.select("vec_id", "vector"), "vec_id").select("query", "vec_id", F.posexplode(A.scaled(vector, F.col("sign") / A.norm(vector) if unit else F.col("sign"))).alias("dim", "x"))
    summed = each.groupBy("query", "dim").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))
    known = terms.join(vectors.select("vec_id", F.lit(1).alias("known")), "vec_id", "left").groupBy("query").agg(F.count_if(F.col("known").isNull()).alias("missing"), F.collect_set("vec_id").alias("exclude"))
    return whole.join(known.filter("missing = 0"), "query").select("query", "vector", "exclude")


def cka(vectors: DataFrame, models: list[tuple[str, int, int]]) -> DataFrame:
    """Linear CKA between slices of one vector column (name, first, last exclusive).

    Uses column products: |Y'X|^2 / (|X'X| |Y'Y|) on centred columns, so each
    batch adds up a d x d matrix and no row-by-row matrix is made.
    """

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vector"].to_numpy())
                i, j = np.meshgrid(np.arange(x.shape[1]), np.arange(x.shape[1]), indexing="ij")
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "xy": (x.T @ x).ravel(), "x": np.repeat(x.sum(0), x.shape[1]), "y": np.tile(x.sum(0), x.shape[1]), "n": len(x)})

    sums = vectors.select("vector").mapInPandas(gram, "i int, j int, xy double, x double, y double, n long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    cov = sums.select("i", "j", "n", F.pow(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.lit(2.0)).alias("c2"))
    names = vectors.sparkSession.createDataFrame(models, "model string, lo int, hi int")
    a, b = (F.broadcast(names.select(F.col("model").alias(m), F.col("lo").alias(f"lo_{m}"), F.col("hi").alias(f"hi_{m}"))) for m in ("a", "b"))
    block = cov.join(a, (F.col("i") >= F.col("lo_a")) & (F.col("i") < F.col("hi_a"))).join(b, (F.col("j") >= F.col("lo_b")) & (F.col("j") < F.col("hi_b"))).groupBy("a", "b").agg(F.sum("c2").alias("f2"), F.max("n").alias("n"))
    own = block.filter("a = b").select("a", F.sqrt("f2").alias("f"))
    both = block.filter("a < b").join(own.withColumnRenamed("f", "fa"), "a").join(own.select(F.col("a").alias("b"), F.col("f").alias("fb")), "b")
    return both.filter("n >= 10").select(F.col("a").alias("model_a"), F.col("b").alias("model_b"), "n", (F.col("f2") / (F.col("fa") * F.col("fb") + 1e-8)).alias("cka"))


def pca(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(vec_id, x, y): projection of centred rows on the first components; each component's largest entry is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector("vector").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="out").fit(rows)
    axes = model.pc.toArray()
    sign = [1.0 if axes[np.argmax(np.abs(axes[:, c])), c] > 0 else -1.0 for c in range(k)]
    made = model.transform(rows).select("vec_id", vector_to_array("out").alias("out"))
    mean = made.agg(*[F.avg(F.col("out")[c]).alias(f"m{c}") for c in range(k)])
    return made.crossJoin(F.broadcast(mean)).select("vec_id", *[((F.col("out")[c] - F.col(f"m{c}")) * sign[c]).alias("xyz"[c]) for c in range(k)])


def tsne(points: DataFrame, perplexity: float = 30.0, steps: int = 1000, early: int = 250) -> DataFrame:
    """(grp, vec_id, x, y): t-SNE of each group, which is a word group of some dozens of points; groups run in parallel.

    It starts from the first two principal components; the perplexity is that given, or one less than
    the points of a smaller group.  Distances count twelve times in the ``early`` steps.
    """

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vector"].to_numpy())
        n = len(x)
        if n < 3:
            return pd.DataFrame({"grp": pdf["grp"], "vec_id": pdf["vec_id"], "x": 0.0, "y": 0.0})
        d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
        goal, p = np.log(min(perplexity, n - 1) * (1 - 1e-6)), np.zeros((n, n))
        for i in range(n):
            lo, hi, beta = 0.0, np.inf, 1.0 / max(1e-12, np.median(d2[i]))
            for _ in range(60):
                w = np.exp(-(d2[i] - np.delete(d2[i], i).min()) * beta)
                w[i] = 0
                q = w / w.sum()
                entropy = -(q[q > 0] * np.log(q[q > 0])).sum()
                if abs(entropy - goal) < 1e-5:
                    break
                lo, hi = (beta, hi) if entropy > goal else (lo, beta)
                beta = beta * 2 if hi == np.inf else (lo + hi) / 2
            p[i] = q
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        c = x - x.mean(0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        y = u[:, :2] * s[:2]
        y = y / (y[:, 0].std() + 1e-12) * 1e-4
        move = np.zeros_like(y)
        for step in range(steps):
            t = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
            np.fill_diagonal(t, 0)
            q = np.maximum(t / t.sum(), 1e-12)
            g = 4 * (((p * (12 if step < early else 1) - q) * t)[:, :, None] * (y[:, None] - y[None])).sum(1)
            move = (0.5 if step < early else 0.8) * move - max(n / 48, 10) * g
            y = y + move
            y -= y.mean(0)
        return pd.DataFrame({"grp": pdf["grp"], "vec_id": pdf["vec_id"], "x": y[:, 0], "y": y[:, 1]})

    return points.groupBy("grp").applyInPandas(project, "grp int, vec_id long, x double, y double")
