"""Clusters and manifest against plain Python on awkward tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lexweave.llm.clusters import LARGEST, Annulus, cluster_vectors
from lexweave.llm.manifest import dataset_manifest

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string, distance long"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos long, h string, n long, part int, claim string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_clusters(rows, k, rounds, dim):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            v = [math.floor(256 * float(np.float32(c))) for c in x]
            if max(map(abs, v)) <= LARGEST:
                kept.append((vec_id, v))
    start = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), np.array(r[1], np.int32).tobytes()))[:k]
    centroids = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, n) in zip(kept, assign()):
            groups[n].append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(c) // len(vs) for c in zip(*vs)]
    last = assign()
    inertia = collections.Counter()
    for d, n in last:
        inertia[n] += d
    return collections.Counter((vec_id, n, d, inertia[n], sum(inertia.values()), sha(",".join(map(str, centroids[n])))) for (vec_id, _), (d, n) in zip(kept, last))


def vectors(dim):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(k % 5, 1) for _ in range(dim)]) for k in range(150)]
    rows += [(200 + k, [float(k % 2)] * dim) for k in range(20)]  # ties and repeats
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, [0.0] * dim), (300, [-1e3] * dim), (301, [524287.0] * dim)]
    bad = [(400, None), (401, []), (402, [1.0] * (dim - 1)), (403, [1.0] * (dim + 1)), (404, [None] + [1.0] * (dim - 1)), (405, [float("nan")] * dim), (406, [float("inf")] + [0.0] * (dim - 1)), (407, [1e30] * dim)]
    return rows + bad


@pytest.mark.parametrize(("k", "dim"), [(7, 4), (40, 3), (400, 2), (1, 4)])
def test_clusters(spark, k, dim):
    rows = vectors(dim)
    df = spark.createDataFrame([(i, x, 0, "c", "v", 1) for i, x in rows], VECTORS).repartition(5)
    got = cluster_vectors(df, k=k, rounds=3, dim=dim)
    assert collections.Counter(map(tuple, got.collect())) == brute_clusters(rows, k, 3, dim)


def test_clusters_of_nothing(spark):
    got = cluster_vectors(spark.createDataFrame([(1, [1.0], 0, "", "", 0)], VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_annulus_leaves_out_and_keeps_ties():
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.integers(-9, 9, (30, 5)) * s for s in (1, 10, 100)])
    c[40] = c[3]  # the same centroid twice
    v = np.concatenate([c + rng.integers(-2, 3, c.shape), np.zeros((3, 5), np.int64)])
    who, best, done = Annulus(c.tolist()).nearest(v)
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (best == d.min(1)).all() and (who == d.argmin(1)).all() and 3 not in (who == 40).nonzero()[0]
    assert done < 0.6 * d.size


def brute_manifest(rows):
    def enc(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha("".join(map(enc, (*r[:4], text))))

    def tree(nodes):
        """Root, and for each node its sibling runs [(left, right), ..] bottom up."""
        ways, at, own = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(own) > 1:
            for k, p in enumerate(at):
                run = own[p // 16 * 16 : p // 16 * 16 + 16]
                ways[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            own, at = [sha("".join(own[k : k + 16])) for k in range(0, len(own), 16)], [p // 16 for p in at]
        return own[0], ways

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
    trees = [tree([x[2] for x in by[s]]) for s in sources]
    root, outer = tree([t[0] for t in trees])
    out = collections.Counter()
    for s, (subroot, ways), way in zip(sources, trees, outer):
        for (_, _, own, r), mine in zip(by[s], ways):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            acc = leaf(r, r[4].translate({c: c + 32 for c in range(65, 91)})) if touched else own
            for a, b in mine + way:
                acc = sha(a + acc + b)
            out[r[0], own, subroot, root, sha("".join(a + b for a, b in mine + way)), acc, acc == root] += 1
    return out


def documents(sizes):
    rng = random.Random(9)
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((rng.choice([k, k * 7919 % 100_003, -k]), s, rng.choice([None, "en", ""]), rng.choice([None, 5, -1]), rng.choice([None, "", "plain text", "Some Capital Ä €", f"Row {k}\n"])))
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 1, None: 1}, {"a": 16, "b": 17, "": 1}, {None: 257, "Z": 300, "é": 1, "a b": 31, "": 2},
    {f"s{k:03}": 1 + k % 3 for k in range(290)}, {"hot": 9001, "b": 4097, "c": 4096, "d": 5, None: 3},
])
def test_manifest(spark, sizes):
    rows = documents(sizes)
    if len(rows) > 20:
        rows += [rows[5], (None, rows[3][1], None, None, None), (None, rows[3][1], None, None, "A" * 200_000), (rows[7][0], rows[7][1], "xx", 1, "other text")]
    df = spark.createDataFrame([(*r, 1, 2, "h", 3, 4, "c") for r in rows], DOCS).repartition(6)
    assert collections.Counter(map(tuple, dataset_manifest(df).collect())) == brute_manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = documents({f"s{k}": 1 for k in range(5000)})
    df = spark.createDataFrame([(*r, 1, 2, "h", 3, 4, "c") for r in rows], DOCS)
    assert collections.Counter(map(tuple, dataset_manifest(df).collect())) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    got = dataset_manifest(spark.createDataFrame([], DOCS))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
