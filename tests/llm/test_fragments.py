"""The fragment join against all pairs in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm.fragments import fragments_of, jaccard_components, overlaps, segments_of

from .test_documents import KIND, made, shingles


def brute(rows, size, percent):
    sets = [(r[0], shingles(r[1], size)) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i if i is not None else -1, len(s), -1 if i is None else root(i) if s else i) for i, s in sets)


def found(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_components(df, **options).collect())


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (3, 85), (2, 60)])
def test_awkward_documents(spark, size, percent):
    rows = made()
    rows += [(150 + k, rows[20][1] + f" tail{k}", None, None, 0, 0.0, "") for k in range(4)] + [(151, rows[70][1], None, None, 0, 0.0, "")]  # one id, two texts
    df = spark.createDataFrame(rows, KIND).withColumnsRenamed({"n_chars": "node", "score": "gram", "held_out": "cls"}).repartition(5)
    assert found(df, size=size, percent=percent) == brute(rows, size, percent)


def test_chains_and_thresholds(spark):
    """Texts in a chain of edits, where only neighbours are linked, exact ties at the threshold, and lines that many texts share."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    line = [word() for _ in range(40)]
    rows, k = [], 0
    for _ in range(8):
        text = [word() for _ in range(120)]
        for _ in range(9):
            rows.append((k, " ".join(text)))
            k += 1
            for _ in range(rng.choice([1, 2, 3, 5])):
                text[rng.randrange(len(text))] = word()
    for _ in range(60):
        own = [word() for _ in range(rng.choice([3, 6, 10, 40]))]
        rows.append((k, " ".join(own + line)))
        k += 1
    for n in range(1, 40):  # 4 + 5 n shingles of which n differ
        base = [word() for _ in range(8 + 5 * n)]
        rows += [(k, " ".join(base)), (k + 1, " ".join(base[: len(base) - n] + [word() for _ in range(n)])), (k + 2, " ".join(base[:-n]))]
        k += 3
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute([(*r, 0) for r in rows], 5, 80)
    assert found(df, fragments=1, centres=1) == found(df, fragments=50)


def test_partial_overlaps_add_up(spark):
    rng = random.Random(4)
    sets = {k: {min(int(rng.expovariate(0.02)), 10_000) * 2654435761 * 2**31 % 2**64 - 2**63 for _ in range(rng.randrange(1, 200))} for k in range(40)}
    import numpy as np

    df = spark.createDataFrame([(k, bytes(np.array(sorted(s), np.int64).tobytes())) for k, s in sets.items()], "node long, grams binary").withColumn("n", F.octet_length("grams") / 8).withColumn("n", F.col("n").cast("long"))
    segments = segments_of(df, 12)
    shared = {g for k, s in sets.items() for g in s if sum(g in t for t in sets.values()) > 1}
    got = {}
    for r in segments.collect():
        got.setdefault(r.node, []).append((r.fragment, r.grams))
    assert {k: sorted(g for _, x in parts for g in x) for k, parts in got.items()} == {k: sorted(s & shared) for k, s in sets.items() if s & shared}
    weight = {}
    for s in sets.values():
        for g in s & shared:
            weight[g] = weight.get(g, 0) + 1
    places = sorted({(f, weight[g].bit_length(), g) for parts in got.values() for f, x in parts for g in x}, key=lambda x: x[1:])
    assert [f for f, _, _ in places] == sorted(f for f, _, _ in places) and len({f for f, _, _ in places}) > 8
    pairs = spark.range(40).alias("x").join(spark.range(40).alias("y"), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    assert {(r.a, r.b): r.common for r in overlaps(pairs, segments).collect()} == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def test_fragments_follow_weight():
    assert fragments_of({3: 10, 0: 50, 1: 20}, 8) == {0: (0, 5), 1: (5, 2), 3: (7, 1)}


def test_many_near_copies_make_stars(spark):
    """A group of copies with one edit each: about one pair for each member, not all of them."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1500):
        text = list(base)
        text[rng.randrange(300)] = f"edit{k}"
        rows.append((k, " ".join(text)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {c for _, _, c in got} == {0} and len(got) == 1500


def test_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (None, "a b")]):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == len(rows)
