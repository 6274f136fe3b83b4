"""The pipeline's stages one after another, each against brute force on its own input, and the parts that have no SQL."""

import collections
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import mixing, quality, toxicity
from lexweave.llm.decontaminate import contaminated, tiles
from lexweave.llm.language import recognised
from lexweave.llm.minhash import deduplicated
from lexweave.llm.mixing import mixed_documents
from lexweave.llm.sharding import shard_documents

from .test_documents import held, made, shingles, words

#: Names that operators use inside.
CLASH = ["d", "row", "key", "spans", "los", "his", "start", "pass", "block", "source_no", "tie", "_text", "_gone", "_found", "size", "target"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
ITEM = " ".join(f"item{k}" for k in range(20))


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, lang, s, n, *[f"{c}{k}" for c in CLASH]) for k, (i, t, lang, s, n, *_) in enumerate(made()) if t is None or len(t) < 50_000]
    more = ["Lead " + ITEM + " end " + "so on " * 30, " ".join(ITEM.split()[12:] + ["x"] + ITEM.split()[:6])]
    return out + [(200 + k, t, "aa", "s1", len(t), *CLASH) for k, t in enumerate(more)] + [out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(4)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def bits(counts, text, order):
    b, total = b" " * order + text.encode().lower(), 0.0
    for k in range(order, len(b)):
        for d in range(order, -1, -1):
            c = counts.get(b[k - d : k])
            if not c:
                continue
            n = sum(c.values()) + len(c)
            if c[b[k]]:
                total += math.log2(n / c[b[k]])
                break
            total += math.log2(n / len(c))
        else:
            total += 8
    return total


def language_stage(rows, order=4):
    trees = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and not held(r[0], 3, 1):
            b = b" " * order + r[1].encode().lower()
            for k in range(order, len(b)):
                for d in range(order + 1):
                    trees[r[2]][b[k - d : k]][b[k]] += 1
    out = []
    for r in rows:
        if r[1] and any(c.isalpha() for c in r[1]):
            cost = [bits(t, r[1], order) for t in trees.values()]
            if 1 / sum(2.0 ** max(-1000, min(cost) - c) for c in cost) >= 0.5:
                out.append(r)
    return out


def dedup_stage(rows):
    sets = [(r[0], shingles(r[1], 5)) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i for i, _ in sets if root(i) == i}


def naive_tiles(item, doc, least):
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            a[i + k] = b[j + k] = True
        out.append((i, j, n))


def test_tiles_by_definition():
    rng = np.random.Generator(np.random.PCG64(4))
    for _ in range(150):
        item, doc = (rng.integers(1, 4, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        least = int(rng.integers(2, 5))
        assert tiles(item, doc, least) == naive_tiles(item.tolist(), doc.tolist(), least)


def test_tiles_of_equal_words_stay_small():
    a, b = np.ones(1000, np.uint64), np.ones(20_000, np.uint64)
    assert tiles(a, b, 5) == [(0, 0, 1000)]


def test_blocks_of_items(spark, docs, bench):
    many = bench.union(spark.createDataFrame([(k, f"{ITEM} more{k} and{k} words{k} here{k} too{k}") for k in range(3, 9)], bench.schema))
    one, several = (sorted(map(tuple, contaminated(docs, many, block_bytes=n).collect())) for n in (1 << 20, 300))
    assert one == several and len(one) >= 8


def mix_stage(rows, block=256, seed=11):
    """(row, words taken) by walking the streams: the module gives the permutation and the targets, which are tested by themselves."""
    streams = collections.defaultdict(list)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0)):
        streams[rows[k][3]].append(k)
    names = sorted(x for x in streams if x is not None) + [None] * (None in streams)
    sizes = [sum(len(words(rows[k][1])) for k in streams[x]) for x in names]
    goals = mixing.targets(sizes, [[3, 1, 2][k % 3] for k in range(len(names))], 1.5, 2.0)
    taken = collections.Counter()
    for no, (x, size, goal) in enumerate(zip(names, sizes, goals)):
        stream = [k for k in streams[x] for _ in words(rows[k][1])]
        left, whole, turn = min(2 * size, round(goal)), size // block, 0
        while left:
            key = mixing.ta.combine(np.full(whole, no, np.uint64), np.full(whole, turn, np.uint64))
            order = [*mixing.permute(np.arange(whole), np.full(whole, whole), key), *[whole] * (size % block > 0)]
            for b in order:
                some = stream[b * block : (b + 1) * block][:left]
                taken.update(some)
                left -= len(some)
            turn += 1
    return taken, dict(zip(names, goals)), dict(zip(names, sizes))


def test_permutation_and_shard_counts():
    for n in (1, 2, 3, 17, 256, 1000):
        key = np.full(n, 12345, np.uint64)
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), key)) == list(range(n))
    quotas = np.array([100, 0, 7, 3000], np.int64)
    whole = list(mixing.shard_counts(quotas, 0, 32, 3, 10_000))
    assert (sum(c for _, _, c in whole) == quotas).all() and [s for s, _, _ in whole] == list(range(98))
    assert all((b == a + c).all() for (_, a, c), (_, b, _) in zip(whole, whole[1:]))
    parts = [x for lo in range(0, 98, 5) for x in mixing.shard_counts(quotas, lo, 32, 3, 5)]
    assert all(s == t and (a == b).all() and (c == d).all() for (s, a, c), (t, b, d) in zip(whole, parts)) and len(parts) == len(whole)


def test_mix_report_takes_exactly_these(spark, rows, docs):
    want, goals, sizes = mix_stage(rows, block=16)
    unique = [r for r in rows if sum(r[0] == x[0] for x in rows) == 1]
    got = {r.doc_id: r for r in mixing.mix_report(docs, block=16, slots_per_shard=8, shards_per_task=3).collect()}
    for r in unique:
        x = got[r[0]]
        assert (x.size, x.source_size, x.target) == (len(words(r[1])), sizes[r[3]], pytest.approx(goals[r[3]]))
        assert x.taken == want[rows.index(r)]


def test_small_sources_meet_their_targets(spark):
    rows = [(s * 10 + k, " ".join(f"w{s}x{k}y{j}" for j in range(50)), f"s{s:02}") for s in range(40) for k in range(3)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    took = collections.Counter()
    for r in got:
        took[r.doc_id // 10] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    goals = {r.doc_id // 10: r.target for r in got}
    assert all(abs(took[s] - goal) <= 0.5 for s, goal in goals.items()) and abs(sum(goals.values()) - 9000) < 1e-6


def test_quota():
    for size in (1, 5, 16, 17, 150, 256, 1000):
        for goal in (0, 1, 7.4, size / 2, size, 1.3 * size, 2 * size):
            slots, last = mixing.quota(size, goal, 16, 2.0)
            want, per, n = min(round(goal), 2 * size), -(-size // 16), 0
            for k in range(slots):
                n += last if k == slots - 1 else min(16, size - k % per * 16)
            assert n == want
    assert mixing.quota(0, 0, 16, 2.0) == (0, 0)


def test_stages(spark, rows, docs, bench):
    kept = recognised(docs)
    assert kept.columns == docs.columns and multiset(kept.collect()) == multiset(language_stage(rows))

    rows = [tuple(r) for r in kept.collect()]
    kept = deduplicated(kept)
    stay = dedup_stage(rows)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and set(got) <= set(rows)
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(stay)
    assert multiset(r for r in got if r[0] is None) == multiset(r for r in rows if r[0] is None)

    rows, last = got, spark.createDataFrame(got, KIND)
    kept = corpus_pipeline.without_contaminated(last, contaminated(last, bench))

    def covered(text):
        return sum(n for _, _, n in naive_tiles(ITEM.split(), "".join(c if c.isalnum() or not c.isascii() else " " for c in (text or "").lower()).split(), 5))

    assert kept.columns == docs.columns
    assert multiset(kept.collect()) == multiset(r for r in rows if r[0] is None or "item" not in (r[1] or "") or covered(r[1]) < 10)

    rows = [tuple(r) for r in kept.collect()]
    out = mixed_documents(kept, block=16, slots_per_shard=64)
    taken, _, _ = mix_stage(rows, block=16)
    got = collections.Counter()
    for r in out.collect():
        got[tuple(r)[5:]] += len(words(r.text))
        assert len(r.text) == r.n_chars and r.text
    want = collections.Counter()
    for k, n in taken.items():
        want[rows[k][5:]] += n
    assert out.columns == docs.columns and got == want
    assert {r.text for r in out.collect()} & {r[1] for r in rows}

    shards = shard_documents(out, shards=7).collect()
    by = collections.Counter(r.shard for r in shards)
    assert len(shards) == out.count() and max(by.values()) - min(by.values()) <= 1
    again = shard_documents(out.repartition(3), shards=7).collect()
    assert multiset(shards) == multiset(again)


def test_run_on_empty_and_small_tables(spark, docs, tmp_path):
    for name, df in (("documents", docs.select("doc_id", "text", "lang", "source", "n_chars")), ("benchmark", spark.createDataFrame([(1, ITEM)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/a/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r.shard for r in out} == set(range(40)) and not {200, 201} & {r.doc_id for r in out}
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_rows_that_repeat_and_differ_in_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text, None, "s", 1, u) for u in "ab"], "doc_id long, text string, lang string, source string, n_chars long, url string")
    assert collections.Counter(r.url for r in mixed_documents(df, block=4).collect()).keys() == {"a", "b"}
    assert [r.doc_id for r in deduplicated(df).collect()] == [1]


def test_ftrl_by_coordinate():
    rng = random.Random(2)
    data = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 8)))) for _ in range(60)]
    y = np.array([float(3 in x or 7 in x) for x in data])
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.7, 1.0, 3
    where, value = toxicity.ftrl(data, y, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs, seed=7)
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        pen = 0 if i == toxicity.BIAS else l1
        return 0.0 if abs(z[i]) <= pen else -(z[i] - math.copysign(pen, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for r in order.permutation(len(data)):
            i = [*data[r], toxicity.BIAS]
            w = {k: weight(k) for k in i}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[r]
            for k in i:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in z if weight(k)}
    assert dict(zip(where.tolist(), value)) == {k: pytest.approx(v) for k, v in want.items()}
    assert 0 < len(want) < 31


def test_quality_is_calibrated_and_decides():
    rng = np.random.Generator(np.random.PCG64(8))
    rows, y = [], []
    for _ in range(1500):
        good = rng.random() < 0.7
        rows.append(np.unique(np.concatenate((rng.integers(0, 50, 20), rng.integers(100, 110, 3) if rng.random() < (0.8 if good else 0.2) else rng.integers(200, 210, 3)))))
        y.append(float(good))
    y = np.array(y)
    w, bias, slope, offset = quality.train(rows[:1000], y[:1000])
    x = np.array([w[r].sum() / math.sqrt(len(r)) + bias for r in rows[1000:]])
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert abs(p.mean() - y[1000:].mean()) < 0.06
    assert ((p >= 0.5) == (y[1000:] > 0)).mean() > 0.72
    for lo, hi in ((0, 0.5), (0.5, 1.01)):
        some = (p >= lo) & (p < hi)
        assert abs(p[some].mean() - y[1000:][some].mean()) < 0.12


def test_character_grams():
    import pyarrow as pa

    from lexweave.llm import textarrays as ta
    from lexweave.llm.features import characters, characters_of

    texts = ["añb漢añb", "", "x", "😀añb"]
    (t,) = ta.slices(pa.array(texts, pa.large_string()))
    doc, number = characters(t)
    assert np.bincount(doc, minlength=4).tolist() == [len(x) for x in texts]
    at, feature = characters_of(doc, number, 3, 1, 30)
    assert np.bincount(at, minlength=4).tolist() == [max(0, len(x) - 2) for x in texts]
    names = [x[k : k + 3] for x in texts for k in range(len(x) - 2)]
    assert len(set(zip(names, feature))) == len(set(names)) == len(set(feature.tolist()))
