"""The operators over documents, against brute force on a table with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from lexweave.llm.decontaminate import contaminated, tiles, without_contaminated
from lexweave.llm.katz import score_texts
from lexweave.llm.language import identify_language, recognised
from lexweave.llm.minhash import near_duplicates
from lexweave.llm.mixing import mix_report, mixed_documents, targets
from lexweave.llm.quality import judge_quality
from lexweave.llm.sharding import shard_documents
from lexweave.llm.substring import remove_repeats
from lexweave.llm.toxicity import score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string"


def words(text):
    return WORD.findall(text or "")


def made():
    rng = random.Random(3)
    vocabulary = [a + b for a in ("ba", "Ce", "di", "fo", "gü") for b in ("ka", "le", "mi", "no", "pü", "ra")]
    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "\n"]) for _ in range(n))
    shared = prose(20)
    out = [(k, prose(rng.choice([3, 20, 60, 120]))) for k in range(60)]
    base = prose(100).split()
    for k in range(60, 90):  # near copies at many distances
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append((k, " ".join(copy)))
    out += [(90 + k, f"{prose(15)} {shared} {prose(15)}") for k in range(6)]
    out += [(100 + k, out[7][1]) for k in range(5)]
    out += [(110, None), (111, ""), (112, " \t\n"), (113, "Ünï cödé"), (114, "12 34 !!"), (115, "one two"), (116, "ONE  two"), (117, prose(30_000)), (None, out[3][1]), (5, out[5][1]), (None, None), (118, "x y a b\x1cc"), (119, "a b a b a b\n\na b\na b\n c \n c ")]
    return [(i, t, [None, "aa", "bb"][k % 3], [None, "s1", "s2", "s1", "Z"][k % 5], len(t or ""), 0.5, "x") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
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
    want = sorted((i if i is not None else -1, len(s), -1 if i is None else root(i) if s else i) for i, s in sets)
    got = near_duplicates(docs, size=size, percent=percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_remove_repeats(docs, rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            w = words(r[1])
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, r[0]), r[0])
    want = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[k : k + 13])] < r[0]:
                gone[k : k + 13] = [True] * 13
        want.append((-1 if r[0] is None else r[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = remove_repeats(docs, texts=False).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert sum(r[2] for r in want) > 300


def held(i, divisor, rest):
    return i is not None and zlib.crc32(str(i).encode()) % divisor == rest


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(docs, rows, order):
    end = "\0"
    texts = [(r[0], [*words((r[1] or "").translate(LOWER)), end]) for r in rows]

    def grams(t, k):
        padded = [end, *t]
        return [(tuple(padded[j + 2 - k : j + 1]), w) for j, w in enumerate(t) if j >= k - 2]

    one = collections.Counter(w for i, t in texts if not held(i, 5, 1) for w in t)
    many = {k: collections.Counter(g for i, t in texts if not held(i, 5, 1) for g in grams(t, k)) for k in range(2, order + 1)}
    total = sum(one.values())

    def law(c, limit=5):
        n = collections.Counter(c.values())
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        rest = (limit + 1) * n[limit + 1] / n[1] if n[1] else 1
        d = {}
        for r in range(1, limit + 1):
            good = ((r + 1) * n[r + 1] / max(1, n[r]) / r - rest) / (1 - rest) if rest < 1 else 0
            d[r] = good if 0 < good <= 1 else (r - off) / r
        return lambda c: d.get(c, 1) * c

    d1 = law(one)
    lost = 1 - sum(map(d1, one.values())) / total
    low = {w: d1(c) / total for w, c in one.items()}
    cut = {k: law(many[k]) for k in many}
    after = {k: collections.defaultdict(list) for k in many}
    for k, c in many.items():
        for (h, w), n in c.items():
            after[k][h].append((w, n))
    known = {}

    def history(h):
        """(total, alpha) of a history, by the definition."""
        if h not in known:
            k = len(h) + 1
            n, mass = sum(n for _, n in after[k][h]), sum(cut[k](n) for _, n in after[k][h])
            n = n if n - mass > 1e-6 else mass + 1
            known[h] = n, (n - mass) / n / (1 - sum(p(h[1:], w) for w, _ in after[k][h]))
        return known[h]

    def p(h, w):
        if not h:
            return low.get(w, lost)
        k = len(h) + 1
        if h not in after[k]:
            return p(h[1:], w)
        n, alpha = history(h)
        c = many[k][h, w]
        return cut[k](c) / n if c else alpha * p(h[1:], w)

    for h in [(end,), ("dika",), *list(after[order])[:8]]:
        assert sum(p(h, w) for w in one) + p(h, "unknown") == pytest.approx(1)

    def score(t):
        padded = [end, *t]
        return sum(math.log10(p(tuple(padded[max(0, j + 2 - order) : j + 1]), w)) for j, w in enumerate(t))

    want = sorted(
        (-1 if i is None else i, held(i, 5, 1), len(t), sum(one[w] > 0 for w in t), round(sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in t), 6), round(score(t), 6))
        for i, t in texts
    )
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in score_texts(docs, order=order, chunk_tokens=2000).collect())
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4:] for x in got] == [pytest.approx(x[4:], abs=1e-5) for x in want]


def test_quality_counts(spark, docs, rows):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60, 2)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = []
    for i, t, *_ in rows:
        t, w = t or "", words(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        n = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        want.append((-1 if i is None else i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    got = judge_quality(docs, labels).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:7]) for r in got) == sorted(want)
    assert all(not (r.kept and r.base_failed) and 0 <= r.quality <= 1 for r in got)


def test_language_and_toxicity_learn(spark):
    rng = random.Random(1)
    bad = ["vile", "scumbag"]
    rows, labels = [], []
    for k in range(400):
        lang = ["aa", "bb"][k % 2]
        w = [rng.choice(["ooma", "uuli", "oola"] if lang == "aa" else ["kret", "strik", "prakt"]) + rng.choice("aeiou") for _ in range(40)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "s", "!"])
        rows.append((k, " ".join(w), lang, "s", 1, 0.0, "x"))
        labels.append((k, 1, toxic))
    docs = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: r for r in identify_language(docs).collect()}
    assert all(got[r[0]].lang_pred == r[2] and 0 <= got[r[0]].score <= 1 for r in rows)
    assert all(got[k].held_out == held(k, 3, 1) for k in got)
    tox = {r.doc_id: r for r in score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    wrong = [k for k, _, y in labels if tox[k].predicted != y]
    assert len(tox) == 400 and len(wrong) <= 4
    assert all(tox[k].held_out == held(k, 4, 2) and tox[k].predicted == int(tox[k].score >= 0.3) for k in tox)


def test_language_code_lengths():
    import numpy as np
    import pyarrow as pa

    from lexweave.llm import textarrays as ta
    from lexweave.llm.language import Trees

    texts, order = {"aa": ["abra cadabra", "abba"], "bb": ["xyz xyz zyx", "é"]}, 2
    trees = Trees(texts, order)

    def bits(lang, text):
        counts = collections.defaultdict(collections.Counter)
        for s in texts[lang]:
            b = b" " * order + s.lower().encode()
            for k in range(order, len(b)):
                for d in range(order + 1):
                    counts[b[k - d : k]][b[k]] += 1
        b, total = b" " * order + text.lower().encode(), 0
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

    tests = ["abra", "Zyx é?", "q", ""]
    (t,) = ta.slices(pa.array(tests))
    assert np.allclose(trees.bits(t), [[bits(lang, s) for lang in ("aa", "bb")] for s in tests], atol=1e-4)


def test_undetermined(docs, rows):
    got = {r.doc_id: r for r in identify_language(docs).collect()}
    assert {k for k in (110, 111, 112, 114) if got[k].lang_pred == "und" and got[k].score == 0} == {110, 111, 112, 114}
    assert got[113].lang_pred != "und"
    kept = recognised(docs, least=0.5)
    assert kept.columns == docs.columns
    assert not {110, 111, 112, 114} & {r.doc_id for r in kept.collect()}


def test_tiles_catch_reordered_passages():
    import numpy as np

    a = np.arange(1, 31, dtype=np.uint64)
    moved = np.concatenate((np.uint64([99, 98]), a[15:30], np.uint64([97]), a[0:15]))
    assert tiles(a, moved, 5) == [(0, 18, 15), (15, 2, 15)]
    assert tiles(a, a, 5) == [(0, 0, 30)]
    assert tiles(a[:4], a, 5) == []
    again = np.concatenate((a[:10], a[:10]))
    assert tiles(a[:10], again, 5) == [(0, 0, 10)]


def test_contaminated(spark, docs, rows):
    long = words(rows[0][1] or "") or words(rows[1][1])
    item = " ".join(f"item{k}" for k in range(20))
    halves = item.split()
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, item), (None, item)], "item_id long, text string")
    more = spark.createDataFrame([(900, "Lead " + " ".join(halves[10:]).upper() + ", and " + " ".join(halves[:10]), None, None, 1, 0.0, "x"), (901, " ".join(halves[:9]), None, None, 1, 0.0, "x"), (902, " ".join(halves[:10]), None, None, 1, 0.0, "x")], docs.schema)
    found = contaminated(docs.union(more), bench)
    assert sorted((r.doc_id, r.item_id, r.n_tiles, r.covered_words) for r in found.collect()) == [(900, 1, 2, 20), (902, 1, 1, 10)]
    left = without_contaminated(docs.union(more), found)
    assert left.count() == len(rows) + 1 and left.columns == docs.columns
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_targets():
    assert targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200, 250 / 3, 500 / 3]
    assert targets([0, 0], [3, 1], 1.5, 2) == [0, 0]
    assert targets([], [], 1.5, 2) == []


def test_mix(docs, rows):
    got = mix_report(docs, block=16, slots_per_shard=64).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size) for r in got) == sorted((-1 if r[0] is None else r[0], len(words(r[1])), size[r[3]]) for r in rows)
    names = sorted(x for x in size if x is not None) + [None]
    goal = dict(zip(names, targets([size[x] for x in names], [[3, 1, 2][k % 3] for k in range(len(names))], 1.5, 2)))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r.target] += r.taken
    assert all(abs(taken[x] - x) <= 1 for x in goal.values() if list(goal.values()).count(x) == 1)
    again = mix_report(docs.repartition(3), block=16, slots_per_shard=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixed_documents(docs, block=16, slots_per_shard=64)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def test_shards(docs, rows):
    got = shard_documents(docs, shards=7).collect()
    def order(x):
        return tuple(-1 if v is None else v for v in x)

    want = [(r[0], len((r[1] or "").encode()) + 16, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=order) == sorted(want, key=order)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(7))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {r[0]: r[1] for r in rows}
    group = {r.shard for r in got if r.doc_id is not None and text[r.doc_id] == rows[7][1]}
    assert len(group) == 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_group_larger_than_a_shard(spark):
    """A third of all rows is one group: it fills shards up, and does not stay where the random start put it."""
    texts = [(k, "one text" if k % 3 == 0 else f"text {k}") for k in range(6000)]
    got = shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=20).collect()
    held = collections.Counter(r.shard for r in got if r.linked > 1)
    assert sum(held.values()) == 2000 and set(collections.Counter(r.shard for r in got).values()) == {300}
    assert sorted(held.values())[-6:] == [300] * 6 and len(held) <= 7 + 1


def test_copy_and_unique_text_of_one_id(spark):
    copy, own = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    got = remove_repeats(spark.createDataFrame([(1, copy), (2, copy), (2, own)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got) == [(1, 0, copy), (2, 0, own), (2, 20, "")]


def test_index_is_kept(spark, docs):
    """Two calls, the second with the index opened anew, equal one."""
    from lexweave.llm.common import fresh_path
    from lexweave.llm.substring import FingerprintIndex

    whole = sorted(map(tuple, remove_repeats(docs.filter("doc_id is not null"), texts=False).collect()))
    path = fresh_path(spark)
    early, late = docs.filter("doc_id <= 70"), docs.filter("doc_id > 70")
    first = remove_repeats(early, texts=False, batches=2, index=FingerprintIndex.create(spark, 8, path)).collect()
    index = FingerprintIndex.open(spark, path)
    with pytest.raises(ValueError, match="needs the documents"):
        remove_repeats(late, index=index)
    again = remove_repeats(late, texts=False, batches=3, index=index, history=early).collect()
    assert sorted(map(tuple, first + again)) == whole
    assert 1 <= len(FingerprintIndex.open(spark, path).runs) <= 2
    index.drop()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for made in (near_duplicates(empty), remove_repeats(empty), score_texts(empty), judge_quality(empty, labels), identify_language(empty), score_toxicity(empty, labels), contaminated(empty, bench), mix_report(empty), mixed_documents(empty), shard_documents(empty), recognised(empty)):
        assert made.collect() == []


def test_nothing_to_learn(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(docs, labels).collect()} == {0.5}
    assert {round(r.quality, 9) for r in judge_quality(docs, labels).collect()} == {0.5}
    assert {r.lang_pred for r in identify_language(docs.drop("lang").selectExpr("*", "string(null) lang")).collect()} == {"und"}
