"""Row numbers, spans and as-of joins over tables of many partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import vocabulary as V
from lexweave.operators.numbering import as_of, numbered, spans


@pytest.fixture(scope="module")
def words(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    word = F.concat(F.lit("w"), F.lpad(F.conv(F.pmod(F.col("id") * 7919, F.lit(1_000_000)).cast("string"), 10, 36), 5, "0"))
    yield spark.range(1_000_000).select(word.alias("word"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 5).alias("n"))
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("rows", [400_000, 1_000_000])
def test_numbers_have_no_gap_and_follow_the_order(spark, words, rows):
    got = V.vocabulary(words.filter(F.pmod(F.xxhash64("word"), F.lit(10)) < rows // 100_000)).toPandas()
    got = got.sort_values("word")
    assert (got.idx.to_numpy() == np.arange(len(got))).all() and len(got) > 0.95 * rows


def test_spans_lie_end_to_end(spark, words):
    got = spans(V.noise(words).select("word", "p"), "word", "p").toPandas().sort_values("word")
    assert len(got) == 1_000_000 and abs(got.hi.iloc[-1] - 1) < 1e-9
    assert np.abs(got.lo.to_numpy()[1:] - got.hi.to_numpy()[:-1]).max() < 1e-12 and got.lo.iloc[0] == 0


def test_numbered_with_ties_and_nothing(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert sorted((r.v or "", r.idx) for r in numbered(rows, "v").collect()) == [("", 0), ("a", 1), ("b", 2), ("b", 3)]
    assert numbered(rows.limit(0), "v").count() == 0


def test_as_of_takes_the_last_start(spark):
    starts = spark.createDataFrame([(0.0, "a"), (0.5, "b"), (0.75, "c")], "lo double, name string")
    points = spark.range(0, 40_000).select((F.col("id") / 40_000).alias("u"), "id")
    got = as_of(points.repartition(16), "u", starts, "lo", ["name"]).groupBy("name").agg(F.count("*").alias("n"), F.min("u").alias("u"))
    assert {(r.name, r.n, r.u) for r in got.collect()} == {("a", 20_000, 0.0), ("b", 10_000, 0.5), ("c", 10_000, 0.75)}


def test_exactly_k_negatives_by_the_law(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "word string, n long")
    p = V.noise(counts)
    positives = spark.range(60_000).select(F.col("id"), F.when(F.col("id") < 20_000, "a").when(F.col("id") < 40_000, "b").otherwise("zz").alias("word"))
    got = V.negatives(positives, p, k=3)
    share = {r.word: r.p for r in p.collect()}
    n = {(r.positive, r.negative): r["count"] for r in got.groupBy("positive", "negative").count().collect()}
    assert sum(n.values()) == 180_000 and ("a", "a") not in n and ("b", "b") not in n
    for positive in ("a", "b", "zz"):
        rest = {w: q for w, q in share.items() if w != positive}
        for w, q in rest.items():
            assert abs(n[positive, w] / 60_000 - q / sum(rest.values())) < 0.01
    assert V.negatives(positives, V.noise(counts.limit(1))).count() == 0


def test_a_radius_is_drawn_once(spark):
    sents = spark.createDataFrame([(1, 0, ["a", "b", "c"])], "doc_id long, sent_idx int, tokens array<string>")
    pairs = V.context_pairs(sents, 5, dynamic=True)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
