"""Learnt sentence boundaries: the published examples of what must and must not end a sentence."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lexweave.operators import punkt as P

KIND = "doc_id long, text string"


def carried(made):
    """The columns that each explode of a plan repeats for every element."""
    plan = made._jdf.queryExecution().executedPlan().toString()
    lists = re.findall(r"Generate .*, \[([^\[\]]*)\], (?:true|false), \[[^\[\]]*\]", plan)
    return [[c.split("#")[0] for c in x.split(", ") if c] for x in lists]


def split(spark, *texts):
    rows = P.split(spark.createDataFrame(list(enumerate(texts)), KIND).repartition(3)).collect()
    return {k: [r.sentence for r in sorted(rows, key=lambda r: r.sent_idx) if r.doc_id == k] for k in range(len(texts))}


def test_abbreviations_and_initials_stay_whole(spark):
    corpus = "Then Dr. Rao spoke to the house. She said the fig. shows it. They met A. Sen and went home. The rest is known, they said. Now is it so that the house is home, they said, there and fell, and left, or no? " * 40
    got = split(spark, corpus, "We asked Dr. Rao about it. He met A. Sen there.", "It cost 3.5 percent. The rest fell.", "Is it so? Yes! \"No.\" He left")
    assert got[1] == ["We asked Dr. Rao about it.", "He met A. Sen there."]
    assert got[2] == ["It cost 3.5 percent.", "The rest fell."]
    assert got[3] == ["Is it so?", "Yes!", '"No."', "He left"]
    assert len(got[0]) == 200


def test_scores_are_those_of_the_formula(spark):
    text = "ok. " * 3 + "etc. " * 30 + "word " * 200 + "word. " * 20 + "e.g. " * 9
    seen = P.tokens(spark.createDataFrame([(1, text)], KIND))
    n, dots = 262, 62
    want = {}
    for w, k, c in (("ok", 3, 3), ("etc", 30, 30), ("word", 20, 220), ("e.g", 9, 9)):
        p, inside = dots / n, w.count(".")
        letters = len(w) - inside
        ratio = -2 * (k * math.log(p) + (c - k) * math.log(1 - p + 1e-8) - k * math.log(0.99) - (c - k) * math.log(0.01))
        want[w] = ratio * math.exp(-letters) * (inside + 1) * letters ** -(c - k)
    got = {r.w: r.score for r in P.abbreviations(P.counted(seen)).collect()}
    assert got == {w: pytest.approx(s, rel=1e-4) for w, s in want.items() if s >= 0.3}


def test_likelihood_of_independent_events_is_nothing(spark):
    row = spark.range(1).select(P.likelihood(*map(F.lit, (100, 200, 20, 1000))).alias("same"), P.likelihood(*map(F.lit, (100, 200, 90, 1000))).alias("together")).first()
    assert abs(row.same) < 1e-9 and row.together > 100


def test_nulls_and_nothing(spark):
    assert split(spark, None, "", "  \n", "one")[3] == ["one"]
    assert P.split(spark.createDataFrame([], KIND)).count() == 0


def test_ends_and_dots_are_those_of_the_patterns(spark):
    raw = F.col("raw")
    rows = spark.createDataFrame([(x + c + y,) for x in ("", "a", "a.", "..", ".a", "a.b", "é") for c in ("", ".", "!", "?", "..", ".!") for y in ("", '"', "')", "]}", "»”’", "-", "a", '."')], "raw string")
    assert rows.filter((P.ends(raw) != raw.rlike(P.ENDS)) | (P._before_closers(raw).endswith("..") != raw.rlike(P.DOTS))).count() == 0


def test_no_row_holds_more_than_its_tokens(spark):
    text = "Dr. Rao met etc. and so on. He left. " * 4000
    seen = P.tokens(spark.createDataFrame([(1, text)], KIND))
    assert [carried(made) for made in (P.counted(seen), P.marks(seen))] == [[], [["doc_id"]]]
    assert P.counted(seen).agg(F.sum("c")).first()[0] == 36_000


def test_only_marks_are_saved(spark):
    seen = P.tokens(spark.createDataFrame([(1, "Dr. Rao left the house. He said so"), (2, "one"), (3, "")], KIND))
    kept = sorted(tuple(r) for r in P.learn(seen).marks.select("doc_id", "pos", "w", "after_w").collect())
    assert kept == [(1, -1, "", "dr"), (1, 0, "dr", "rao"), (1, 4, "house", "he"), (2, -1, "", "one")]


def test_cuts_do_not_carry_the_document(spark):
    text = "He left the house. She said so. " * 5000
    parts = P.sentences(spark.createDataFrame([(1, text)], KIND), spark.range(4999).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 7 + 3).cast("int").alias("pos")))
    assert carried(parts) == [["doc_id"]]
    assert parts.agg(F.count("*"), F.sum(F.size(F.split("sentence", " ")))).first()[:] == (5000, 35_000)
