"""From a folder of raw texts to a corpus, models and reports: ``python -m lexweave.runner RAW OUT``.

Steps run in order in one session; each reads what earlier ones wrote, and the
first that fails ends the run under its name.  What is drawn elsewhere as a
figure is written as the table behind it.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus as C
from .operators import training as T
from .operators import vectors as O
from .operators import vocabulary as V
from .sources import files as S


@dataclass
class Run:
    """Folders and settings of a run; words that are in no vocabulary are reported, not asked for."""

    spark: SparkSession
    raw: str
    out: str
    least_count: int = 5
    training: dict = field(default_factory=dict)
    architectures: tuple[str, ...] = ("cbow", "skipgram")
    probes: tuple[str, ...] = ()
    analogies: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)  # label: positive, negative, expected
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.out.rstrip('/')}/{name}"

    def words(self) -> DataFrame:
        return self.spark.read.parquet(self.path("vocabulary"))

    def vectors(self, model: str) -> DataFrame:
        return S.vectors(self.spark, self.path("models"), model).select(F.col("idx").alias("vec_id"), "word", "vector")

    def numbers(self, rows: list, kind: str) -> DataFrame:
        """Literal rows whose column ``word`` is numbered by the vocabulary; null where it is not in it."""
        return self.spark.createDataFrame(rows, kind).join(self.words().select("word", F.col("idx").alias("vec_id")), "word", "left")


def corpus(run: Run) -> None:
    docs = S.raw_documents(run.spark, run.raw)
    C.unique_sentences(C.all_sentences(docs)).write.mode("overwrite").parquet(run.path("sentences"))
    sents = run.spark.read.parquet(run.path("sentences"))
    S.write_corpus(sents, run.path("corpus"))
    S.write_documents(sents, run.path("documents"))
    S.write_results(C.metadata(sents), run.path("metadata"))
    S.write_results(C.averages(C.summary(sents)), run.path("summary"))


def statistics(run: Run) -> None:
    sents = run.spark.read.parquet(run.path("sentences"))
    S.write_results(C.ranked(C.top_words(C.first_seen(sents))).select("rank", "word", "n", "weight"), run.path("top_words"))
    V.vocabulary(C.word_counts(sents), run.least_count).write.mode("overwrite").parquet(run.path("vocabulary"))


def models(run: Run) -> None:
    sents = run.spark.read.parquet(run.path("sentences"))
    losses = []
    for arch in run.architectures:
        vectors, history = T.train(sents, run.words(), arch, **run.training)
        S.write_vectors(vectors, run.path("models"), arch)
        losses += [(arch, epoch + 1, float(loss)) for epoch, loss in enumerate(history)]
    S.write_results(run.spark.createDataFrame(losses, "model string, epoch int, loss double"), run.path("losses"))


def _neighbours(run: Run, model: str, asked: DataFrame) -> DataFrame:
    v = run.vectors(model)
    return O.nearest(v, asked.join(v.select("vec_id", "vector"), "vec_id").select(F.col("vec_id").alias("query"), "vector", F.array("vec_id").alias("exclude")))


def semantics(run: Run) -> None:
    """Neighbours of the probes, answers of the analogies, words that are missing, and neighbours that all models agree on."""
    asked = run.numbers([(w,) for w in run.probes], "word string")
    terms = run.numbers([(label, w, sign, k) for label, (plus, minus, _) in run.analogies.items() for sign, words in (("positive", plus), ("negative", minus)) for k, w in enumerate(words)], "label string, word string, sign string, pos int")
    missing = asked.select(F.lit("probe").alias("of"), "word", "vec_id").union(terms.select("label", "word", "vec_id")).filter("vec_id is null").select("of", "word").distinct()
    S.write_results(missing, run.path("missing"))
    whole = terms.groupBy("label").agg(*[F.collect_list(F.when(F.col("sign") == s, F.col("vec_id"))).alias(s) for s in ("positive", "negative")], F.count_if(F.col("vec_id").isNull()).alias("missing"))
    whole = whole.filter("missing = 0").withColumn("query", F.xxhash64("label"))
    word = run.words().select(F.col("idx").alias("vec_id"), "word")
    near, answers = [], []
    for model in run.architectures:
        found = _neighbours(run, model, asked.filter("vec_id is not null")).join(word, "vec_id").join(word.select(F.col("vec_id").alias("query"), F.col("word").alias("probe")), "query")
        near.append(found.select(F.lit(model).alias("model"), "probe", "rank", "word", F.round("score", 4).alias("score")))
        v = run.vectors(model)
        top = O.nearest(v, O.analogies(v, whole.select("query", "positive", "negative"), True)).join(word, "vec_id").join(whole.select("query", "label"), "query")
        answers.append(top.select(F.lit(model).alias("model"), "label", "rank", "word", F.round("score", 4).alias("score")))
    near, answers = (functools.reduce(DataFrame.union, x) for x in (near, answers))
    S.write_results(near, run.path("neighbours"))
    S.write_results(answers, run.path("analogies"))
    expected = run.spark.createDataFrame([(label, list(words)) for label, (_, _, words) in run.analogies.items()], "label string, expected array<string>")
    hits = answers.filter("rank = 1").join(expected, "label").groupBy("model").agg(F.count_if(F.array_contains(F.col("expected"), F.col("word"))).alias("hits"), F.count("*").alias("answered"))
    S.write_results(hits, run.path("hits"))
    agreed = run.spark.read.schema(near.schema).json(run.path("neighbours")).groupBy("probe", "word").agg(F.count("*").alias("models"))
    S.write_results(agreed.groupBy("probe").agg((F.count_if(F.col("models") == len(run.architectures)) / 5).alias("agreement")), run.path("agreement"))


def projections(run: Run) -> None:
    """Places of the group words in two dimensions, by principal components and by t-SNE."""
    named = run.numbers([(g, w) for g, words in run.groups.items() for w in words], "grp string, word string").filter("vec_id is not null")
    out = []
    for model in run.architectures:
        points = named.join(run.vectors(model).select("vec_id", "vector"), "vec_id")
        if points.count() < 5:  # too few for a picture
            continue
        flat = {"pca": O.pca(points.select("vec_id", "vector")), "tsne": O.tsne(points.select(F.lit(0).alias("grp"), "vec_id", "vector"))}
        out += [points.join(xy.select("vec_id", "x", "y"), "vec_id").select(F.lit(model).alias("model"), F.lit(by).alias("by"), "grp", "word", "x", "y") for by, xy in flat.items()]
    if out:
        S.write_results(functools.reduce(DataFrame.union, out), run.path("projections"))


def comparison(run: Run) -> None:
    """Linear CKA of every two models over their common words."""
    out = []
    for k, a in enumerate(run.architectures):
        for b in run.architectures[k + 1 :]:
            x, y = run.vectors(a), run.vectors(b)
            both = x.join(y.select("vec_id", F.col("vector").alias("other")), "vec_id").select("vec_id", "vector", "other")
            d = both.select(F.size("vector"), F.size("other")).first()
            if d:
                out.append(O.cka(both.select(F.concat("vector", "other").alias("vector")), [(a, 0, d[0]), (b, d[0], d[0] + d[1])]))
    if out:
        S.write_results(functools.reduce(DataFrame.union, out), run.path("cka"))


STEPS = (corpus, statistics, models, semantics, projections, comparison)


class StepFailed(RuntimeError):
    """A step of a run has failed; the cause says why."""


def execute(run: Run, steps=STEPS) -> list[str]:
    """Run the steps in order; the names of those done.  The first failure ends the run."""
    done = []
    for step in steps:
        try:
            step(run)
        except Exception as e:
            raise StepFailed(f"step {step.__name__} failed after {', '.join(done) or 'none'}") from e
        done.append(step.__name__)
    return done


if __name__ == "__main__":
    session = SparkSession.builder.appName("lexweave").getOrCreate()
    print("done:", *execute(Run(session, *sys.argv[1:3])))
    session.stop()
