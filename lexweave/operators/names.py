"""Character vocabularies, sequences and evaluation of generated names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

# The numbers of the special characters.
PAD, SOS, EOS = 0, 1, 2


def load(lines: DataFrame, column: str) -> DataFrame:
    return lines.withColumn(column, F.lower(F.trim(column))).filter(F.col(column) != "")


def characters(name: Column) -> Column:
    return F.filter(F.split(name, ""), lambda c: c != "")


def char_vocab(names: DataFrame, column: str) -> DataFrame:
    """(ch, idx): distinct characters in order, numbered after the special ones."""
    every = names.select(F.explode(F.array_distinct(characters(F.col(column)))).alias("ch")).distinct()
    return numbered(every, "ch").select("ch", (F.col("idx") + 3).cast("int").alias("idx"))


def encoded(names: DataFrame, vocab: DataFrame, column: str, key: str) -> DataFrame:
    """SOS, characters, EOS as numbers.  The alphabet, one row per character in use, is one map."""
    alphabet = vocab.agg(F.map_from_entries(F.collect_list(F.struct("ch", "idx"))).alias("map"))
    ids = F.transform(characters(F.col(column)), lambda c: F.col("map")[c])
    return names.crossJoin(F.broadcast(alphabet)).select(key, F.concat(F.array(F.lit(SOS)), ids, F.array(F.lit(EOS))).alias("seq"))


def decoded(seqs: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Characters up to the first EOS, without PAD and SOS."""
    alphabet = vocab.agg(F.map_from_entries(F.collect_list(F.struct("idx", "ch"))).alias("map"))
    end = F.array_position("seq", EOS).cast("int")
    body = F.when(end > 0, F.slice("seq", F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(F.col("seq"))
    text = F.array_join(F.transform(F.filter(body, lambda i: i > EOS), lambda i: F.col("map")[i]), "")
    return seqs.crossJoin(F.broadcast(alphabet)).select(key, text.alias("name"))


def padded(seqs: DataFrame, key: str) -> DataFrame:
    longest = seqs.agg(F.max(F.size("seq")).alias("longest"))
    return seqs.crossJoin(F.broadcast(longest)).select(key, F.concat("seq", F.array_repeat(F.lit(PAD), F.col("longest") - F.size("seq"))).alias("seq"))


def one_hot(index: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == index, 1).otherwise(0))


def split(names: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """(key, part): the first ``share`` in the order of a hash is for training."""
    ordered = numbered(names.select(key, F.md5(F.col(key).cast("string")).alias("shuffle")), "shuffle", key)
    total = names.agg(F.count("*").alias("total"))
    return ordered.crossJoin(F.broadcast(total)).select(key, F.when(F.col("idx") < F.floor(F.col("total") * share), "train").otherwise("val").alias("part"))


def novelty(generated: DataFrame, training: DataFrame, column: str) -> DataFrame:
    """Percentage of rows whose name, in lower case, is in no training row; 0 without rows."""
    known = training.select(F.lower(column).alias("low")).distinct().withColumn("known", F.lit(1))
    marked = generated.select(F.lower(column).alias("low")).join(known, "low", "left")
    return marked.agg(F.coalesce(100.0 * F.try_divide(F.count_if(F.col("known").isNull()), F.count("*")), F.lit(0.0)).alias("novelty"))


def diversity(generated: DataFrame, column: str) -> DataFrame:
    each = generated.groupBy(column).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(100.0 * F.try_divide(F.count("*"), F.sum("n")), F.lit(0.0)).alias("diversity"))


def failures(generated: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return generated.agg(
        F.count_if(n < 3).alias("too_short"), F.count_if(n > 25).alias("too_long"), F.count_if(~F.contains(F.col(column), F.lit(" "))).alias("no_space"),
        F.count_if(F.col(column).rlike(r"(\p{L})\1\1")).alias("repeated"), F.avg(n).alias("mean_length"),
    )


def lengths(names: DataFrame, column: str) -> DataFrame:
    each = names.groupBy(F.length(column).alias("length")).agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("length", "n", (F.col("n") / F.col("total")).alias("density"))


def plateau(losses: Column, *, rate: float = 0.003, factor: float = 0.3, floor: float = 1e-5, slow: int = 3, patience: int = 6, least: float = 1e-5) -> Column:
    """Fold over losses: (epochs, best, rate, stopped).  A gain must exceed ``least``; ``slow`` misses cut the rate, ``patience`` misses stop."""
    start = F.struct(F.lit(0).alias("epochs"), F.lit(float("inf")).alias("best"), F.lit(rate).alias("rate"), F.lit(0).alias("missed"), F.lit(0).alias("flat"), F.lit(False).alias("stopped"))

    def step(s: Column, x: Column) -> Column:
        better = x < s["best"] - least
        flat = F.when(better, 0).otherwise(s["flat"] + 1)
        missed = F.when(better, 0).otherwise(s["missed"] + 1)
        cut = flat >= slow
        new = F.struct(
            (s["epochs"] + 1).alias("epochs"), F.when(better, x).otherwise(s["best"]).alias("best"), F.when(cut, F.greatest(s["rate"] * factor, F.lit(floor))).otherwise(s["rate"]).alias("rate"),
            missed.alias("missed"), F.when(cut, 0).otherwise(flat).alias("flat"), (missed >= patience).alias("stopped"),
        )
        return F.when(s["stopped"], s).otherwise(new)

    return F.aggregate(losses, start, step)


def loss_table(history: DataFrame, models: list[str], every: int = 3) -> DataFrame:
    """One row for each ``every``-th epoch from the first on, and the last, up to the end of the shortest run; a column for each model."""
    shortest = history.groupBy("model").agg(F.max("epoch").alias("n")).agg(F.min("n").alias("n"))
    kept = history.crossJoin(F.broadcast(shortest)).filter(((F.col("epoch") - 1) % every == 0) & (F.col("epoch") <= F.col("n")) | (F.col("epoch") == F.col("n")))
    return kept.groupBy("epoch").pivot("model", models).agg(F.max("loss"))


def summary(history: DataFrame) -> DataFrame:
    """Epochs, last and best loss of each model."""
    return history.groupBy("model").agg(F.max("epoch").alias("epochs"), F.max_by("loss", "epoch").alias("final_loss"), F.min("loss").alias("best_loss"))


def sweep_difference(runs: DataFrame, one: str, other: str) -> DataFrame:
    """(arch, win, one, other, diff): mean similarity of two kinds of runs side by side."""
    sides = runs.groupBy("arch", "win").pivot("kind", [one, other]).agg(F.round(F.avg("sim"), 4))
    return sides.withColumn("diff", F.round(F.col(one) - F.col(other), 4))


def evaluated(generated: DataFrame, training: DataFrame, column: str, model: str) -> DataFrame:
    """Novelty, diversity, failures and mean length of the names of each ``model`` in one pass over them, and one over distinct names."""
    known = training.select(F.lower(column).alias("low")).distinct().withColumn("known", F.lit(1))
    each = generated.groupBy(model, column).agg(F.count("*").alias("n")).withColumn("low", F.lower(column)).join(known, "low", "left")
    size = F.length(column)
    count = lambda of: F.sum(F.when(of, F.col("n")).otherwise(0))
    total = F.sum("n")
    return each.groupBy(model).agg(
        total.alias("generated"), (100.0 * count(F.col("known").isNull()) / total).alias("novelty"), (100.0 * F.count("*") / total).alias("diversity"),
        count(size < 3).alias("too_short"), count(size > 25).alias("too_long"), count(~F.contains(F.col(column), F.lit(" "))).alias("no_space"),
        count(F.col(column).rlike(r"(\p{L})\1\1")).alias("repeated"), (F.sum(size * F.col("n")) / total).alias("mean_length"),
    )
