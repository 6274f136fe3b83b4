"""Sentence splitting without a word list: abbreviations, collocations and sentence starters found in the corpus by log-likelihood ratios.

After Kiss and Strunk, "Unsupervised multilingual sentence boundary detection"
(2006).  Counts are aggregates over all tokens; decisions are joins of the few
periods that may not end a sentence, those after abbreviations, initials,
numbers and dots in a row, with the small tables of what was found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, let
from ..storage import save

#: Published thresholds: abbreviations, collocations, sentence starters; and the assumed share of periods after an abbreviation.
ABBREVIATION, COLLOCATION, STARTER, PERIOD = 0.3, 7.88, 30.0, 0.99
CLOSERS = "\"')]}»”’"
ENDS = r"""[.!?]["')\]}»”’]*\z"""
DOTS = r"""[.][.]["')\]}»”’]*\z"""
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+\z"
NUMBER = r"^[0-9.,-]*[0-9][0-9.,-]*\z"


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def kind(raw: Column) -> Column:
    """A token's type: lower-cased, without what stands around letters and numbers, but with a final period."""
    return F.lower(F.regexp_replace(raw, EDGES, ""))


def bare(raw: Column) -> Column:
    """The type without final periods; numbers are one type."""
    w = F.rtrim(kind(raw), F.lit("."))
    return F.when(w.rlike(NUMBER), F.lit("##number##")).otherwise(w)


def first_letter(raw: Column) -> Column:
    return F.substring(F.regexp_replace(raw, r"^[^\p{L}\p{N}]+", ""), 1, 1)


def _before_closers(raw: Column) -> Column:
    return F.rtrim(raw, F.lit(CLOSERS))


def ends(raw: Column) -> Column:
    """Whether a token ends in a sentence mark, before any closing quotes and brackets."""
    return F.right(_before_closers(raw), F.lit(1)).isin(".", "!", "?")


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, all): the tokens of each document, one array."""
    return documents.select("doc_id", words(F.col("text")).alias("all"))


def marks(seen: DataFrame) -> DataFrame:
    """(doc_id, pos, w, dot, ends, dots, after_w, after_upper, after_lower): the tokens that end in a sentence mark or in a period and have one after them, and a row at -1 for the start of each document.

    They are picked inside the arrays; no row holds more than its two tokens.
    """
    def near(all_: Column) -> Column:
        may = lambda x: x.contains(".") | x.contains("!") | x.contains("?")
        places = F.filter(F.when(F.size(all_) > 0, F.sequence(F.lit(-1), F.size(all_) - 2)), lambda k: (k < 0) | may(F.get(all_, k)))
        return F.transform(places, lambda k: F.struct(k.alias("pos"), F.when(k < 0, "").otherwise(F.get(all_, k)).alias("raw"), F.get(all_, k + 1).alias("after")))

    raw, after = F.col("raw"), F.col("after")
    return seen.select("doc_id", F.explode(let(F.col("all"), near)).alias("t")).select("doc_id", "t.*").select(
        "doc_id", "pos", bare(raw).alias("w"), kind(raw).endswith(".").alias("dot"), ends(raw).alias("ends"), _before_closers(raw).endswith("..").alias("dots"),
        bare(after).alias("after_w"), first_letter(after).rlike(r"^\p{Lu}").alias("after_upper"), first_letter(after).rlike(r"^\p{Ll}").alias("after_lower"),
    ).filter("ends or dot or pos < 0")


def likelihood(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events seen ``a`` and ``b`` times, ``both`` times together, in ``n`` places."""
    def part(k: Column, rest: Column, p: Column) -> Column:
        return F.when((p <= 0) | (p >= 1), 0.0).otherwise(k * F.log(F.greatest(p, F.lit(1e-300))) + rest * F.log(F.greatest(1 - p, F.lit(1e-300))))

    p, p1, p2 = F.try_divide(b, n), F.try_divide(both, a), F.coalesce(F.try_divide(b - both, n - a), F.lit(1.0))
    first = part(both, a - both, p) + part(b - both, n - a - b + both, p)
    second = F.when(a == both, 0.0).otherwise(part(both, a - both, p1)) + F.when(b == both, 0.0).otherwise(part(b - both, n - a - b + both, p2))
    return -2 * (first - second)


@dataclass
class Model:
    """Tables of what was found: marks (as ``marks`` gives them), abbreviations (w), ortho (w, lower, upper, mid_upper, opens_lower), starters (w) and collocations (w, after_w)."""

    marks: DataFrame
    abbreviations: DataFrame
    ortho: DataFrame
    starters: DataFrame
    collocations: DataFrame


def counted(seen: DataFrame) -> DataFrame:
    """(w, c_dot, c, lower, upper): counts of each type.  Equal tokens are counted first, so that types are found once for each."""
    raw = F.col("raw")
    alike = seen.select(F.explode("all").alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    alike = alike.select("n", bare(raw).alias("w"), kind(raw).endswith(".").alias("dot"), first_letter(raw).rlike(r"^\p{Lu}").alias("upper"), first_letter(raw).rlike(r"^\p{Ll}").alias("lower"))
    count = lambda of: F.sum(F.when(F.col(of), F.col("n")).otherwise(0)).alias(of)
    return alike.groupBy("w").agg(count("dot").alias("c_dot"), F.sum("n").alias("c"), count("lower"), count("upper"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(w, score) of the types that end in a period more often than chance, are short, and hold periods inside."""
    total = counts.agg(F.sum("c").alias("n"), F.sum("c_dot").alias("n_dot"))
    k, rest, share = F.col("c_dot"), F.col("c") - F.col("c_dot"), F.col("n_dot") / F.col("n")
    null = k * F.log(F.greatest(share, F.lit(1e-300))) + rest * F.log(1 - share + 1e-8)
    other = k * F.log(F.lit(PERIOD)) + rest * F.log(F.lit(1 - PERIOD))
    inside = F.length("w") - F.length(F.translate("w", ".", ""))
    letters = F.length("w") - inside
    score = -2 * (null - other) * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -rest)
    some = counts.filter((k > 0) & F.col("w").rlike(r"\p{L}") & (F.col("w") != "##number##")).crossJoin(F.broadcast(total))
    return some.withColumn("score", score).filter(F.col("score") >= ABBREVIATION).select("w", F.round("score", 6).alias("score"))


def learn(seen: DataFrame) -> Model:
    """``seen`` as ``tokens`` gives it; read twice, of which few rows are kept."""
    counts, seen = save(counted(seen)), save(marks(seen))
    found = save(abbreviations(counts))
    n = F.lit(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    known = found.select("w", F.lit(True).alias("abbr"))

    # Ends of the first pass: marks after anything but an abbreviation.
    last = seen.filter("ends").select("w", "dot", "dots", "after_w", "after_lower").join(known, "w", "left")
    breaks = save(last.filter("not dots and not (dot and coalesce(abbr, false))").groupBy("after_w").agg(F.count("*").alias("both"), F.sum(F.when(F.col("after_lower"), 1).otherwise(0)).alias("opens_lower")))
    at = F.lit(breaks.agg(F.coalesce(F.sum("both"), F.lit(0))).first()[0])
    lone = counts.filter("w <> '' and w <> '##number##'").select("w", "c").join(breaks.withColumnRenamed("after_w", "w"), "w")
    starters = lone.filter((likelihood(at, F.col("c"), F.col("both"), n) >= STARTER) & (F.try_divide(n, at) > F.col("c") / F.col("both"))).select("w")

    special = seen.filter("dot").join(known, "w", "left").filter((F.col("abbr").isNotNull()) | F.col("w").rlike(r"^\p{L}\z") | (F.col("w") == "##number##"))
    pairs = special.filter("after_w <> ''").groupBy("w", "after_w").agg(F.count("*").alias("both"))
    pairs = pairs.join(counts.select("w", F.col("c").alias("ca")), "w").join(counts.select(F.col("w").alias("after_w"), F.col("c").alias("cb")), "after_w")
    together = pairs.filter((likelihood(F.col("ca"), F.col("cb"), F.col("both"), n) >= COLLOCATION) & (F.try_divide(n, F.col("ca")) > F.col("cb") / F.col("both"))).select("w", "after_w")
    # Upper-case tokens that begin neither a document nor what follows a mark: all but those that do.
    begin = seen.filter("(ends or pos < 0) and after_upper").groupBy(F.col("after_w").alias("w")).agg(F.count("*").alias("begin_upper"))
    ortho = counts.join(breaks.select(F.col("after_w").alias("w"), "opens_lower"), "w", "left").join(begin, "w", "left")
    ortho = ortho.select("w", "lower", "upper", (F.col("upper") - F.coalesce("begin_upper", F.lit(0))).alias("mid_upper"), F.coalesce("opens_lower", F.lit(0)).alias("opens_lower"))
    return Model(seen, found.select("w"), save(ortho), save(starters), save(together))


def breaks(model: Model) -> DataFrame:
    """(doc_id, pos): tokens that end a sentence, the last of a document not among them."""
    ends = model.marks.filter("ends").join(model.abbreviations.withColumn("abbr", F.lit(True)), "w", "left").withColumn("abbr", F.coalesce("abbr", F.lit(False)) & F.col("dot"))
    initial, number = F.col("w").rlike(r"^\p{L}\z"), F.col("w") == "##number##"
    ends = ends.withColumn("initial", initial & F.col("dot")).withColumn("number", number & F.col("dot"))
    plain = ends.filter("not abbr and not dots and not initial and not number").select("doc_id", "pos")
    doubtful = ends.filter("abbr or dots or initial or number")
    about = doubtful.join(model.collocations.withColumn("together", F.lit(True)), ["w", "after_w"], "left")
    about = about.join(model.ortho.select(F.col("w").alias("after_w"), F.col("lower").alias("o_lower"), F.col("upper").alias("o_upper"), "mid_upper", "opens_lower"), "after_w", "left")
    about = about.join(model.starters.select(F.col("w").alias("after_w"), F.lit(True).alias("starter")), "after_w", "left")
    n = lambda c: F.coalesce(c, F.lit(0)) > 0
    opens = F.col("after_upper") & n(F.col("o_lower")) & ~n(F.col("mid_upper"))
    goes_on = F.col("after_lower") & (n(F.col("o_upper")) | ~n(F.col("opens_lower")))
    first = ~F.col("abbr") & ~F.col("dots")
    after_short = opens | (F.col("after_upper") & F.coalesce("starter", F.lit(False)))
    unknown_name = ~opens & ~goes_on & F.col("initial") & F.col("after_upper") & ~n(F.col("o_lower"))
    ends_here = (
        F.when(F.coalesce("together", F.lit(False)) & F.col("dot"), False)
        .when((F.col("abbr") | F.col("dots")) & ~F.col("initial") & after_short, True)
        .when((F.col("initial") | F.col("number")) & (goes_on | unknown_name), False)
        .otherwise(first)
    )
    return plain.union(about.filter(ends_here).select("doc_id", "pos"))


def sentences(documents: DataFrame, at: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, sentence): the words of each document between its breaks, joined by blanks."""
    cuts = at.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("cuts"))
    each = documents.join(cuts, "doc_id", "left").select("doc_id", words(F.col("text")).alias("all"), F.coalesce("cuts", F.array().cast("array<int>")).alias("cuts"))

    def between(all_: Column, ends_: Column) -> Column:
        lo = lambda k: F.when(k == 0, 0).otherwise(F.get(ends_, k - 1) + 1)
        return F.transform(ends_, lambda e, k: F.array_join(F.slice(all_, lo(k) + 1, e - lo(k) + 1), " "))

    parts = let(F.col("all"), lambda a: F.when(F.size(a) > 0, let(F.concat(F.col("cuts"), F.array(F.size(a) - 1)), lambda ends_: between(a, ends_))))
    return each.select("doc_id", F.posexplode(parts).alias("sent_idx", "sentence"))


def split(documents: DataFrame) -> DataFrame:
    """Sentences of ``documents`` (doc_id, text) under what their own tokens show."""
    return sentences(documents, save(breaks(learn(tokens(documents)))))
