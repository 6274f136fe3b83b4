"""From raw documents to a corpus of unique sentences, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# English stop words, single letters and words of web pages.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn "
    "b c e f g h j k l n p q r u v w x z home page click link read back top next prev previous menu search contact us site map copyright rights reserved"
).split()


def _keys(text: Column, least: int, hidden_emails: bool, phones: bool) -> Column:
    """(key, sent_idx) of the English sentences of ``least`` valid tokens of a document, repeats included; a key is the tokens joined by blanks."""

    def keyed(sentence: Column, k: Column) -> Column:
        key = X.let(X.tokens(sentence), lambda words: F.when(F.size(words) >= least, F.array_join(words, " ")))
        return F.struct(F.when(X.is_english_sentence(sentence), key).alias("key"), k.alias("sent_idx"))

    clean = X.distinct_stripped_lines(X.clean(text, hidden_emails=hidden_emails, phones=phones))
    return F.filter(F.transform(X.sentences(clean), keyed), lambda x: x["key"].isNotNull())


def _exploded(documents: DataFrame, keys: Column) -> DataFrame:
    each = documents.select("doc_id", F.explode(keys).alias("s"))
    return each.select("doc_id", "s.sent_idx", F.split("s.key", " ").alias("tokens"), "s.key")


def all_sentences(documents: DataFrame, *, least: int = 3, phones: bool = True, hidden_emails: bool = True) -> DataFrame:
    """(doc_id, sent_idx, tokens, key): clean, drop repeated lines, split, keep English sentences of ``least`` valid tokens.  One narrow stage."""
    return _exploded(documents, _keys(F.col("text"), least, hidden_emails, phones))


def sentences(documents: DataFrame, *, least: int = 3, phones: bool = True, hidden_emails: bool = True) -> DataFrame:
    """The same with the first of each sentence in its document alone: repeats are neighbours once the document's own array is sorted, so nothing is shuffled."""

    def firsts(every: Column) -> Column:
        return F.filter(every, lambda x, k: (k == 0) | (x["key"] != F.get(every, k - 1)["key"]))

    return _exploded(documents, X.let(F.sort_array(_keys(F.col("text"), least, hidden_emails, phones)), firsts))


def unique_sentences(sents: DataFrame) -> DataFrame:
    """The first of each sentence over all documents, in the order (doc_id, sent_idx); repeats inside a document go by the same step.

    A minimum per key instead of a window: it combines before the shuffle, so a
    sentence that every document repeats is one row per task.
    """
    first = sents.groupBy("key").agg(F.min(F.struct("doc_id", "sent_idx")).alias("first"))
    return first.select("first.doc_id", "first.sent_idx", F.split("key", " ").alias("tokens"), "key")


def tokens(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "sent_idx", F.posexplode("tokens").alias("pos", "word"))


def metadata(sents: DataFrame) -> DataFrame:
    """Sentences, tokens and distinct words of each document: one shuffle, in which a task holds no more than a document's own tokens."""
    each = sents.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens"), F.collect_list("tokens").alias("every"))
    return each.select("doc_id", "sentences", "tokens", F.size(F.array_distinct(F.flatten("every"))).cast("long").alias("vocab_size"))


def summary(sents: DataFrame) -> DataFrame:
    """Totals in one pass: words and documents are counted side by side under a kind."""
    keys = F.concat(F.transform("tokens", lambda w: F.struct(F.lit("w").alias("kind"), w.alias("key"))), F.array(F.struct(F.lit("d").alias("kind"), F.col("doc_id").cast("string").alias("key"))))
    counts = sents.select(F.explode(keys).alias("k")).select("k.*").groupBy("kind", "key").agg(F.count("*").alias("n"))
    word, doc = F.col("kind") == "w", F.col("kind") == "d"
    total = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
    return counts.agg(F.count_if(doc).alias("total_documents"), total(doc).alias("total_sentences"), total(word).alias("total_tokens"), F.count_if(word).alias("vocabulary_size"))


def averages(one: DataFrame) -> DataFrame:
    return one.select("*", F.coalesce(F.try_divide("total_tokens", "total_documents"), F.lit(0.0)).alias("tokens_per_document"), F.coalesce(F.try_divide("total_tokens", "total_sentences"), F.lit(0.0)).alias("tokens_per_sentence"))


def word_counts(sents: DataFrame) -> DataFrame:
    return sents.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def first_seen(sents: DataFrame) -> DataFrame:
    """(word, n, first): counts with the first place of each word in the corpus."""
    return tokens(sents).groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sent_idx", "pos")).alias("first"))


def top_words(counts: DataFrame, k: int = 200, stop_words=STOP_WORDS, shortest: int = 3) -> DataFrame:
    """The most frequent words that are no stop words; ties by first place."""
    kept = counts.filter((F.length("word") >= shortest) & ~F.col("word").isin(*stop_words))
    return kept.orderBy(F.desc("n"), "first").limit(k)


def ranked(top: DataFrame) -> DataFrame:
    """Rank and weight of a top list, which is as small as its k."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy()))
