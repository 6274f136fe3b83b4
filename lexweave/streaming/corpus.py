"""The corpus as a stream: new documents in, unique sentences and word counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def sentences(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, sent_idx, key) of cleaned English sentences; stateless."""
    text = X.distinct_stripped_lines(X.clean(F.col("text")))
    each = docs.select("doc_id", F.posexplode(X.sentences(text)).alias("sent_idx", "sentence")).filter(X.is_english_sentence(F.col("sentence")))
    cut = each.select("doc_id", "sent_idx", X.tokens(F.col("sentence")).alias("tokens")).filter(F.size("tokens") >= least)
    return cut.select("doc_id", "sent_idx", F.array_join("tokens", " ").alias("key"))


def unique_sentences(sents: DataFrame) -> DataFrame:
    """The first arrival of each sentence; the state is one key per distinct sentence."""
    return sents.dropDuplicates(["key"])


def word_counts(sents: DataFrame) -> DataFrame:
    return sents.select(F.explode(F.split("key", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def append_corpus(sents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write unique sentences exactly once, as they come, and stop when all files present are done."""
    return unique_sentences(sents).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
