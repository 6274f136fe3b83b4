"""Readers and writers of corpora, models and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source_kind, source, text) of every ``.txt`` file; doc_id is the file name.

    A first line ``SOURCE_URL:`` or ``SOURCE_PDF:`` tells the source.  Small
    files are packed into splits by Spark's file source.
    """
    whole = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    named = whole.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    head = F.regexp_extract("text", r"^SOURCE_(URL|PDF):[ \t]*([^\n]*)", 1)
    return named.select("doc_id", F.nullif(F.lower(head), F.lit("")).alias("source_kind"), F.nullif(F.trim(F.regexp_extract("text", r"^SOURCE_(URL|PDF):[ \t]*([^\n]*)", 2)), F.lit("")).alias("source"), "text")


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sent, tokens) of a corpus with one sentence per line; blank lines are skipped."""
    lines = spark.read.text(path).filter(X.stripped(F.col("value")) != "")
    return lines.select(F.col("value").alias("sent"), F.filter(F.split("value", rf"{X.SPACE}+"), lambda w: w != "").alias("tokens"))


def write_corpus(sents: DataFrame, path: str) -> None:
    """One sentence per line, in the order (doc_id, sent_idx): a range sort, then one file per range."""
    sents.repartitionByRange("doc_id", "sent_idx").sortWithinPartitions("doc_id", "sent_idx").select("key").write.mode("overwrite").text(path)


def write_documents(sents: DataFrame, path: str) -> None:
    """The sentences of each document as one text row, written as Parquet by document."""
    ordered = F.sort_array(F.collect_list(F.struct("sent_idx", "key")))
    sents.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["key"]), "\n").alias("text")).write.mode("overwrite").parquet(path)


def names(spark: SparkSession, path: str) -> DataFrame:
    """Lower-cased, stripped, non-empty lines with a number in file order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("name_id"), F.lower(F.trim("value")).alias("name"))
    return lines.filter("name <> ''")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """(word, idx, vector) of one model, kept beside other models by partition."""
    vectors.withColumn("model", F.lit(model)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if model is None else df.filter(F.col("model") == model)


def write_crawl_log(log: DataFrame, path: str) -> None:
    """(url, status, text_file, pdfs) as JSON lines; absent values are left out."""
    log.write.mode("overwrite").json(path)


def read_crawl_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, status string, text_file string, pdfs array<struct<url: string, file: string>>").json(path)
