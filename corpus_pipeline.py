"""A training corpus from ``documents`` in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet to the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import save, table
from lexweave.llm.decontaminate import contaminated, without_contaminated
from lexweave.llm.language import recognised
from lexweave.llm.minhash import deduplicated
from lexweave.llm.mixing import mixed_documents
from lexweave.llm.sharding import shard_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised: null or letterless texts, or a posterior below one half.

    Rows without doc_id and repeated rows are judged like all others.  Columns
    pass through, whatever their names; an empty table gives an empty result.
    """
    return recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8), one row of it.

    Rows without doc_id stay.  Columns pass through, whatever their names; an
    empty table gives an empty result.
    """
    return deduplicated(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of a benchmark item or more.

    Rows without doc_id stay; of a repeated doc_id all rows go if one is
    contaminated.  Columns pass through, whatever their names; an empty table
    gives an empty result, an empty benchmark drops nothing.
    """
    return without_contaminated(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; a document taken twice comes twice, one without words not at all.

    Rows without doc_id or source, and repeated rows, are mixed like all others.
    Columns pass through, whatever their names; an empty table gives an empty result.
    """
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the mix into 40 shards of equal row counts, equal texts together; one row per input row, nulls and repeats included.

    An empty table gives an empty result; other columns are left behind.
    """
    return shard_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Trained, iterative and randomised stages have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs)
    return docs
