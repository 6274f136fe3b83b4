"""Shared storage, key rules and graph helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import forget, fresh_path, remove, save, shared_dir  # noqa: F401

#: Words are maximal runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def tuned(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes in this session from now on, whatever the length of the texts; a bound that the user has set stays."""
    for key, value in _BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """Each row of ``df`` as one struct ``d``, beside ``more``: no name of the user's can clash with one of ours.  ``select("d.*")`` unpacks."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("d"), *more)


def without_keys(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not in the only column of ``gone``; a null key stays."""
    return only_ids(packed(df, key.alias("key")), gone.toDF("key"), "key", how="left_anti").select("d.*")


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Like ``save``, as an external table bucketed by ``key``: joins and cogroups on ``key`` read it without a shuffle."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession)
    name = f"lexweave_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._saved_at, out._table = path, name
    return out


def only_ids(df: DataFrame, ids: DataFrame, key: str, most: int = 4_000_000, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (``left_anti``: is not).  The ids are counted first: up to ``most`` (8 bytes each) are broadcast, so that wide rows stay where they are; more are joined by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % divisor, F.lit(-1))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component = smallest node reachable).

    Every round takes the smallest label among neighbours and then jumps to the
    label's own label, so the number of rounds grows with the logarithm of the
    longest path; each round is one join on the edges and is written out.
    """
    both = save(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = save(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.min("component").alias("least"))
        moved = labels.join(near, F.col("node") == F.col("to")).select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        moved = save(moved)
        if not moved.filter("component < old").head(1):
            forget(both)
            return moved.select("node", "component")
        roots = moved.select(F.col("node").alias("root"), F.col("component").alias("up"))
        labels, before = save(moved.join(roots, F.col("component") == F.col("root"), "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"))), labels
        forget(before, moved)


def running_total(df: DataFrame, group: str, order: list[str], amount: str, out: str) -> DataFrame:
    """``out`` = sum of ``amount`` over earlier rows of the same ``group`` in the order of ``order``, without one task per group.

    Rows are range-partitioned by (group, order), so that a large group spans
    many tasks.  Each task sums its own rows; the totals of (partition, group),
    of which there are at most partitions + groups, are summed up to offsets.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = save(df.repartitionByRange(F.col(group).asc_nulls_last(), *keys).withColumn("_part", F.spark_partition_id()))
    each = parts.groupBy("_part", group).agg(F.sum(amount).alias("_sum"))
    before = each.select("_part", F.col(group).alias("_group"), F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_part", group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    part, own = F.col("p._part"), F.col(f"p.{group}")
    parts = parts.withColumn("_within", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return (
        parts.alias("p")
        .join(before.alias("b"), (part == F.col("b._part")) & own.eqNullSafe(F.col("b._group")))
        .select(*[F.col(f"p.{c}") for c in df.columns], (F.col("p._within") + F.col("b._before")).cast("long").alias(out))
    )
