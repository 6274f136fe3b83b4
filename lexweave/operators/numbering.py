"""Row numbers and running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save

#: ``monotonically_increasing_id`` holds the partition above and the place in it below this many bits.
PLACE_BITS = 33


def ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` sorted by range over many tasks and saved, with ``_id``: ascending in the given order, task above place.

    The table is saved before anything is counted on it: a second look at an unsaved range partitioning may cut it
    elsewhere.
    """
    return save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))


def part(id_: str | Column = "_id") -> Column:
    return F.shiftright(id_, PLACE_BITS)


def place(id_: str | Column = "_id") -> Column:
    return (F.col(id_) if isinstance(id_, str) else id_).bitwiseAND((1 << PLACE_BITS) - 1)


def numbered(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """Number rows from 0 in the given order, in one shuffle.

    A task's first number is the sum of the sizes before it; there is one size
    per task.  Rows that tie get different numbers, in no particular order.
    """
    parts = ordered(df, *order)
    sizes = parts.groupBy(part().alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    out = parts.withColumn("_part", part()).join(F.broadcast(before), "_part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place()).cast("long").alias(name))


def spans(df: DataFrame, order: str, amount: str) -> DataFrame:
    """``lo`` and ``hi`` of each row where rows lie end to end in the given order, ``amount`` long: sums inside tasks, and one offset per task."""
    parts = ordered(df, order).withColumn("_part", part())
    sums = parts.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    upto = F.sum(amount).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("_upto", F.coalesce(upto, F.lit(0.0))).join(F.broadcast(before), "_part")
    lo = F.col("_before") + F.col("_upto")
    return placed.select(*df.columns, lo.alias("lo"), (lo + F.col(amount)).alias("hi"))


def as_of(points: DataFrame, at: str, starts: DataFrame, lo: str, carried: list[str]) -> DataFrame:
    """Each point with the ``carried`` columns of the last start at or before it.

    Points and starts are sorted together by range, so no cell or bucket has to
    be chosen and a start with many points spreads over many tasks; what a task
    has before its first start is the last start of an earlier task, one row
    per task.
    """
    start = F.struct(*carried)
    both = (
        starts.select(F.col(lo).alias("_at"), F.lit(0).alias("_kind"), start.alias("_start"))
        .unionByName(points.select(F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point")), allowMissingColumns=True)
    )
    parts = ordered(both, "_at", "_kind").withColumn("_part", part())
    last = parts.filter("_kind = 0").groupBy("_part").agg(F.max_by("_start", "_id").alias("_last"))
    parts_of = parts.select("_part").distinct().join(F.broadcast(last), "_part", "left")
    carry = parts_of.select("_part", F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    near = F.last("_start", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    found = parts.withColumn("_near", near).filter("_kind = 1").join(F.broadcast(carry), "_part")
    return found.select("_point.*", F.coalesce("_near", "_carry").alias("_start")).select(*points.columns, "_start.*")
