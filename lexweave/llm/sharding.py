"""Sharding by balanced label propagation.

Documents are linked when their texts are equal.  The links of a group are kept
as one hub, never as pairs: what a document sees of its neighbours is the
group's count per shard.  In each round, a document moves to the shard where
most of its group is, if that shard has room; when more want to enter a shard
than fit, each enters with the probability that fills it (a quota).  Shards
that are full stay closed, so a group too large for one shard fills several.
Rounds go on until no document wishes to move.  That ends: whoever moves joins
at least as many of its group as it leaves, so the sum of squares of the groups'
counts per shard grows with every move, and an open shard always lets some in.

At the end the row counts are made exact: documents beyond a shard's quota,
group by group, and then all documents without a link fill what is left.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, running_total, save, tuned


def quotas(sizes: np.ndarray, wanted: np.ndarray, room: float) -> np.ndarray:
    """Probability of entering each shard: the largest that, with what leaves it, keeps every shard within ``room``."""
    enter = np.ones(len(sizes))
    for _ in range(60):
        left = (wanted * enter[None, :]).sum(1)
        into = wanted.sum(0)
        enter = np.minimum(enter, np.clip((room - sizes + left) / np.maximum(1, into), 0, 1))
    return enter


def uniform(*columns: Column | str) -> Column:
    return (F.xxhash64(*columns) % (1 << 30) + (1 << 30)) % (1 << 30) / float(1 << 30)


def shard_documents(documents: DataFrame, *, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked) of every row; the law is ``rows``.

    Shard counts differ by one at most.  ``slot`` numbers a shard's rows from 0
    by doc_id, a null one first.  A null text has size 16, no crc32 and no link;
    equal empty texts are linked.  ``linked`` is the size of the row's group.
    Rows that repeat a doc_id are rows of their own.  Only a text's length and
    hashes are kept, so its length does not matter.  Ties between shards go by a
    hash of group and shard, ties between rows by their rank in the order of
    (doc_id, text hash), so the result depends on the rows alone, however they
    are partitioned.  Other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    tuned(documents.sparkSession)
    t = F.col(text)
    base = save(
        documents.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(t).alias("text_crc32"),
            F.md5(t).alias("hub"),
            F.lit(1).alias("one"),
            F.lit(0).alias("all"),
            F.monotonically_increasing_id().alias("seq"),  # tells apart rows that are equal in all that counts
        )
    )
    hubs = save(base.filter("hub is not null").groupBy("hub").agg(F.count("*").alias("linked")).filter("linked > 1"))
    ranked = running_total(base, "all", ["doc_id", "hub", "seq"], "one", "row").drop("seq")
    linked = ranked.filter("hub is not null").join(hubs, "hub", "left").select(*ranked.columns, F.coalesce("linked", F.lit(1)).alias("linked"))
    rows = save(linked.union(ranked.filter("hub is null").withColumn("linked", F.lit(1).cast("long"))))
    forget(base, hubs)
    total = rows.count()
    floor, more = divmod(total, shards)
    now = save(rows.filter("linked > 1").select("row", "hub", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")))
    for k in itertools.count():
        seen = save(now.groupBy("hub", "shard").agg(F.count("*").alias("n")))
        sizes = np.zeros(shards)
        for s, n in seen.groupBy("shard").agg(F.sum("n")).collect():  # one row per shard
            sizes[s] = n
        open_ = [s for s in range(shards) if sizes[s] < floor]
        best = F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard"))
        goal = seen.filter(F.col("shard").isin(open_)).groupBy("hub").agg(best.alias("best")).select("hub", F.col("best.n").alias("most"), F.col("best.tie").alias("tie"), F.col("best.shard").alias("goal"))
        wish = seen.join(goal, "hub").filter((F.col("shard") != F.col("goal")) & (F.struct("most", "tie") > F.struct(F.col("n").alias("most"), F.xxhash64("hub", "shard").alias("tie"))))
        wish = save(wish.select("hub", "shard", "goal", "n"))
        wanted = np.zeros((shards, shards))
        for a, b, n in wish.groupBy("shard", "goal").agg(F.sum("n")).collect():  # shards x shards at most
            wanted[a, b] = n
        if not wanted.sum():
            forget(seen, wish)
            break
        enter = F.element_at(F.array(*(F.lit(float(x)) for x in quotas(sizes, wanted, floor))), F.coalesce("goal", F.lit(0)) + 1)
        moved = now.join(wish.select("hub", "shard", "goal"), ["hub", "shard"], "left")
        moved = moved.select("row", "hub", F.when(F.col("goal").isNotNull() & (uniform("row", F.lit(k)) < enter), F.col("goal")).otherwise(F.col("shard")).alias("shard"))
        before, now = now, save(moved)
        forget(before, seen, wish)

    placed = running_total(now.withColumn("one", F.lit(1)), "shard", ["hub", "row"], "one", "rank")
    wanted_rows = F.lit(floor) + (F.col("shard") < more).cast("int")
    placed = save(placed.select("row", "shard", (F.col("rank") < wanted_rows).alias("stays")))
    held = {r["shard"]: r["n"] for r in placed.filter("stays").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = np.cumsum([floor + (s < more) - held.get(s, 0) for s in range(shards)])
    joined = rows.join(placed, "row", "left")
    fixed = joined.filter("stays").drop("stays")
    pool = joined.filter("stays is null or not stays").drop("stays", "shard")
    pool = running_total(pool.withColumn("group", F.when(F.col("linked") > 1, F.col("hub")).otherwise("~")), "all", ["group", "row"], "one", "rank")
    shard = F.size(F.filter(F.array(*(F.lit(int(x)) for x in free)), lambda x: x <= F.col("rank")))
    columns = ["row", "doc_id", "size", "text_crc32", "linked", "shard"]
    every = fixed.select(*columns).union(pool.withColumn("shard", shard.cast("int")).select(*columns)).withColumn("one", F.lit(1))
    out = running_total(every, "shard", ["doc_id", "row"], "one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("linked").cast("long").alias("linked"))
