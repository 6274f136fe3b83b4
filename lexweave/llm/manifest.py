"""Merkle manifest of a table of documents: a tree for each source, and one over the sources.

Spark numbers the rows and cuts every tree into aligned blocks of 16**3 nodes;
an executor hands a block to DuckDB as an Arrow table, where each level is one
``sha256(string_agg(... ORDER BY pos))``.  Spark combines the roots of blocks by the
same step until one node is left, then goes down again: the siblings on the
way from a block's root to the table's root, its outer proof, are joined to the
block, and DuckDB finishes the proofs of its leaves.  Texts never travel; a
leaf's digest does.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered, ordered, part
from .common import forget, save, tuned

FAN = 16
#: Levels inside a block.
STEPS = 3
BLOCK = FAN**STEPS


@functools.cache
def _engine():
    """One in-memory DuckDB of each Python worker, on one thread, without files."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})


def _run(sql: str, **tables: pa.Table) -> pa.Table:
    con = _engine()
    for name, t in tables.items():
        con.register(name, t)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


def _levels(of: str) -> str:
    """CTEs n0..n3 (nodes of each level) and r0..r2 (the digests of each run end to end) of the blocks in ``of`` (tree, pos, h, climb)."""
    out = [f"n0 AS (SELECT tree, pos, h, climb FROM {of})"]
    for k in range(STEPS):
        out.append(f"r{k} AS MATERIALIZED (SELECT tree, pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS run, any_value(climb) AS climb FROM n{k} GROUP BY tree, pos // {FAN})")
        out.append(f"n{k + 1} AS (SELECT tree, pos, CASE WHEN climb > {k} THEN sha256(run) ELSE run END AS h, climb FROM r{k})")
    return ", ".join(out)


_ROOTS = f"WITH {_levels('nodes')} SELECT tree, pos, h FROM n{STEPS}"


def _sides() -> tuple[str, str]:
    """Joins of a node ``x`` to its runs, and the select list l0, g0, .. of what stands left and right of it on each level, empty above its tree."""
    joins = " ".join(f"JOIN r{k} ON r{k}.tree = x.tree AND r{k}.pos = x.pos // {FAN ** (k + 1)}" for k in range(STEPS))
    at = [f"64 * (x.pos // {FAN ** k} % {FAN})" for k in range(STEPS)]
    own = ", ".join(f"CASE WHEN x.climb > {k} THEN substr(r{k}.run, 1, {a}) ELSE '' END AS l{k}, CASE WHEN x.climb > {k} THEN substr(r{k}.run, {a} + 65) ELSE '' END AS g{k}" for k, a in enumerate(at))
    return joins, own


def _roots(block: pa.Table) -> pa.Table:
    return _run(_ROOTS, nodes=block.select(["tree", "pos", "h", "climb"]))


def _paths(block: pa.Table, above: pa.Table) -> pa.Table:
    """Left and right siblings of each node on its way to the table's root, bottom up."""
    joins, own = _sides()
    lists = [f"list_concat([{', '.join(f'{c}{k}' for k in range(STEPS))}][1:climb], a.{side})" for c, side in (("l", "lefts"), ("g", "rights"))]
    sql = f"""WITH {_levels("nodes")}, s AS (SELECT x.tree, x.pos, x.climb, {own} FROM nodes x {joins})
SELECT s.tree, s.pos, {lists[0]} AS lefts, {lists[1]} AS rights FROM s JOIN above a ON a.tree = s.tree AND a.pos = s.pos // {BLOCK}"""
    return _run(sql, nodes=block.select(["tree", "pos", "h", "climb"]), above=above)


def _proofs(block: pa.Table, above: pa.Table) -> pa.Table:
    """Digest of each leaf's whole proof, and the root folded from the leaf that is claimed."""
    joins, own = _sides()
    deep = max((len(x) for x in above["lefts"].to_pylist()), default=0)
    steps = [f"f0 AS (SELECT tree, doc_id, leaf, claim AS acc, climb, {', '.join(f'l{k}, g{k}' for k in range(STEPS))}, pos // {BLOCK} AS up FROM s)"]
    for k in range(STEPS):
        steps.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN climb > {k} THEN sha256(l{k} || acc || g{k}) ELSE acc END AS acc) FROM f{k})")
    inner = " || ".join(f"l{k} || g{k}" for k in range(STEPS))
    steps.append(f"h0 AS (SELECT f.tree, doc_id, leaf, acc, sha256({inner} || a.outer_proof) AS proof_sha256, a.subroot, a.lefts, a.rights FROM f{STEPS} f JOIN above a ON a.tree = f.tree AND a.pos = f.up)")
    for k in range(deep):
        steps.append(f"h{k + 1} AS (SELECT * REPLACE (CASE WHEN len(lefts) > {k} THEN sha256(lefts[{k + 1}] || acc || rights[{k + 1}]) ELSE acc END AS acc) FROM h{k})")
    sql = f"""WITH {_levels("nodes")}, s AS (SELECT x.tree, x.pos, x.climb, x.doc_id, x.h AS leaf, x.claim, {own} FROM nodes x {joins}), {', '.join(steps)}
SELECT doc_id, leaf, subroot, proof_sha256, acc AS folded_root FROM h{deep}"""
    return _run(sql, nodes=block, above=above)


def _packed(nodes: DataFrame, total: int) -> DataFrame:
    """``nodes`` (tree, pos, n, ..) with climb, the levels of its tree inside this block, and the pack it is worked on in.

    A tree of more than a block has a pack for each block; smaller trees share
    packs of about a block, so that a million tiny sources are no million tasks.
    """
    climb = sum((F.when(F.col("n") > FAN**k, 1).otherwise(0) for k in range(STEPS)), F.lit(0))
    large = F.col("n") > BLOCK
    shared = F.pmod(F.xxhash64("tree"), F.lit(max(1, total // BLOCK)))
    return nodes.withColumns({"climb": climb, "p1": F.when(large, F.col("tree")).otherwise(-1), "p2": F.when(large, F.floor(F.col("pos") / BLOCK)).otherwise(shared)})


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Every pass of ``nodes`` (tree, pos, h, n) up to one node per tree: what each pass worked on, and the roots (tree, h)."""
    passes, roots = [], []
    while True:
        passes.append(packed := save(_packed(nodes, nodes.count())))
        found = packed.groupBy("p1", "p2").applyInArrow(_roots, "tree long, pos long, h string")
        trees = packed.groupBy("tree").agg(F.floor((F.max("n") + BLOCK - 1) / BLOCK).cast("long").alias("n"))
        up = save(found.join(trees, "tree"))
        roots.append(up.filter("n = 1").select("tree", "h"))
        nodes = up.filter("n > 1")
        if not nodes.head(1):
            return passes, functools.reduce(DataFrame.union, roots)


def _above(paths: DataFrame, packed: DataFrame) -> DataFrame:
    """Parents' rows with the pack of the block below them."""
    packs = packed.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("pos")).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    return save(paths.join(packs, ["tree", "pos"]))


def _descend(passes: list[DataFrame], top: DataFrame, down_to: int = 0) -> DataFrame:
    """(tree, pos, lefts, rights) of the nodes of pass ``down_to``, given those of each tree's root, ``top`` (tree, lefts, rights).

    A tree that ended in an earlier pass has its root among the parents of that pass.
    """
    paths = None
    for k in range(len(passes) - 1, down_to - 1, -1):
        ended = passes[k].filter(F.col("n") <= BLOCK).select("tree").distinct().join(top, "tree").withColumn("pos", F.lit(0).cast("long")).select("tree", "pos", "lefts", "rights")
        above = _above(ended if paths is None else ended.union(paths), passes[k])
        paths = save(passes[k].groupBy("p1", "p2").cogroup(above.groupBy("p1", "p2")).applyInArrow(_paths_of, "tree long, pos long, lefts array<string>, rights array<string>"))
    return paths


def _paths_of(block: pa.Table, above: pa.Table) -> pa.Table:
    return _paths(block, above.select(["tree", "pos", "lefts", "rights"]))


def _proofs_of(block: pa.Table, above: pa.Table) -> pa.Table:
    return _proofs(block.select(["tree", "pos", "h", "climb", "doc_id", "claim"]), above.select(["tree", "pos", "lefts", "rights", "outer_proof", "subroot"]))


def _encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(docs: DataFrame, text: Column) -> Column:
    return F.sha2(F.concat(*[_encoded(docs[c]) for c in ("doc_id", "source", "lang", "n_chars")], _encoded(text)), 256)


def dataset_manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    A leaf is the sha256 of doc_id, source, lang, n_chars and text, each ``-`` if null, else
    its UTF-8 bytes' count, a colon and the value.  Leaves of a source stand in the
    order of doc_id (null first; repeated ids by leaf); runs of 16 become their
    sha256 until one node is left, the subroot; subroots in the order of source
    (null first, bytewise) likewise give the root.  proof_sha256 is the sha256 of all siblings
    on the way up.  folded_root starts from a leaf with lower-cased text where 5
    divides crc32 of doc_id (null: never) and from the true leaf elsewhere; verified says whether
    it is the root.  Equal rows are leaves of their own.  Long texts are hashed where
    they are read.  Other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    spark = documents.sparkSession
    tuned(spark)
    names = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    touched = F.crc32(documents["doc_id"].cast("string")) % 5 == 0
    leaf = _leaf(documents, documents["text"])
    claim = F.when(touched, _leaf(documents, F.translate(documents["text"], upper, lower))).otherwise(leaf)
    leaves = documents.select(documents["source"].alias("source"), documents["doc_id"].cast("long").alias("doc_id"), leaf.alias("h"), claim.alias("claim"))
    keys = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "h"]
    rows = ordered(leaves, *keys).withColumn("part", part())
    if not rows.head(1):
        return spark.createDataFrame([], names)

    # Positions: one row per task and source carries what stands before it.
    each = save(rows.groupBy("part", "source").agg(F.count("*").alias("rows"), F.min("_id").alias("first")))
    sources = save(numbered(each.groupBy("source").agg(F.sum("rows").alias("n")), F.col("source").asc_nulls_first(), name="tree"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s, e = sources.alias("s"), each.alias("e")
    placed = e.join(s, F.col("e.source").eqNullSafe(F.col("s.source"))).select("tree", "n", "part", "first", "rows", F.col("e.source").alias("source")).withColumn("before", before)
    placed = save(placed.select("part", "source", "tree", "n", (F.col("before") - F.col("first")).alias("shift")))
    inside = (F.col("r.part") == F.col("p.part")) & F.col("r.source").eqNullSafe(F.col("p.source"))
    nodes = save(rows.alias("r").join(placed.alias("p"), inside).select("p.tree", (F.col("r._id") + F.col("p.shift")).alias("pos"), "r.h", "p.n", "r.doc_id", "r.claim"))
    forget(each)

    passes, subroots = _climb(nodes)
    subroots = save(subroots)
    total = subroots.count()
    outer, roots = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "h", F.lit(total).cast("long").alias("n")))
    root = roots.first()["h"]
    none = F.array().cast("array<string>")
    tops = _descend(outer, spark.range(1).select(F.col("id").alias("tree"), none.alias("lefts"), none.alias("rights")))
    top = tops.select(F.col("pos").alias("tree"), "lefts", "rights").join(subroots.withColumnRenamed("h", "subroot"), "tree")
    top = save(top)

    inner = _descend(passes, top.drop("subroot"), 1)
    ended = passes[0].filter(F.col("n") <= BLOCK).select("tree").distinct().join(top, "tree").select("tree", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot")
    above = ended if inner is None else ended.union(inner.join(top.select("tree", "subroot"), "tree").select("tree", "pos", "lefts", "rights", "subroot"))
    above = _above(above.withColumn("outer_proof", F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")), passes[0])
    out = passes[0].groupBy("p1", "p2").cogroup(above.groupBy("p1", "p2")).applyInArrow(_proofs_of, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
