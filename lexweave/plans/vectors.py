"""Vector queries over ``embeddings``; a word is a vec_id, the two models are the halves of the vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as A
from ..operators import vectors as O
from ..registry import query, table

VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings), l AS (SELECT vec_id, x, label, sqrt(list_dot_product(x, x)) AS norm FROM v)"
MODELS = VEC + ", m AS (SELECT 'a' AS model, vec_id, x[1:32] AS x FROM v UNION ALL SELECT 'b', vec_id, x[33:64] FROM v)"
COS = "list_dot_product(a.x, b.x) / ((sqrt(list_dot_product(a.x, a.x)) + 1e-8) * (sqrt(list_dot_product(b.x, b.x)) + 1e-8))"
KNN = f"k AS (SELECT a.model, a.vec_id AS query, b.vec_id, {COS} AS score, row_number() OVER (PARTITION BY a.model, a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM m a JOIN m b ON a.model = b.model AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5)"


def vectors(spark, sf_dir):
    return O.as_double(table(spark, sf_dir, "embeddings"))


def half(df, model):
    return df.select("vec_id", F.slice("vector", 1 if model == "a" else 33, 32).alias("vector"))


def probes(df):
    """Every row whose id is divisible by 100."""
    return df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "vector", F.array("vec_id").alias("exclude"))


@query("vector_norms", f"WITH {VEC} SELECT vec_id, round(norm + 1e-8, 6) AS norm, round(x[1] / (norm + 1e-8), 6) AS first FROM l")
def vector_norms(spark, sf_dir):
    n = A.norm(F.col("vector")) + 1e-8
    return vectors(spark, sf_dir).select("vec_id", F.round(n, 6).alias("norm"), F.round(F.col("vector")[0] / n, 6).alias("first"))


@query("cosine_pairs", f"WITH {VEC} SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 4) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a, b = v.select(F.col("vec_id").alias("a"), F.col("vector").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("vector").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(A.cosine(F.col("x"), F.col("y")), 4).alias("cosine"))


@query("knn_topk", f"WITH {VEC}, m AS (SELECT 'w' AS model, vec_id, x FROM v), {KNN} SELECT query, rank::INT AS rank, vec_id, round(score, 4) AS score FROM k")
def knn_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return O.nearest(v, probes(v)).withColumn("score", F.round("score", 4))


def _analogy_sql(unit: bool) -> str:
    of = "list_transform(x, lambda e: e / norm)" if unit else "x"
    return f"""WITH {VEC}, q AS (SELECT p.vec_id AS query, list_transform(range(1, 65), lambda i: ps[i] + qs[i] - rs[i]) AS x FROM
(SELECT vec_id, {of} AS ps FROM l WHERE vec_id % 100 = 0) p JOIN (SELECT vec_id, {of} AS qs FROM l) q ON q.vec_id = p.vec_id + 1 JOIN (SELECT vec_id, {of} AS rs FROM l) r ON r.vec_id = p.vec_id + 2)
SELECT a.query, row_number() OVER (PARTITION BY a.query ORDER BY {COS} DESC, b.vec_id)::INT AS rank, b.vec_id, round({COS}, 4) AS score FROM q a JOIN v b ON b.vec_id NOT BETWEEN a.query AND a.query + 2 QUALIFY rank <= 5"""


def asked(df):
    i = F.col("vec_id")
    return df.filter("vec_id % 100 = 0").select(i.alias("query"), F.array(i, i + 1).alias("positive"), F.array(i + 2).alias("negative"))


def _analogy(spark, sf_dir, unit):
    v = vectors(spark, sf_dir)
    return O.nearest(v, O.analogies(v, asked(v), unit)).withColumn("score", F.round("score", 4))


query("analogy_raw", _analogy_sql(False))(lambda spark, sf_dir: _analogy(spark, sf_dir, False))
query("analogy_unit", _analogy_sql(True))(lambda spark, sf_dir: _analogy(spark, sf_dir, True))


@query("analogy_hits", f"SELECT count(*) FILTER (WHERE e.label = p.label) AS hits, count(*) AS asked FROM ({_analogy_sql(False)}) t JOIN embeddings e ON e.vec_id = t.vec_id JOIN embeddings p ON p.vec_id = t.query WHERE rank = 1")
def analogy_hits(spark, sf_dir):
    v = vectors(spark, sf_dir)
    top = O.nearest(v, O.analogies(v, asked(v), False), 1)
    expected = v.select(F.col("vec_id").alias("query"), F.col("label").alias("expected"))
    return top.join(v.select("vec_id", "label"), "vec_id").join(expected, "query").agg(F.count_if(F.col("label") == F.col("expected")).alias("hits"), F.count("*").alias("asked"))


WORDS = [("one", [0, 1, 10**9]), ("two", [2, 3]), ("three", [-5, -6])]
WORDS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::BIGINT[])" for a, b in WORDS) + ") w(label, ids))"


@query("analogy_missing", f"WITH w AS (SELECT label, unnest(ids) AS id FROM {WORDS_SQL}) SELECT label, id FROM w WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def analogy_missing(spark, sf_dir):
    w = spark.createDataFrame(WORDS, "label string, ids array<long>").select("label", F.explode("ids").alias("id"))
    return w.join(vectors(spark, sf_dir).select(F.col("vec_id").alias("id")), "id", "left_anti").select("label", "id")


@query("group_coverage", f"WITH w AS (SELECT label, unnest(ids) AS id FROM {WORDS_SQL}) SELECT w.label AS grp, count(e.vec_id) AS found, count(*) AS asked FROM w LEFT JOIN embeddings e ON e.vec_id = id GROUP BY w.label")
def group_coverage(spark, sf_dir):
    w = spark.createDataFrame(WORDS, "grp string, ids array<long>").select("grp", F.explode("ids").alias("id"))
    return w.join(vectors(spark, sf_dir).select("vec_id"), F.col("id") == F.col("vec_id"), "left").groupBy("grp").agg(F.count("vec_id").alias("found"), F.count("*").alias("asked"))


PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7), (8, 10**9)]


@query("probe_similarity", f"WITH {VEC} SELECT coalesce(round(avg({COS}), 4), 0.0) AS similarity FROM (VALUES {', '.join(map(str, PAIRS))}) p(i, j) JOIN v a ON a.vec_id = i JOIN v b ON b.vec_id = j")
def probe_similarity(spark, sf_dir):
    v, p = vectors(spark, sf_dir), spark.createDataFrame(PAIRS, "i long, j long")
    both = p.join(v.select(F.col("vec_id").alias("i"), F.col("vector").alias("x")), "i").join(v.select(F.col("vec_id").alias("j"), F.col("vector").alias("y")), "j")
    return both.agg(F.coalesce(F.round(F.avg(A.cosine(F.col("x"), F.col("y"))), 4), F.lit(0.0)).alias("similarity"))


def both_models(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return [O.nearest(half(v, m), probes(half(v, m))).select("query", "vec_id", F.lit(m).alias("model")) for m in "ab"]


@query("nn_common", f"WITH {MODELS}, {KNN} SELECT query, vec_id FROM k GROUP BY query, vec_id HAVING count(DISTINCT model) = 2")
def nn_common(spark, sf_dir):
    a, b = both_models(spark, sf_dir)
    return a.select("query", "vec_id").intersect(b.select("query", "vec_id"))


@query("nn_agreement", f"WITH {MODELS}, {KNN}, c AS (SELECT query, vec_id FROM k GROUP BY query, vec_id HAVING count(DISTINCT model) = 2) SELECT query, count(c.vec_id) / 5.0::DOUBLE AS agreement FROM (SELECT vec_id AS query FROM v WHERE vec_id % 100 = 0) LEFT JOIN c USING (query) GROUP BY query")
def nn_agreement(spark, sf_dir):
    a, b = both_models(spark, sf_dir)
    common = a.union(b).groupBy("query", "vec_id").agg(F.count("*").alias("models")).filter("models = 2")
    every = probes(vectors(spark, sf_dir)).select("query")
    return every.join(common, "query", "left").groupBy("query").agg((F.count("vec_id") / 5.0).alias("agreement"))


@query("common_vocab", "SELECT vec_id FROM embeddings WHERE label <> 0 INTERSECT SELECT vec_id FROM embeddings WHERE label <> 1 INTERSECT SELECT vec_id FROM embeddings")
def common_vocab(spark, sf_dir):
    v = vectors(spark, sf_dir)
    models = [v.filter("label <> 0"), v.filter("label <> 1"), v]
    every = [m.select("vec_id", F.lit(k).alias("model")) for k, m in enumerate(models)]
    return every[0].union(every[1]).union(every[2]).groupBy("vec_id").agg(F.countDistinct("model").alias("n")).filter(F.col("n") == len(models)).select("vec_id")


@query("cka_matrix", f"""WITH {VEC}, e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i FROM v), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM e),
g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s, count(*) AS n FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i), f AS (SELECT i // 16 AS p, j // 16 AS q, sum(s * s) AS f2, max(n) AS n FROM g GROUP BY ALL)
SELECT 'm' || f.p AS model_a, 'm' || f.q AS model_b, f.n, round(f.f2 / (sqrt(a.f2) * sqrt(b.f2) + 1e-8), 6) AS cka FROM f JOIN f a ON a.p = f.p AND a.q = f.p JOIN f b ON b.p = f.q AND b.q = f.q WHERE f.p < f.q""")
def cka_matrix(spark, sf_dir):
    return O.cka(vectors(spark, sf_dir), [(f"m{k}", 16 * k, 16 * k + 16) for k in range(4)]).withColumn("cka", F.round("cka", 6))


UNIT = "u AS (SELECT model, vec_id, list_transform(x, lambda e: e / norm) AS x FROM (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM m) h)"
ASKED = """q AS (SELECT model, query, list_transform(range(1, 33), lambda i: ps[i] + qs[i] - rs[i]) AS x FROM (SELECT model, vec_id AS query, x AS ps FROM u WHERE vec_id % 100 = 0) p
JOIN (SELECT model, vec_id - 1 AS query, x AS qs FROM u) USING (model, query) JOIN (SELECT model, vec_id - 2 AS query, x AS rs FROM u) USING (model, query))"""
ANSWERED = f"z AS (SELECT a.model, a.query, b.vec_id, {COS} AS score, row_number() OVER (PARTITION BY a.model, a.query ORDER BY {COS} DESC, b.vec_id) AS rank FROM q a JOIN m b ON b.model = a.model AND b.vec_id NOT BETWEEN a.query AND a.query + 2 QUALIFY rank <= 5)"


@query("semantic_report", f"""WITH {MODELS}, {KNN}, {UNIT}, {ASKED}, {ANSWERED}
SELECT model, 'neighbours' AS kind, query, rank::INT AS rank, vec_id, round(score, 4) AS score FROM k
UNION ALL SELECT model, 'analogy', query, rank::INT, vec_id, round(score, 4) FROM z""")
def semantic_report(spark, sf_dir):
    v = vectors(spark, sf_dir)
    parts = [O.nearest(half(v, m), probes(half(v, m))).select(F.lit(m).alias("model"), F.lit("neighbours").alias("kind"), "query", "rank", "vec_id", F.round("score", 4).alias("score")) for m in "ab"]
    parts += [O.nearest(half(v, m), O.analogies(half(v, m), asked(v), True)).select(F.lit(m).alias("model"), F.lit("analogy").alias("kind"), "query", "rank", "vec_id", F.round("score", 4).alias("score")) for m in "ab"]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("pca_2d")
def pca_2d(spark, sf_dir):
    return O.pca(vectors(spark, sf_dir))


GROUPED = 10


@query("tsne_2d")
def tsne_2d(spark, sf_dir):
    """Ten neighbours of each probe and the probe itself: one small group per probe."""
    v = vectors(spark, sf_dir)
    near = O.nearest(v, probes(v), GROUPED).select(F.col("query").cast("int").alias("grp"), "vec_id")
    points = near.union(probes(v).select(F.col("query").cast("int"), "query")).join(v.select("vec_id", "vector"), "vec_id")
    return O.tsne(points.select("grp", "vec_id", "vector"))
