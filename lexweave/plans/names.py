"""Name queries: even part keys are the training names, odd ones stand for generated names."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import vectors as A
from ..operators import names as N
from ..operators import vocabulary as V
from ..registry import query, table
from ..storage import save

NAMES = "n AS (SELECT p_partkey AS id, lower(trim(p_name)) AS name FROM part WHERE trim(p_name) <> '')"
CHARS = NAMES + ", c AS (SELECT DISTINCT unnest(string_split(name, '')) AS ch FROM n), v AS (SELECT ch, (row_number() OVER (ORDER BY ch) + 2)::INT AS idx FROM c)"
SEQS = CHARS + ", p AS (SELECT id, unnest(string_split(name, '')) AS ch, generate_subscripts(string_split(name, ''), 1) AS pos FROM n), s AS (SELECT id, list_concat(list_concat([1], list(idx ORDER BY pos)), [2]) AS seq FROM p JOIN v USING (ch) GROUP BY id)"


def names(spark, sf_dir):
    return N.load(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "name")


def sequences(spark, sf_dir):
    n = names(spark, sf_dir)
    return N.encoded(n, N.char_vocab(n, "name"), "name", "id")


@query("names_load", f"WITH {NAMES} SELECT id, name FROM n")
def names_load(spark, sf_dir):
    return names(spark, sf_dir)


@query("char_vocab", f"WITH {CHARS} SELECT ch, idx FROM v")
def char_vocab(spark, sf_dir):
    return N.char_vocab(names(spark, sf_dir), "name")


@query("encode_names", f"WITH {SEQS} SELECT id, seq FROM s")
def encode_names(spark, sf_dir):
    return sequences(spark, sf_dir)


@query("decode_names", f"WITH {NAMES} SELECT id, name FROM n")
def decode_names(spark, sf_dir):
    return N.decoded(sequences(spark, sf_dir), N.char_vocab(names(spark, sf_dir), "name"), "id")


@query("pad_sequences", f"WITH {SEQS} SELECT id, list_concat(seq, list_transform(range(len(seq), (SELECT max(len(seq)) FROM s)), lambda i: 0)) AS seq FROM s")
def pad_sequences(spark, sf_dir):
    return N.padded(sequences(spark, sf_dir), "id")


@query("shifted_pairs", f"WITH {SEQS} SELECT id, seq[1:len(seq) - 1] AS given, seq[2:] AS wanted FROM s")
def shifted_pairs(spark, sf_dir):
    n = F.size("seq")
    return sequences(spark, sf_dir).select("id", F.slice("seq", F.lit(1), n - 1).alias("given"), F.slice("seq", F.lit(2), n - 1).alias("wanted"))


@query("one_hot", f"WITH {CHARS} SELECT ch, list_transform(range(0, (SELECT max(idx) + 1 FROM v)), lambda i: (i = idx)::INT) AS hot FROM v")
def one_hot(spark, sf_dir):
    v = N.char_vocab(names(spark, sf_dir), "name")
    size = v.agg((F.max("idx") + 1).alias("size"))
    return v.crossJoin(F.broadcast(size)).select("ch", N.one_hot(F.col("idx"), F.col("size")).alias("hot"))


@query("embedding_lookup", f"WITH {CHARS}, p AS (SELECT id, unnest(string_split(name, '')) AS ch, generate_subscripts(string_split(name, ''), 1)::INT - 1 AS pos FROM n) SELECT id, pos, idx, round(sqrt(idx), 6) AS weight FROM p JOIN v USING (ch)")
def embedding_lookup(spark, sf_dir):
    n = names(spark, sf_dir)
    weights = N.char_vocab(n, "name").withColumn("weight", F.round(F.sqrt("idx"), 6))
    return n.select("id", F.posexplode(N.characters(F.col("name"))).alias("pos", "ch")).join(F.broadcast(weights), "ch").select("id", "pos", "idx", "weight")


@query("train_val_split", f"WITH {NAMES} SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(id::VARCHAR), id) <= floor((SELECT count(*) FROM n) * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM n")
def train_val_split(spark, sf_dir):
    return N.split(names(spark, sf_dir), "id")


def halves(spark, sf_dir):
    n = names(spark, sf_dir)
    return n.filter("id % 2 = 0"), n.filter("id % 2 = 1")


@query("novelty", f"WITH {NAMES} SELECT coalesce(100.0::DOUBLE * count(*) FILTER (WHERE lower(name) NOT IN (SELECT lower(name) FROM n WHERE id % 2 = 0)) / nullif(count(*), 0), 0.0) AS novelty FROM n WHERE id % 2 = 1")
def novelty(spark, sf_dir):
    training, generated = halves(spark, sf_dir)
    return N.novelty(generated, training, "name")


@query("diversity", f"WITH {NAMES} SELECT 100.0::DOUBLE * count(DISTINCT name) / count(*) AS diversity FROM n WHERE id % 2 = 1")
def diversity(spark, sf_dir):
    return N.diversity(halves(spark, sf_dir)[1], "name")


ODD_NAMES = ["aaab", "   x", "kk11", "ab", "xyz abc", "a very long name of many letters", "éééa b", "111 a", ""]
ODD_SQL = "(VALUES " + ", ".join(f"('{x}')" for x in ODD_NAMES) + ") o(name)"


@query("failure_modes", f"""WITH a AS (SELECT p_name AS name FROM part UNION ALL SELECT name FROM {ODD_SQL})
SELECT count(*) FILTER (WHERE length(name) < 3) AS too_short, count(*) FILTER (WHERE length(name) > 25) AS too_long, count(*) FILTER (WHERE NOT contains(name, ' ')) AS no_space,
count(*) FILTER (WHERE len(list_filter(range(1, length(name) - 1), lambda i: substr(name, i, 1) = substr(name, i + 1, 1) AND substr(name, i, 1) = substr(name, i + 2, 1) AND regexp_matches(substr(name, i, 1), '\\p{{L}}'))) > 0) AS repeated, avg(length(name)) AS mean_length FROM a""")
def failure_modes(spark, sf_dir):
    extra = spark.createDataFrame([(x,) for x in ODD_NAMES], "p_name string")
    return N.failures(table(spark, sf_dir, "part").select("p_name").union(extra), "p_name")


@query("length_histogram", f"WITH {NAMES} SELECT length(name)::INT AS length, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS density FROM n GROUP BY length(name)")
def length_histogram(spark, sf_dir):
    return N.lengths(names(spark, sf_dir), "name")


#: Each vector of ``embeddings`` as the logits, states, weights, gradients or losses of a network.
EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, abs(coalesce(label, 0)) % 10 AS y FROM embeddings)"
SOFT = "list_transform(x[1:10], lambda e: exp(e - list_max(x[1:10])) / list_sum(list_transform(x[1:10], lambda f: exp(f - list_max(x[1:10])))))"


def numbers(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.abs(F.coalesce("label", F.lit(0))) % 10).alias("y"))


def rounded(a, digits=9):
    return F.transform(a, lambda e: F.round(e, digits))


@query("softmax", f"WITH {EMB} SELECT id, list_transform({SOFT}, lambda e: round(e, 9)) AS p FROM e")
def softmax(spark, sf_dir):
    """Ten components of each vector as logits."""
    return numbers(spark, sf_dir).select("id", rounded(A.softmax(F.slice("x", 1, 10))).alias("p"))


@query("cross_entropy", f"WITH {EMB} SELECT y, count(*) AS n, round(avg(-ln(({SOFT})[y + 1] + 1e-12)), 9) AS loss FROM e GROUP BY y")
def cross_entropy(spark, sf_dir):
    """Mean loss of each class, the label, under the softmax of ten components."""
    loss = -F.log(F.get(A.softmax(F.slice("x", 1, 10)), F.col("y")) + 1e-12)
    return numbers(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg(loss), 9).alias("loss"))


@query("clip_by_norm", f"WITH {EMB} SELECT id, list_transform(x, lambda g: round(g * least(1.0, 5.0 / (sqrt(list_dot_product(x, x)) + 1e-12)), 9)) AS x FROM (SELECT id, list_transform(x, lambda g: g * 3 * (1 + id % 4)) AS x FROM e)")
def clip_by_norm(spark, sf_dir):
    """Each vector, three to twelve times as long, as a gradient that is clipped at norm five."""
    return numbers(spark, sf_dir).select("id", rounded(A.clipped(A.scaled(F.col("x"), 3 * (1 + F.col("id") % 4)), 5.0)).alias("x"))


@query("sigmoid", f"WITH {EMB} SELECT id, list_transform(x, lambda e: round(1 / (1 + exp(-20 * e)), 9)) AS s FROM e")
def sigmoid(spark, sf_dir):
    return numbers(spark, sf_dir).select("id", F.transform("x", lambda e: F.round(A.sigmoid(20 * e), 9)).alias("s"))


#: Weights of the small networks below: four units, by formula.
UNITS = 4
MATRICES = [[[round(math.sin(9 * m + 4 * i + j + 1) / 2, 3) for j in range(UNITS)] for i in range(UNITS)] for m in range(6)]
BIAS = [0.1, -0.2, 0.05, 0.0]


def _m(x: str, matrix, j: str) -> str:
    """Column ``j`` of row vector ``x`` times a literal matrix."""
    return "(" + " + ".join(f"({x})[{i + 1}] * {[float(v) for v in matrix[i]]}[{j}]" for i in range(UNITS)) + ")"


STATES = "list_transform(range(0, 16), lambda k: x[4 * k + 1:4 * k + 4])"


@query("attention_pool", f"""WITH {EMB}, s AS (SELECT id, {STATES} AS hs FROM e),
c AS (SELECT id, hs, list_transform(hs[1:15], lambda h: list_sum(list_transform(range(1, 5), lambda j: {BIAS}[j] * tanh({_m('h', MATRICES[0], 'j')} + {_m('hs[16]', MATRICES[1], 'j')})))) AS score FROM s),
w AS (SELECT id, hs, list_transform(score, lambda v: exp(v - list_max(score))) AS w FROM c)
SELECT id, list_transform(range(1, 5), lambda j: round(list_sum(list_transform(range(1, 16), lambda k: w[k] * hs[k][j])) / list_sum(w), 9)) AS pooled FROM w""")
def attention_pool(spark, sf_dir):
    """Each vector as 16 states of four units: additive attention of the last over the earlier ones."""
    hs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("x", 4 * k + 1, 4))
    pooled = A.let(hs, lambda every: A.attention(F.slice(every, 1, 15), F.element_at(every, 16), A.matrix(MATRICES[0]), A.matrix(MATRICES[1]), A.row(BIAS)))
    return numbers(spark, sf_dir).select("id", rounded(pooled).alias("pooled"))


@query("adam_step", f"""WITH {EMB}, g AS (SELECT id, x[1:32] AS w, list_transform(x[33:64], lambda e: 9 * e) AS g, list_transform(x[1:32], lambda e: e / 10) AS m, list_transform(x[33:64], lambda e: e * e) AS v, 1 + id % 7 AS t FROM e),
c AS (SELECT *, list_transform(g, lambda e: e * least(1.0, 5.0 / (sqrt(list_dot_product(g, g)) + 1e-12))) AS k FROM g)
SELECT id, list_transform(range(1, len(w) + 1), lambda i: round(w[i] - 0.003 * ((0.9 * m[i] + 0.1 * k[i]) / (1 - 0.9 ** t)) / (sqrt((0.999 * v[i] + 0.001 * k[i] * k[i]) / (1 - 0.999 ** t)) + 1e-8), 9)) AS w FROM c""")
def adam_step(spark, sf_dir):
    """The first half of each vector as weights, nine times the second as their gradient, clipped; moments and step number follow from them."""
    low, high = F.slice("x", 1, 32), F.slice("x", 33, 32)
    rows = numbers(spark, sf_dir).select("id", low.alias("w"), A.clipped(A.scaled(high, F.lit(9.0)), 5.0).alias("g"), A.scaled(low, F.lit(0.1)).alias("m"), F.transform(high, lambda e: e * e).alias("v"), (1 + F.col("id") % 7).alias("t"))
    return rows.select("id", rounded(A.adam("w", "g", "m", "v", F.col("t"), 0.003)).alias("w"))


@query("sgns_step", f"""WITH {EMB}, s AS (SELECT a.id, a.x AS w, b.x AS g, (a.y = b.y)::INT AS t, 1 / (1 + exp(-list_dot_product(a.x, b.x))) AS p FROM e a JOIN e b ON b.id = a.id + 1)
SELECT id, t, list_transform(range(1, len(w) + 1), lambda i: round(w[i] - 0.01 * (p - t) * g[i], 9)) AS w, round(t * -ln(p + 1e-12) + (1 - t) * -ln(1 - p + 1e-12), 9) AS loss FROM s""")
def sgns_step(spark, sf_dir):
    """One update of each vector, as an input, against the next one as an output; they go together if their labels agree."""
    rows, next_ = numbers(spark, sf_dir), numbers(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("x").alias("g"), F.col("y").alias("z"))
    rows = rows.join(next_, "id").select("id", F.col("x").alias("w"), "g", (F.col("y") == F.col("z")).cast("int").alias("t")).withColumn("p", A.sigmoid(A.dot(F.col("w"), F.col("g"))))
    moved = F.zip_with("w", "g", lambda a, b: F.round(a - 0.01 * (F.col("p") - F.col("t")) * b, 9))
    return rows.select("id", "t", moved.alias("w"), F.round(F.col("t") * -F.log(F.col("p") + 1e-12) + (1 - F.col("t")) * -F.log(1 - F.col("p") + 1e-12), 9).alias("loss"))


SHAPES = [("vanilla", 32, 128), ("vanilla", 16, 64), ("blstm", 32, 64), ("attention", 32, 128)]


@query("param_counts", f"""WITH {CHARS}, k AS (SELECT (count(*) + 3)::INT AS v FROM v) SELECT model, v, e, h, (v * e + CASE model
  WHEN 'blstm' THEN 3 * (4 * h * (e + h + 1) + 2 * 4 * h * (2 * h + 1)) + (2 * h + 1) * v + (h + 1) * v
  WHEN 'attention' THEN h * (e + h + 1) + 2 * h * (2 * h + 1) + 2 * h * h + h + (2 * h + 1) * v
  ELSE h * (e + h + 1) + 2 * h * (2 * h + 1) + (h + 1) * v END)::BIGINT AS parameters FROM k, (VALUES """ + ", ".join(map(str, SHAPES)) + ") s(model, e, h)")
def param_counts(spark, sf_dir):
    """Sizes of the networks as they are built for the alphabet of the names."""
    from ..operators.recurrent import Network

    v = N.char_vocab(names(spark, sf_dir), "name").count() + 3
    rows = [(m, v, e, h, Network(m, v, e, h).size()) for m, e, h in SHAPES]
    return spark.createDataFrame(rows, "model string, v int, e int, h int, parameters long")


#: Each vector as the losses of a run.
RECURSIVE = f"WITH RECURSIVE {EMB}, l AS (SELECT id, list_transform(x, lambda e: abs(e)) AS x FROM e), " + """
r(id, i, best, rate, missed, flat, stopped) AS (SELECT id, 0, 'inf'::DOUBLE, 0.003::DOUBLE, 0, 0, false FROM l UNION ALL
SELECT r.id, i + 1, CASE WHEN x[i + 1] < best - 1e-5 THEN x[i + 1] ELSE best END,
CASE WHEN x[i + 1] >= best - 1e-5 AND flat + 1 >= 3 THEN greatest(rate * 0.3, 1e-5) ELSE rate END, CASE WHEN x[i + 1] < best - 1e-5 THEN 0 ELSE missed + 1 END,
CASE WHEN x[i + 1] < best - 1e-5 OR flat + 1 >= 3 THEN 0 ELSE flat + 1 END, x[i + 1] >= best - 1e-5 AND missed + 1 >= 6 FROM r JOIN l USING (id) WHERE i < len(x) AND NOT stopped)"""


def losses(spark, sf_dir):
    return numbers(spark, sf_dir).select("id", F.transform("x", F.abs).alias("x"))


@query("lr_schedule", RECURSIVE + " SELECT id, round(rate, 12) AS rate FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1")
def lr_schedule(spark, sf_dir):
    return losses(spark, sf_dir).select("id", F.round(N.plateau(F.col("x"))["rate"], 12).alias("rate"))


@query("early_stop", RECURSIVE + " SELECT id, i AS epochs, best, stopped FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1")
def early_stop(spark, sf_dir):
    return losses(spark, sf_dir).withColumn("s", N.plateau(F.col("x"))).select("id", "s.epochs", "s.best", "s.stopped")


#: Histories of three models: class and place give model and epoch, the mean gives the loss; they end after 64, 50 and 41 epochs.
FLAT = f"WITH {EMB}, h AS (SELECT ['a', 'b', 'c'][y % 3 + 1] AS model, k::INT AS epoch, round(avg(abs(x[k])), 9) AS loss FROM e, range(1, 65) r(k) WHERE k <= [64, 50, 41][y % 3 + 1] GROUP BY 1, 2)"


def history(spark, sf_dir):
    each = numbers(spark, sf_dir).select(F.get(F.array(*map(F.lit, "abc")), (F.col("y") % 3).cast("int")).alias("model"), F.posexplode("x").alias("epoch", "loss"))
    ends = F.when(F.col("model") == "a", 64).when(F.col("model") == "b", 50).otherwise(41)
    return each.withColumn("epoch", F.col("epoch") + 1).filter(F.col("epoch") <= ends).groupBy("model", "epoch").agg(F.round(F.avg(F.abs("loss")), 9).alias("loss"))


@query("loss_table", FLAT + ", s AS (SELECT min(n) AS n FROM (SELECT max(epoch) AS n FROM h GROUP BY model)) SELECT epoch, max(loss) FILTER (WHERE model = 'a') AS a, max(loss) FILTER (WHERE model = 'b') AS b, max(loss) FILTER (WHERE model = 'c') AS c FROM h, s WHERE epoch <= s.n AND (epoch % 3 = 1 OR epoch = s.n) GROUP BY epoch")
def loss_table(spark, sf_dir):
    return N.loss_table(save(history(spark, sf_dir)), ["a", "b", "c"])


@query("model_summary", FLAT + " SELECT model, max(epoch) AS epochs, arg_max(loss, epoch) AS final_loss, min(loss) AS best_loss FROM h GROUP BY model")
def model_summary(spark, sf_dir):
    return N.summary(history(spark, sf_dir))


@query("sweep_diff", f"""WITH {EMB}, p AS (SELECT CASE WHEN a.id % 2 = 0 THEN 'cbow' ELSE 'sg' END AS arch, win, kind, list_dot_product(a.x[i:i + 31], b.x[i:i + 31]) / ((sqrt(list_dot_product(a.x[i:i + 31], a.x[i:i + 31])) + 1e-8) * (sqrt(list_dot_product(b.x[i:i + 31], b.x[i:i + 31])) + 1e-8)) AS sim
  FROM e a, (VALUES (3), (5), (10)) w(win), (VALUES ('lib', 1), ('own', 33)) k(kind, i), e b WHERE b.id = a.id + win),
r AS (SELECT arch, win, round(avg(sim) FILTER (WHERE kind = 'lib'), 4) AS lib, round(avg(sim) FILTER (WHERE kind = 'own'), 4) AS own FROM p GROUP BY arch, win) SELECT arch, win, lib, own, round(lib - own, 4) AS diff FROM r""")
def sweep_diff(spark, sf_dir):
    """Mean probe similarity of two kinds of models, the halves of the vectors, per architecture and window, and their difference; probes are ``win`` apart."""
    e = numbers(spark, sf_dir)
    a = e.select("id", "x", F.when(F.col("id") % 2 == 0, "cbow").otherwise("sg").alias("arch"), F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("win"))
    pairs = a.join(e.select(F.col("id").alias("other"), F.col("x").alias("z")), F.col("other") == F.col("id") + F.col("win"))
    runs = pairs.select("arch", "win", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), A.cosine(F.slice("x", i, 32), F.slice("z", i, 32)).alias("sim")) for k, i in (("lib", 1), ("own", 33))])).alias("r"))
    return N.sweep_difference(runs.select("arch", "win", "r.kind", "r.sim"), "lib", "own")


GRID = "(VALUES (100, 5, 10, 'base'), (200, 5, 10, 'dim'), (300, 5, 10, 'dim'), (100, 3, 10, 'window'), (100, 10, 10, 'window'), (100, 5, 5, 'negative'), (100, 5, 15, 'negative')) g(dim, win, neg, sweep)"
