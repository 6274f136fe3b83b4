"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .clusters import cluster_vectors
from .common import table
from .decontaminate import contaminated
from .fragments import jaccard_components
from .html import extract_text
from .katz import score_texts
from .language import identify_language
from .manifest import dataset_manifest
from .minhash import near_duplicates
from .mixing import mix_report
from .quality import judge_quality
from .sharding import shard_documents
from .substring import remove_repeats
from .toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _op(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# All pairs by shared shingles, then everything reachable; the operator has no part in it.
ORACLES["op8_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES["op11_fragments"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES["op9_substring"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, unnest(list_transform(range(1, len(ws) - 11), lambda p: array_to_string(ws[p:p + 12], ' '))) AS g FROM w WHERE len(ws) >= 13),
f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
r AS (SELECT doc_id, p FROM v JOIN f USING (g) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
k AS (SELECT t.doc_id, t.p, t.word, max(r.p) OVER (PARTITION BY t.doc_id ORDER BY t.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NULL AS stays FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.p = t.p),
o AS (SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE stays) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)"""


def _rounds(k: int, rounds: int, dim: int) -> str:
    """The k-means of op12 with every distance computed, one step after another."""
    out = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, unnest(min({{'d': d, 'k': k}})) FROM (SELECT vec_id, v.v, c.k, {d} AS d FROM v, c{r} c) GROUP BY vec_id, v)")
        out.append(f"s{r} AS (SELECT k, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(p) GROUP BY k, p)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{r} GROUP BY k) u USING (k))")
    return ", ".join(out)


ORACLES["op12_annulus"] = f"""
WITH {_rounds(40, 5, 64)}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a5 JOIN c5 c USING (k)"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of trees over ``leaves`` (t, p, h): ``levels`` levels, then each leaf's siblings ({name}_side) on each."""
    out = [f"{name}0 AS MATERIALIZED (SELECT t, p, h, count(*) OVER (PARTITION BY t) AS n FROM ({leaves}))"]
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT t, p // 16 AS p, string_agg(h, '' ORDER BY p) AS run, any_value(n) AS n FROM {name}{k} GROUP BY t, p // 16)")
        out.append(f"{name}{k + 1} AS (SELECT t, p, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h, (n + 15) // 16 AS n FROM {name}r{k})")
    return ", ".join(out)


def _way(name: str, levels: int) -> tuple[str, str, str]:
    """Joins, siblings and steps of a leaf ``x`` (t, p) up its tree; above its root the siblings are empty and the digest stays."""
    joins = " ".join(f"JOIN {name}r{k} ON {name}r{k}.t = x.{name}t AND {name}r{k}.p = x.{name}p // {16 ** (k + 1)}" for k in range(levels))
    cut = [(f"CASE WHEN {name}r{k}.n > 1 THEN substr({name}r{k}.run, 1, 64 * (x.{name}p // {16 ** k} % 16)) ELSE '' END", f"CASE WHEN {name}r{k}.n > 1 THEN substr({name}r{k}.run, 64 * (x.{name}p // {16 ** k} % 16) + 65) ELSE '' END") for k in range(levels)]
    return joins, ", ".join(f"{a} AS {name}l{k}, {b} AS {name}g{k}, {name}r{k}.n > 1 AS {name}b{k}" for k, (a, b) in enumerate(cut)), " || ".join(f"{name}l{k} || {name}g{k}" for k in range(levels))


def _folded() -> str:
    steps, k = [], 0
    for name, levels in (("i", 5), ("o", 3)):
        for j in range(levels):
            steps.append(f"z{k + 1} AS (SELECT * REPLACE (CASE WHEN {name}b{j} THEN sha256({name}l{j} || acc || {name}g{j}) ELSE acc END AS acc) FROM z{k})")
            k += 1
    return ", ".join(steps)


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: " + "{})"


def _crc32() -> str:
    """Unsigned crc32 of the decimal digits of doc_id, bit by bit."""
    bit = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    step = "xor(a, c)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: {bit})[1]"
    return f"xor({_CRC.format(step)}, 4294967295)"


ORACLES["op13_merkle"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, {_LEAF.format('text')} AS h, CASE WHEN {_crc32()} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format('text')} END AS claim FROM documents),
s AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source FROM documents)),
l AS MATERIALIZED (SELECT doc_id, d.h, claim, t AS it, row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS ip, 0 AS ot, t AS op FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
{_tree('i', 'SELECT it AS t, ip AS p, h FROM l', 5)}, {_tree('o', 'SELECT 0 AS t, t AS p, h FROM i5', 3)},
z0 AS (SELECT doc_id, x.h AS leaf, claim AS acc, i5.h AS subroot, o3.h AS root, {_way('i', 5)[1]}, {_way('o', 3)[1]} FROM l x {_way('i', 5)[0]} {_way('o', 3)[0]} JOIN i5 ON i5.t = x.it JOIN o3 ON true),
{_folded()}
SELECT doc_id, leaf, subroot, root, sha256({_way('i', 5)[2]} || {_way('o', 3)[2]}) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM z8"""


@_op
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@_op
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_op
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


@_op
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_op
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=13, texts=False)


@_op
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@_op
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


@_op
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_op
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@_op
def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@_op
def op12_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


@_op
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(table(spark, sf_dir, "documents"))


@_op
def op11_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)
