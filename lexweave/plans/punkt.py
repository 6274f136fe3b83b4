"""Sentence splitting learnt from ``documents`` themselves: what is counted, what is found, and the sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import punkt as P
from ..registry import query, spread, table
from ..storage import save
from .cleaning import S, _quoted

#: Texts with abbreviations, initials and numbers, which the documents lack.
SAID = [(-1 - k, t) for k, t in enumerate([
    "Dr. Rao met Prof. A. K. Sen at 10. He left. " * 12, "The firm, e.g. Foo Inc. of Rome, grew 3.5 percent. So did Dr. Rao. " * 9, "On May 5. The rest... of it ended? Yes! \"No.\" He said so.",
    "See fig. 3 and fig. 4. We saw fig. 5 too. They saw fig. 6. " * 8, "one two", "", "Mr. J. Smith went. mr. x stayed etc. and so on. The end.",
])]
SAID_SQL = "(SELECT doc_id::BIGINT AS doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id::BIGINT, text FROM (VALUES " + ", ".join(f"({i}, {_quoted(t)})" for i, t in SAID) + ") s(doc_id, text))"


def _kind(raw: str) -> str:
    return f"lower(regexp_replace({raw}, '{P.EDGES}', '', 'g'))"


def _bare(raw: str) -> str:
    return f"(CASE WHEN regexp_matches(rtrim({_kind(raw)}, '.'), '{P.NUMBER}') THEN '##number##' ELSE rtrim({_kind(raw)}, '.') END)"


def _first(raw: str) -> str:
    return rf"substr(regexp_replace({raw}, '^[^\p{{L}}\p{{N}}]+', ''), 1, 1)"


def _part(k: str, rest: str, p: str) -> str:
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0.0 ELSE {k} * ln(greatest({p}, 1e-300)) + {rest} * ln(greatest(1 - {p}, 1e-300)) END)"


def _likelihood(a: str, b: str, both: str, n: str) -> str:
    p, p1, p2 = f"({b} / {n}::DOUBLE)", f"({both} / nullif({a}, 0)::DOUBLE)", f"coalesce(({b} - {both}) / nullif({n} - {a}, 0)::DOUBLE, 1.0)"
    first = f"({_part(both, f'({a} - {both})', p)} + {_part(f'({b} - {both})', f'({n} - {a} - {b} + {both})', p)})"
    second = f"(CASE WHEN {a} = {both} THEN 0.0 ELSE {_part(both, f'({a} - {both})', p1)} END + CASE WHEN {b} = {both} THEN 0.0 ELSE {_part(f'({b} - {both})', f'({n} - {a} - {b} + {both})', p2)} END)"
    return f"(-2 * ({first} - {second}))"


_ENDS = P.ENDS.replace("'", "''")
_DOTS = P.DOTS.replace("'", "''")
INSIDE = "(length(w) - length(replace(w, '.', '')))"
LETTERS = f"(length(w) - {INSIDE})"
MODEL = rf"""
k0 AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(text, '{S}+'), lambda x: x <> '') AS ws FROM {SAID_SQL}),
k1 AS MATERIALIZED (SELECT doc_id, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS pos, unnest(list_concat([NULL], ws[1:-2])) AS prev, unnest(list_concat(ws[2:], [NULL])) AS after FROM k0 WHERE len(ws) > 0),
k2 AS MATERIALIZED (SELECT *, {_bare('raw')} AS w, ends_with({_kind('raw')}, '.') AS dot, regexp_matches(raw, '{_ENDS}') AS ends, regexp_matches(raw, '{_DOTS}') AS dots, regexp_matches({_first('raw')}, '^\p{{Lu}}') AS upper, regexp_matches({_first('raw')}, '^\p{{Ll}}') AS lower,
  coalesce(regexp_matches(prev, '{_ENDS}'), true) AS opens, {_bare('after')} AS after_w, regexp_matches({_first('after')}, '^\p{{Lu}}') AS after_upper, regexp_matches({_first('after')}, '^\p{{Ll}}') AS after_lower FROM k1),
kc AS MATERIALIZED (SELECT w, count(*) FILTER (WHERE dot) AS c_dot, count(*) AS c, count(*) FILTER (WHERE lower) AS lower, count(*) FILTER (WHERE upper) AS upper, count(*) FILTER (WHERE upper AND NOT opens) AS mid_upper FROM k2 GROUP BY w),
kt AS (SELECT sum(c)::BIGINT AS n, sum(c_dot)::BIGINT AS n_dot FROM kc),
ks AS (SELECT w, -2 * ((c_dot * ln(greatest(n_dot / n::DOUBLE, 1e-300)) + (c - c_dot) * ln(1 - n_dot / n::DOUBLE + 1e-8)) - (c_dot * ln({P.PERIOD}) + (c - c_dot) * ln(1 - {P.PERIOD}))) * exp(-{LETTERS}) * ({INSIDE} + 1) * pow({LETTERS}::DOUBLE, -(c - c_dot)) AS score FROM kc, kt WHERE c_dot > 0 AND regexp_matches(w, '\p{{L}}') AND w <> '##number##'),
ka AS MATERIALIZED (SELECT w, round(score, 6) AS score FROM ks WHERE score >= {P.ABBREVIATION}),
kb AS MATERIALIZED (SELECT after_w AS w, count(*) AS both_, count(*) FILTER (WHERE after_lower) AS opens_lower FROM k2 WHERE ends AND after IS NOT NULL AND NOT dots AND NOT (dot AND w IN (SELECT w FROM ka)) GROUP BY after_w),
kg AS (SELECT sum(both_)::BIGINT AS n_at FROM kb),
kd AS MATERIALIZED (SELECT w FROM kc JOIN kb USING (w), kt, kg WHERE w <> '' AND w <> '##number##' AND {_likelihood('n_at', 'c', 'both_', 'n')} >= {P.STARTER} AND n / n_at::DOUBLE > c / both_::DOUBLE),
kp AS (SELECT w, after_w, count(*) AS both_ FROM k2 WHERE dot AND after IS NOT NULL AND after_w <> '' AND (w IN (SELECT w FROM ka) OR regexp_matches(w, '^\p{{L}}\z') OR w = '##number##') GROUP BY w, after_w),
ko AS MATERIALIZED (SELECT kp.w, after_w FROM kp JOIN kc a ON a.w = kp.w JOIN kc b ON b.w = kp.after_w, kt WHERE {_likelihood('a.c', 'b.c', 'both_', 'n')} >= {P.COLLOCATION} AND n / a.c::DOUBLE > b.c / both_::DOUBLE)"""

SENTENCES = rf"""{MODEL},
kx AS (SELECT e.*, coalesce(e.dot AND e.w IN (SELECT w FROM ka), false) AS abbr, e.dot AND regexp_matches(e.w, '^\p{{L}}\z') AS initial, e.dot AND e.w = '##number##' AS number,
  e.dot AND (e.w, e.after_w) IN (SELECT (w, after_w) FROM ko) AS together, e.after_w IN (SELECT w FROM kd) AS starter, coalesce(o.lower, 0) > 0 AS n_lower, coalesce(o.upper, 0) > 0 AS n_upper, coalesce(o.mid_upper, 0) > 0 AS n_mid, coalesce(b.opens_lower, 0) > 0 AS n_opens
  FROM k2 e LEFT JOIN kc o ON o.w = e.after_w LEFT JOIN kb b ON b.w = e.after_w WHERE ends AND after IS NOT NULL),
ky AS (SELECT *, after_upper AND n_lower AND NOT n_mid AS begins, after_lower AND (n_upper OR NOT n_opens) AS goes_on FROM kx),
kz AS MATERIALIZED (SELECT doc_id, pos FROM ky WHERE CASE WHEN NOT abbr AND NOT dots AND NOT initial AND NOT number THEN true WHEN together THEN false
  WHEN (abbr OR dots) AND NOT initial AND (begins OR after_upper AND starter) THEN true WHEN (initial OR number) AND (goes_on OR NOT begins AND NOT goes_on AND initial AND after_upper AND NOT n_lower) THEN false ELSE NOT abbr AND NOT dots END),
kn AS (SELECT k1.doc_id, k1.pos, raw, count(kz.pos) OVER (PARTITION BY k1.doc_id ORDER BY k1.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sent_idx FROM k1 LEFT JOIN kz ON kz.doc_id = k1.doc_id AND kz.pos = k1.pos)"""


def documents(spark, sf_dir):
    said = spark.createDataFrame(SAID, "doc_id long, text string")
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")).union(said)


@query("punkt_abbreviations", f"WITH {MODEL} SELECT w, score FROM ka")
def punkt_abbreviations(spark, sf_dir):
    return P.abbreviations(save(P.counted(P.tokens(documents(spark, sf_dir)))))


@query("punkt_starters", f"WITH {MODEL} SELECT w, '' AS after_w FROM kd UNION ALL SELECT w, after_w FROM ko")
def punkt_starters(spark, sf_dir):
    """Frequent sentence starters, and collocations across a period."""
    model = P.learn(P.tokens(documents(spark, sf_dir)))
    return model.starters.select("w", F.lit("").alias("after_w")).union(model.collocations)


@query("punkt_sentences", f"WITH {SENTENCES} SELECT doc_id, sent_idx::INT AS sent_idx, string_agg(raw, ' ' ORDER BY pos) AS sentence FROM kn GROUP BY doc_id, sent_idx")
def punkt_sentences(spark, sf_dir):
    return P.split(documents(spark, sf_dir))
