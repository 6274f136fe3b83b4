"""Language detection over ``documents``: profiles learnt from those with a language, and what they decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detection as D
from ..registry import query, spread, table
from .cleaning import INPUT, MEAN, S, rows, strip_sql
from .corpus import ALPHA_S, SENTS

def letters(x: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex(lower({x}), '{S}+'), lambda w: regexp_matches(w, '^\p{{L}}+$')), ' ')"


def grams(rows_sql: str, key: str) -> str:
    """(key.., gram) of every trigram of ``t``, a code of three times 21 bits."""
    code = "list_transform(range(1, len(u) - 1), lambda p: (u[p] << 42) + (u[p + 1] << 21) + u[p + 2])"
    return f"SELECT {key}, unnest({code}) AS gram FROM (SELECT {key}, list_transform(string_split(' ' || t || ' ', ''), lambda c: unicode(c)::BIGINT) AS u FROM ({rows_sql}) WHERE t <> '')"


PROFILES = f"""
pc AS MATERIALIZED (SELECT lang, gram, count(*) AS n FROM ({grams(f"SELECT lang, {letters('text')} AS t FROM documents WHERE lang IS NOT NULL", 'lang')}) GROUP BY lang, gram),
pr AS MATERIALIZED (SELECT lang, gram, n, sum(n) OVER (PARTITION BY lang) AS total FROM pc QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {D.MOST}),
pg2 AS (SELECT DISTINCT gram FROM pr), pl AS (SELECT lang, any_value(total) AS total, (SELECT count(*) FROM pg2) AS kept FROM pr GROUP BY lang),
ps AS MATERIALIZED (SELECT gram, pl.lang, ln((coalesce(n, 0) + 0.5) / (pl.total + 0.5 * kept)) AS score FROM pg2 CROSS JOIN pl LEFT JOIN pr USING (gram, lang))"""


def detected(rows_sql: str, key: str) -> str:
    """(key.., found) of the rows (key.., t) that have a trigram of the profiles."""
    return f"SELECT {key}, first(lang ORDER BY score DESC, lang) AS found FROM (SELECT {key}, lang, round(sum(score), 9) AS score FROM ({grams(rows_sql, key)}) JOIN ps USING (gram) GROUP BY {key}, lang) GROUP BY {key}"


def model(spark, sf_dir):
    return D.detector(D.profiles(spread(table(spark, sf_dir, "documents").select("lang", "text"))))


@query("language_profiles", f"WITH {PROFILES} SELECT lang, gram, n, total::BIGINT AS total FROM pr")
def language_profiles(spark, sf_dir):
    return D.profiles(spread(table(spark, sf_dir, "documents").select("lang", "text")))


DETECTED = f"WITH {PROFILES}, df AS (" + detected(f"SELECT doc_id, {letters('text')} AS t FROM documents", "doc_id") + ")"


def _documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", model(spark, sf_dir)(D.letters_only(F.col("text"))).alias("detected"))


@query("language_detected", DETECTED + " SELECT doc_id, lang, found AS detected FROM documents LEFT JOIN df USING (doc_id)")
def language_detected(spark, sf_dir):
    return _documents(spark, sf_dir)


@query("language_agreement", DETECTED + " SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang = found) AS agreed FROM documents LEFT JOIN df USING (doc_id) GROUP BY lang")
def language_agreement(spark, sf_dir):
    """How often the detector says what the documents say."""
    return _documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("detected")).alias("agreed"))


FALLBACK = f"(len({ALPHA_S}) = 0 OR coalesce(length(array_to_string({ALPHA_S}, '')) / nullif(len({ALPHA_S}), 0)::DOUBLE > 3.2, false))"


@query("english_sentence_detected", f"""WITH {SENTS}, {PROFILES},
ds AS MATERIALIZED (SELECT doc_id, sent_idx, sentence, {letters('sentence')} AS t FROM e),
dd AS ({detected('SELECT doc_id, sent_idx, t FROM ds WHERE length(t) >= 15', 'doc_id, sent_idx')})
SELECT doc_id, sent_idx::INT AS sent_idx, {strip_sql('sentence')} <> '' AND CASE WHEN t = '' THEN true ELSE coalesce(found = 'en', {FALLBACK}) END AS english FROM ds LEFT JOIN dd USING (doc_id, sent_idx)""")
def english_sentence_detected(spark, sf_dir):
    """Every sentence of the cleaned documents: detector first, the rule of mean length where it has nothing to go by."""
    text = X.distinct_stripped_lines(X.clean(F.col("text")))
    each = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.sentences(text)).alias("sent_idx", "sentence"))
    return each.select("doc_id", "sent_idx", D.is_english_sentence(F.col("sentence"), model(spark, sf_dir)).alias("english"))


ALPHA = rf"list_filter(string_split_regex(text, '{S}+'), lambda w: regexp_matches(w, '^\p{{L}}+$'))"
COMMON = "[" + ", ".join(f"'{w}'" for w in X.COMMON_WORDS) + "]"


@query("english_block_detected", rf"""WITH {PROFILES}, ib AS MATERIALIZED (SELECT doc_id, text, {letters('text')} AS t FROM {INPUT}),
bd AS ({detected('SELECT doc_id, t FROM ib WHERE length(text) >= 20', 'doc_id')})
SELECT doc_id, coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE >= 0.8, false) AND t <> ''
  AND (coalesce({MEAN} > 3.2 OR list_has_any(list_transform({ALPHA}, lambda w: lower(w)), {COMMON}), false) OR coalesce(found = 'en', false)) AS english FROM ib LEFT JOIN bd USING (doc_id)""")
def english_block_detected(spark, sf_dir):
    """Documents, and literal rows, as blocks."""
    return rows(spark, sf_dir).select("doc_id", D.is_english_block(F.col("text"), model(spark, sf_dir)).alias("english"))
