"""Cleaning and language queries over ``documents`` and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.pages import outside
from ..registry import query, spread, table

S = r"[ \t\n\r\f\x0B\x{00A0}]"
NS = r"[^ \t\n\r\f\x0B\x{00A0}]"
BOILER = "(?i)" + "|".join(X.BOILERPLATE)
_DOT = rf"{S}*(?:\[dot\]|dot){S}*"
_W = r"[\p{L}\p{N}_]"

#: Rows that hold what the documents lack.
QUIRKS = [
    "see https://a.b/c?d=1, www.x.y end", "mail dofa[at]uni[dot]ac[dot]in now", "ask asha dot rao at uni dot ac dot in", "look at anecdotes",
    "mail (a@b.co) ok a@b", "a&amp;b &#39; &NBSP; c&nbsp;d", "call 0291-280-1516 now", "session 2023-2024 begins", "Mar 05 2025 event", "on 02.03.2025 ok",
    "a....b ----c ___d **e --f", "----\n_*_\n——\na-\n\nkeep", "x <b>bold\n</b> y", "SOURCE_URL: http://q\n\nbody\nSOURCE_PDF: z\nend", "Home\nContact\nLast updated : 3 May\nreal line\nreal line\n  real line ",
    "привет ab", "héllo wörld", "12 34", "is it an ox", "cs601 b17me038", "The quick brown fox", "", "   ", "xx yy zz",
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


QUIRK_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({-k - 1}, {_quoted(s)})" for k, s in enumerate(QUIRKS)) + ") q(doc_id, text))"
#: Documents and literal rows together.
INPUT = f"(SELECT doc_id::BIGINT doc_id, text FROM documents UNION ALL SELECT doc_id::BIGINT, text FROM {QUIRK_SQL})"


def rows(spark, sf_dir):
    literal = spark.createDataFrame([(-k - 1, s) for k, s in enumerate(QUIRKS)], "doc_id long, text string")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).union(literal)


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def lines_sql(x: str, keep: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {keep}), chr(10))"


PROVENANCE_SQL = lines_sql("text", "NOT (starts_with(l, 'SOURCE_URL:') OR starts_with(l, 'SOURCE_PDF:'))")
DIVIDER_KEEP = rf"NOT (regexp_matches({strip_sql('l')}, '^[^\p{{L}}\p{{N}}]+$') OR regexp_matches({strip_sql('l')}, '{BOILER}'))"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def collapse_sql(x: str) -> str:
    return sub(sub(sub(sub(x, "[.]{3,}", "."), "-{3,}", " "), "_{3,}", " "), "[*]{2,}", " ")


URL_SQL = rf"https?://{NS}+|www\.{NS}+"
EMAIL_SQL = rf"{NS}+@{NS}+\.{NS}+"
HIDDEN_SQL = rf"(?i)({_W}+(?:{_DOT}{_W}+)*){S}*(?:\[at\]|at){S}*{_W}+{_DOT}{_W}+(?:{_DOT}{_W}+)*"


def hidden_sql(x: str) -> str:
    marked = f"string_split_regex(regexp_replace({x}, '{HIDDEN_SQL}', '{X.OPEN}\\1{X.SHUT}', 'g'), '[{X.OPEN}{X.SHUT}]')"
    return f"array_to_string(list_transform({marked}, lambda p, k: CASE WHEN k % 2 = 0 THEN regexp_replace(p, '(?i){_DOT}', '', 'g') ELSE p END), '')"


def phones_sql(x: str) -> str:
    r"""RE2 knows ASCII word boundaries only: letters and numbers beyond are put between underscores, which are none of the rule's characters, and taken out again."""
    marked = rf"regexp_replace(regexp_replace({x}, '([\p{{L}}\p{{N}}])', '_{X.OPEN}\1{X.SHUT}_', 'g'), '_{X.OPEN}([A-Za-z0-9]){X.SHUT}_', '\1', 'g')"
    gone = rf"regexp_replace({marked}, '\b\+?{X.PHONE}\b', ' ', 'g')"
    return f"replace(replace({gone}, '_{X.OPEN}', ''), '{X.SHUT}_', '')"


def clean_sql(x: str) -> str:
    """The whole chain."""
    x = lines_sql(x, "NOT (starts_with(l, 'SOURCE_URL:') OR starts_with(l, 'SOURCE_PDF:'))")
    x = phones_sql(sub(sub(hidden_sql(sub(x, URL_SQL, " ")), EMAIL_SQL, " "), "&[a-z]+;", " "))
    x = collapse_sql(lines_sql(sub(x, "<[^>]+>", " "), DIVIDER_KEEP))
    return f"replace(replace({x}, chr(160), ' '), chr(8203), '')"


def _mapped(name: str, make, sql: str) -> None:
    query(name, f"SELECT doc_id, {sql} AS out FROM {INPUT}")(lambda spark, sf_dir: rows(spark, sf_dir).select("doc_id", make(F.col("text")).alias("out")))


_mapped("strip_provenance", X.without_provenance, PROVENANCE_SQL)
_mapped("clean_urls", X.without_urls, sub("text", URL_SQL, " "))
_mapped("clean_obf_email", X.join_hidden_emails, hidden_sql("text"))
_mapped("clean_emails", X.without_emails, sub("text", EMAIL_SQL, " "))
_mapped("clean_entities", X.without_entities, sub("text", "&[a-z]+;", " "))
_mapped("clean_tags", X.without_tags, sub("text", "<[^>]+>", " "))
_mapped("drop_divider_lines", X.without_dividers, lines_sql("text", DIVIDER_KEEP))
_mapped("collapse_punct", X.collapse_punctuation, collapse_sql("text"))
_mapped("clean_phones", X.without_phones, phones_sql("text"))
_mapped("clean_text", X.clean, clean_sql("text"))
_mapped("pdf_clean", X.clean_pdf, strip_sql(sub(sub("replace(text, chr(12), chr(10))", r"\n{3,}", "\\n\\n").replace("'\\n\\n'", "chr(10)||chr(10)"), r"[ \t]{2,}", " ")))
_mapped("dedup_lines", X.distinct_lines, f"(WITH k AS (SELECT list_filter(string_split(text, chr(10)), lambda l: {strip_sql('l')} <> '') ls) SELECT coalesce(array_to_string(list_filter(ls, lambda l, i: list_position(list_transform(ls, lambda m: {strip_sql('m')}), {strip_sql('l')}) = i), chr(10)), '') FROM k)")
_mapped("english_ratio", X.english_share, r"length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0)::DOUBLE")
ALPHA = rf"list_filter(string_split_regex(text, '{S}+'), lambda w: regexp_matches(w, '^\p{{L}}+$'))"
MEAN = f"(length(array_to_string({ALPHA}, '')) / nullif(len({ALPHA}), 0)::DOUBLE)"
_mapped("english_sentence", X.is_english_sentence, f"({strip_sql('text')} <> '' AND (len({ALPHA}) = 0 OR coalesce({MEAN} > 3.2, false)))")
_mapped(
    "english_block", X.is_english_block,
    rf"(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE >= 0.8, false) AND len({ALPHA}) > 0 AND coalesce({MEAN} > 3.2 OR list_has_any(list_transform({ALPHA}, lambda w: lower(w)), [{', '.join(map(_quoted, X.COMMON_WORDS))}]), false))",
)


@query("boilerplate_lines", rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM {INPUT}) SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches({strip_sql('line')}, '{BOILER}') GROUP BY ALL")
def boilerplate_lines(spark, sf_dir):
    every = rows(spark, sf_dir).select("doc_id", F.explode(X.lines(F.col("text"))).alias("line"))
    return every.filter(X.is_boilerplate(F.col("line"))).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@query("pdf_save_filter", f"SELECT doc_id, length({strip_sql('text')})::BIGINT AS n FROM {INPUT} WHERE length({strip_sql('text')}) >= 50")
def pdf_save_filter(spark, sf_dir):
    n = F.length(X.stripped(F.col("text"))).cast("long")
    return rows(spark, sf_dir).select("doc_id", n.alias("n")).filter("n >= 50")


@query("table_rows_to_text", "SELECT p_partkey, trim(p_name) || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_brand END || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_type END AS line FROM part WHERE p_size % 3 <> 0 OR p_size % 2 <> 0")
def table_rows_to_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cells = F.array(F.concat(F.lit(" "), "p_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")), F.when(F.col("p_size") % 2 != 0, F.col("p_type")).otherwise(F.lit("  ")))
    return part.select("p_partkey", F.explode(X.table_sentences(F.array(cells))).alias("line"))


#: Parts as blocks of a page: 40 to a page, each fifth of them is a table; the numbers give the rectangles.
BLOCKS = "b AS (SELECT p_partkey // 40 AS page, p_partkey AS block_no, (p_size * 7 % 60)::DOUBLE AS x0, (p_size * 7 % 60 + 8)::DOUBLE AS x1, (p_partkey % 40 * 5)::DOUBLE AS y0, (p_partkey % 40 * 5 + 12)::DOUBLE AS y1, p_name AS text, p_partkey % 5 = 0 AS is_table FROM part)"


@query("block_table_antijoin", f"WITH {BLOCKS} SELECT page, string_agg(text, chr(10) ORDER BY block_no) AS text FROM b WHERE NOT is_table AND NOT EXISTS (SELECT 1 FROM b t WHERE t.is_table AND t.page = b.page AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0) GROUP BY page")
def block_table_antijoin(spark, sf_dir):
    i, x, y = F.col("p_partkey"), F.col("p_size") * 7 % 60, F.col("p_partkey") % 40 * 5
    blocks = table(spark, sf_dir, "part").select(F.floor(i / 40).alias("page"), i.alias("block_no"), x.cast("double").alias("x0"), (x + 8).cast("double").alias("x1"), y.cast("double").alias("y0"), (y + 12).cast("double").alias("y1"), F.col("p_name").alias("text"))
    is_table = F.col("block_no") % 5 == 0
    kept = outside(blocks.filter(~is_table), blocks.filter(is_table))
    ordered = F.sort_array(F.collect_list(F.struct("block_no", "text")))
    return kept.groupBy("page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
