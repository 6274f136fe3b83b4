"""Corpus, statistics and vocabulary queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import vocabulary as V
from ..operators.training import sweep
from ..registry import query, spread, table
from ..storage import save
from .cleaning import MEAN, S, _quoted, clean_sql, strip_sql
from .names import GRID

TOK = "list_filter(list_transform(string_split_regex(sentence, '" + r"""[ \t\n\r\f\x0B\x{00A0}\[\](){}<>,;:"?!&@#$%]+""" + "'), lambda w: lower(trim(w, '.''`'))), lambda w: regexp_matches(w, '^[a-z][a-z0-9]+$'))"
ALPHA_S = rf"list_filter(string_split_regex(sentence, '{S}+'), lambda w: regexp_matches(w, '^\p{{L}}+$'))"
#: Marked twice, as initials in a row share the character between them.
_INITIALS = rf"regexp_replace({{}}, '(^|[^A-Za-z0-9_])([A-Z])\.', '\1\2{X.DOT}', 'g')"
SPLIT_SQL = rf"string_split(regexp_replace({_INITIALS.format(_INITIALS.format('x'))}, '([.!?])[ \n\t]+([A-Z0-9])', '\1{X.BREAK}\2', 'g'), '{X.BREAK}')"
#: doc_id, sent_idx, toks, key: sentences before removal of repeats across documents.
SENTS = f"""
c AS (SELECT doc_id, string_split({clean_sql('text')}, chr(10)) ls FROM documents),
k AS (SELECT doc_id, list_filter(ls, lambda l: {strip_sql('l')} <> '') ls FROM c),
d AS (SELECT doc_id, coalesce(array_to_string(list_filter(ls, lambda l, i: list_position(list_transform(ls, lambda m: {strip_sql('m')}), {strip_sql('l')}) = i), chr(10)), '') AS x FROM k),
p AS (SELECT doc_id, unnest({SPLIT_SQL}) AS s, generate_subscripts({SPLIT_SQL}, 1) - 1 AS sent_idx FROM d),
e AS (SELECT doc_id, sent_idx, replace(s, '{X.DOT}', '.') AS sentence FROM p),
f AS (SELECT doc_id, sent_idx, {TOK} AS toks FROM e WHERE {strip_sql('sentence')} <> '' AND (len({ALPHA_S}) = 0 OR coalesce(length(array_to_string({ALPHA_S}, '')) / nullif(len({ALPHA_S}), 0)::DOUBLE > 3.2, false))),
g AS (SELECT doc_id, min(sent_idx)::INT AS sent_idx, array_to_string(toks, ' ') AS key FROM f WHERE len(toks) >= 3 GROUP BY doc_id, array_to_string(toks, ' '))
"""
#: The same after removal: the corpus.
CORPUS = SENTS + """, u AS (SELECT key, min({'doc_id': doc_id, 'sent_idx': sent_idx}) AS first FROM g GROUP BY key),
s AS (SELECT first.doc_id AS doc_id, first.sent_idx AS sent_idx, key FROM u),
t AS (SELECT doc_id, sent_idx, unnest(string_split(key, ' ')) AS word, generate_subscripts(string_split(key, ' '), 1)::INT - 1 AS pos FROM s),
w AS (SELECT word, count(*) AS n FROM t GROUP BY word), v AS (SELECT * FROM w WHERE n >= 5)
"""
STOP = ", ".join(_quoted(x) for x in C.STOP_WORDS)


def sents(spark, sf_dir):
    return C.sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def corpus(spark, sf_dir):
    return C.unique_sentences(C.all_sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def vocab(spark, sf_dir):
    return C.word_counts(corpus(spark, sf_dir)).filter("n >= 5")


@query("sentence_split", rf"WITH q AS (SELECT doc_id, {SPLIT_SQL.replace('(x,', '(text,')} AS ss FROM documents) SELECT doc_id, generate_subscripts(ss, 1)::INT - 1 AS sent_idx, replace(unnest(ss), '{X.DOT}', '.') AS sentence FROM q")
def sentence_split(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent_idx", "sentence"))


@query("tokenize", f"SELECT doc_id, {TOK.replace('sentence', 'text')} AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.tokens(F.col("text")).alias("tokens"))


def treebank_sql(x: str) -> str:
    for pattern, to in X.TREEBANK:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to.replace('$', chr(92)))}, 'g')"
    cut = " ".join(f"WHEN {_quoted(w)} THEN [substr(w, 1, {at - 1}), substr(w, {at})]" for w, at in X.CONTRACTIONS.items())
    return rf"flatten(list_transform(list_filter(string_split_regex({x}, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''), lambda w: CASE lower(w) {cut} ELSE [w] END))"


#: Sentences that hold what the documents lack.
SAID = ["They'll say \"it's 5.50, e.g. (well-known)\"...", "I cannot--gonna, lemme go!", "'Tis John's dog; don't we've", "a:b 10:30, c: d 'quoted' x?", "Stage-II vs. U.S.A.", "''", "end.)", "He said, \"no.\""]
SAID_SQL = "(SELECT doc_id, (generate_subscripts({split}, 1) - 1)::INT AS sent_idx, replace(unnest({split}), '{dot}', '.') AS sentence FROM documents UNION ALL SELECT * FROM (VALUES {said}) s(doc_id, sent_idx, sentence))".format(
    split=SPLIT_SQL.replace("(x,", "(text,"), dot=X.DOT, said=", ".join(f"({-k - 1}, 0, {_quoted(x)})" for k, x in enumerate(SAID)))


@query("treebank_tokenize", f"SELECT doc_id, sent_idx, array_to_string({treebank_sql('sentence')}, ' ') AS tokens FROM {SAID_SQL} q")
def treebank_tokenize(spark, sf_dir):
    """Penn Treebank tokens of every sentence of the documents, and of literal ones."""
    said = spark.createDataFrame([(-k - 1, 0, x) for k, x in enumerate(SAID)], "doc_id long, sent_idx int, sentence string")
    return sentence_split(spark, sf_dir).union(said).select("doc_id", "sent_idx", F.array_join(X.treebank_tokens(F.col("sentence")), " ").alias("tokens"))


@query("doc_sentences", f"WITH {SENTS} SELECT doc_id, sent_idx, key FROM g")
def doc_sentences(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "sent_idx", "key")


@query("global_dedup", f"WITH {CORPUS} SELECT doc_id, sent_idx, key FROM s")
def global_dedup(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "sent_idx", "key")


@query("benchmark_sentence_overlap", f"WITH {CORPUS} SELECT doc_id, sent_idx FROM s WHERE key NOT IN (SELECT array_to_string({TOK.replace('sentence', 'text')}, ' ') FROM benchmark)")
def benchmark_sentence_overlap(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.array_join(X.tokens(F.col("text")), " ").alias("key"))
    return corpus(spark, sf_dir).join(held, "key", "left_anti").select("doc_id", "sent_idx")


@query("doc_metadata", f"WITH {CORPUS} SELECT doc_id, count(DISTINCT sent_idx) AS sentences, count(*) AS tokens, count(DISTINCT word) AS vocab_size FROM t GROUP BY doc_id")
def doc_metadata(spark, sf_dir):
    return C.metadata(corpus(spark, sf_dir)).select("doc_id", "sentences", "tokens", "vocab_size")


TOTALS = "SELECT (SELECT count(DISTINCT doc_id) FROM s) AS total_documents, (SELECT count(*) FROM s) AS total_sentences, (SELECT count(*) FROM t) AS total_tokens, (SELECT count(*) FROM w) AS vocabulary_size"


@query("corpus_summary", f"WITH {CORPUS} {TOTALS}")
def corpus_summary(spark, sf_dir):
    return C.summary(corpus(spark, sf_dir))


@query("corpus_stats", f"WITH {CORPUS} SELECT *, total_tokens / total_documents::DOUBLE AS tokens_per_document, total_tokens / total_sentences::DOUBLE AS tokens_per_sentence FROM ({TOTALS})")
def corpus_stats(spark, sf_dir):
    return C.averages(C.summary(corpus(spark, sf_dir)))


@query("corpus_tokens", f"WITH {CORPUS} SELECT doc_id, sent_idx, pos, word FROM t")
def corpus_tokens(spark, sf_dir):
    return C.tokens(corpus(spark, sf_dir))


@query("word_count", f"WITH {CORPUS} SELECT word, n FROM w")
def word_count(spark, sf_dir):
    return C.word_counts(corpus(spark, sf_dir))


@query("vocab_size", f"WITH {CORPUS} SELECT count(*) AS vocabulary_size FROM w")
def vocab_size(spark, sf_dir):
    return C.word_counts(corpus(spark, sf_dir)).agg(F.count("*").alias("vocabulary_size"))


@query("vocab_min_count", f"WITH {CORPUS} SELECT word, n FROM v")
def vocab_min_count(spark, sf_dir):
    return vocab(spark, sf_dir)


#: Ties by first occurrence.
TOP = f"SELECT word, count(*) AS n, min({{'d': doc_id, 's': sent_idx, 'p': pos}}) AS first FROM t WHERE length(word) > 2 AND word NOT IN ({STOP}) GROUP BY word ORDER BY n DESC, first LIMIT 200"


@query("top_words", f"WITH {CORPUS}, z AS ({TOP}) SELECT word, n FROM z")
def top_words(spark, sf_dir):
    return C.top_words(C.first_seen(corpus(spark, sf_dir))).select("word", "n")


@query("top_words_ranked", f"WITH {CORPUS}, z AS ({TOP}) SELECT (row_number() OVER (ORDER BY n DESC, first))::INT AS rank, word, n FROM z")
def top_words_ranked(spark, sf_dir):
    return C.ranked(C.top_words(C.first_seen(corpus(spark, sf_dir)))).select("rank", "word", "n")


@query("wordcloud_weights", f"WITH {CORPUS}, z AS ({TOP}) SELECT word, n / max(n) OVER ()::DOUBLE AS weight FROM z")
def wordcloud_weights(spark, sf_dir):
    return C.ranked(C.top_words(C.first_seen(corpus(spark, sf_dir)))).select("word", "weight")


@query("vocab_index", f"WITH {CORPUS} SELECT word, n, row_number() OVER (ORDER BY word) - 1 AS idx FROM v")
def vocab_index(spark, sf_dir):
    return V.vocabulary(C.word_counts(corpus(spark, sf_dir)))


KEEP = "SELECT word, n, least(1.0, sqrt(1e-4 / (n / total::DOUBLE)) + 1e-4 / (n / total::DOUBLE)) AS keep FROM v, (SELECT sum(n) AS total FROM v)"


@query("keep_prob", f"WITH {CORPUS} SELECT word, n, round(keep, 9) AS keep FROM ({KEEP})")
def keep_prob(spark, sf_dir):
    return V.keep_probability(save(vocab(spark, sf_dir))).withColumn("keep", F.round("keep", 9))


@query("neg_dist", f"WITH {CORPUS} SELECT word, n, round(n ** 0.75 / sum(n ** 0.75) OVER (), 9) AS p FROM v")
def neg_dist(spark, sf_dir):
    return V.noise(save(vocab(spark, sf_dir))).withColumn("p", F.round("p", 9))


UNIFORM = "(('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("subsample", f"WITH {CORPUS}, q AS ({KEEP}), r AS (SELECT t.* FROM t JOIN q USING (word) WHERE {UNIFORM.format('doc_id, sent_idx, pos')} < keep) SELECT doc_id, sent_idx, pos, word FROM r QUALIFY count(*) OVER (PARTITION BY doc_id, sent_idx) >= 2")
def subsample(spark, sf_dir):
    every = save(corpus(spark, sf_dir))  # read twice, made once
    return V.subsample(C.tokens(every), V.keep_probability(C.word_counts(every).filter("n >= 5")))


@query("context_pairs", f"WITH {CORPUS} SELECT a.doc_id, a.sent_idx, a.pos, a.word AS centre, b.pos AS at, b.word AS context FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos")
def context_pairs(spark, sf_dir):
    return V.context_pairs(corpus(spark, sf_dir), window=2)


@query("context_pairs_dynamic", f"""WITH {CORPUS}, a AS (SELECT *, floor({UNIFORM.format('doc_id, sent_idx, pos')} * 5) + 1 AS radius FROM t)
SELECT a.doc_id, a.sent_idx, a.pos, a.word AS centre, b.pos AS at, b.word AS context FROM a JOIN t b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND b.pos BETWEEN a.pos - a.radius AND a.pos + a.radius AND b.pos <> a.pos""")
def context_pairs_dynamic(spark, sf_dir):
    return V.context_pairs(corpus(spark, sf_dir), window=5, dynamic=True)


@query("negative_samples", f"""WITH {CORPUS}, q AS (SELECT word, n ** 0.75 / sum(n ** 0.75) OVER () AS p FROM v),
b AS (SELECT word, p, coalesce(sum(p) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM q),
x AS (SELECT word AS id, word AS positive, unnest(range(1, 6)) AS draw FROM v), y AS (SELECT x.*, {UNIFORM.format('id, draw')} * (1 - b.p) AS u, b.lo, b.p FROM x JOIN b ON b.word = x.positive),
z AS (SELECT id, draw, positive, CASE WHEN u >= lo THEN u + p ELSE u END AS u FROM y)
SELECT id, draw::INT AS draw, positive, b.word AS negative FROM z ASOF JOIN b ON z.u >= b.lo""")
def negative_samples(spark, sf_dir):
    """Five negatives for every word: drawn as uniform numbers, the positive's own span cut out."""
    words = save(vocab(spark, sf_dir))
    return V.negatives(words.select(F.col("word").alias("id"), "word"), V.noise(words))


@query("sweep_grid", f"WITH {CORPUS} SELECT arch, dim, win, neg, sweep, (2 * win * (SELECT sum(n) FROM v))::BIGINT AS planned FROM {GRID}, (VALUES ('cbow'), ('skipgram')) a(arch)")
def sweep_grid(spark, sf_dir):
    """The runs of the sweep and the pairs that each plans for an epoch: two windows for each token of the vocabulary."""
    grid = spark.createDataFrame(sweep(), "arch string, dim int, win int, neg int, sweep string")
    tokens = vocab(spark, sf_dir).agg(F.sum("n").alias("tokens"))
    return grid.crossJoin(F.broadcast(tokens)).select("arch", "dim", "win", "neg", "sweep", (2 * F.col("win") * F.col("tokens")).alias("planned"))
