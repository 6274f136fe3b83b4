"""The cleaning chain over whole tables, against Python beside the SQL."""

import re

import __spark_entry__ as entry
from lexweave import registry
from lexweave.operators import corpus as C
from lexweave.operators import training as T
from lexweave.plans import models
from lexweave.plans.cleaning import QUIRKS

from .conftest import SMALL

PHONE = re.compile(r"\b\+?[0-9 \t\n\r\f\x0b\u00a0()-]{7,}\b")


def texts(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in documents} | {-k - 1: x for k, x in enumerate(QUIRKS)}


def test_phones_of_every_text(spark):
    every = texts(spark)
    assert any(not x.isascii() for x in every.values() if x)
    got = {r.doc_id: r.out for r in entry.queries()["clean_phones"](spark, SMALL).collect()}
    assert got == {k: None if x is None else PHONE.sub(" ", x) for k, x in every.items()}


URL = re.compile(r"https?://[^ \t\n\r\f\x0b\u00a0]+|www\.[^ \t\n\r\f\x0b\u00a0]+")
S = "[ \t\n\r\f\x0b\u00a0]"
DOT = rf"{S}*(?:\[dot\]|dot){S}*"
HIDDEN = re.compile(rf"(?i)(\w+(?:{DOT}\w+)*){S}*(?:\[at\]|at){S}*\w+{DOT}\w+(?:{DOT}\w+)*")
BOILER = re.compile(
    r"(?i)copyright.*all rights reserved|this portal is owned.*designed.*developed|last updated[ \t]*:?[ \t]*[0-9]|web information manager|institute repository"
    r"|^(home|about|contact|login|logout|search|menu|skip to)$"
)


def cleaned(t):
    t = "\n".join(x for x in t.split("\n") if not x.startswith(("SOURCE_URL:", "SOURCE_PDF:")))
    t = HIDDEN.sub(lambda m: re.sub(f"(?i){DOT}", "", m[1]), URL.sub(" ", t))
    t = re.sub("[^ \t\n\r\f\x0b\u00a0]+@[^ \t\n\r\f\x0b\u00a0]+\\.[^ \t\n\r\f\x0b\u00a0]+", " ", t)
    t = re.sub("<[^>]+>", " ", PHONE.sub(" ", re.sub("&[a-z]+;", " ", t)))
    bare = [(x, x.strip(" \t\n\r\f\x0b\u00a0")) for x in t.split("\n")]
    t = "\n".join(x for x, y in bare if not (y and not any(c.isalpha() or c.isnumeric() for c in y)) and not BOILER.search(y))
    for pattern, to in ((r"[.]{3,}", "."), ("-{3,}", " "), ("_{3,}", " "), (r"[*]{2,}", " ")):
        t = re.sub(pattern, to, t)
    return t.replace("\u00a0", " ").replace("\u200b", "")


def test_whole_chain(spark):
    got = {r.doc_id: r.out for r in entry.queries()["clean_text"](spark, SMALL).collect()}
    assert got == {k: None if x is None else cleaned(x) for k, x in texts(spark).items()}


def test_corpus_queries_have_the_whole_chain(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = C.sentences(documents).select("doc_id", "sent_idx", "key").collect()
    assert sorted(registry.QUERIES["doc_sentences"](spark, SMALL).collect()) == sorted(want)
    merged = spark.createDataFrame([(1, "A line of words here" + "\n" * 8 + "Another line of words")], "doc_id long, text string")
    assert [r.key for r in C.sentences(merged).collect()] == ["line of words here another line of words"]
    assert sorted(r.n for r in registry.QUERIES["word_count"](spark, SMALL).collect()) == sorted(r.n for r in C.word_counts(C.unique_sentences(C.sentences(documents))).collect())


def test_training_learns_from_the_whole_chain(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "train", lambda sents, vocab, arch, **options: seen.append(sorted(r.key for r in sents.collect())) or (None, [0.0]))
    models.train_cbow(spark, SMALL)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert seen == [sorted(r.key for r in C.unique_sentences(C.sentences(documents)).collect())]
