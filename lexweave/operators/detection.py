"""Language detection: naive Bayes over character trigrams, counted from labelled texts.

Profiles are counted in Spark, cut to the most frequent trigrams of each
language, and so small that they travel with the tasks; texts are scored in Arrow
batches, as a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Trigrams kept of each language; with the languages, this bounds a model.
MOST = 2000


def letters_only(t: Column) -> Column:
    """Lower-cased alphabetic tokens, joined by blanks."""
    return F.array_join(X.alphabetic(F.lower(t)), " ")


def _trigrams(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the trigrams of code points of each text, blanks put at both ends; a code is three times 21 bits."""
    code = np.frombuffer("".join(f" {t} " if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = np.array([len(t) + 2 if t else 0 for t in texts], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.flatnonzero(row[:-2] == row[2:])
    return row[inside], (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[inside]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        for at in range(0, len(batch), 500):
            row, code = _trigrams(batch.column(1).slice(at, 500).to_pandas())
            of = np.asarray(lang.indices)[at : at + 500][row]
            if not len(code):
                continue
            order = np.lexsort((code, of))
            of, code = of[order], code[order]
            begins = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (code[1:] != code[:-1]))))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of[begins])), pa.array(code[begins]), pa.array(np.diff(np.append(begins, len(code))))], ["lang", "gram", "n"])


def profiles(texts: DataFrame, lang: str = "lang", text: str = "text", most: int = MOST) -> DataFrame:
    """(lang, gram, n, total): the ``most`` most frequent trigrams of each language, ties to the smaller code, and the count of all its trigrams."""
    rows = texts.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters_only(F.col(text)).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return counts.withColumn("total", total).withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "gram", "n", "total")


def detector(found: DataFrame) -> Callable[[Column], Column]:
    """A function of columns: the language of a text that ``letters_only`` made, the first of equals; null where it has no trigram of the profiles.

    A trigram of another language's profile counts as half an occurrence.
    """
    rows = found.collect()  # MOST for each language
    langs, grams = sorted({r.lang for r in rows}), np.array(sorted({r.gram for r in rows}), np.int64)
    counts, totals = np.zeros((len(grams) + 1, len(langs))), np.zeros(len(langs))
    for r in rows:
        counts[np.searchsorted(grams, r.gram), langs.index(r.lang)] = r.n
        totals[langs.index(r.lang)] = r.total
    scores = np.log((counts + 0.5) / (totals + 0.5 * len(grams)))
    scores[-1] = 0  # of trigrams in no profile

    @F.pandas_udf("string")
    def detected(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 500):
            part = texts.iloc[at : at + 500].fillna("")
            row, code = _trigrams(part)
            place = np.minimum(np.searchsorted(grams, code), max(0, len(grams) - 1))
            known = grams[place] == code if len(grams) else np.zeros(len(code), bool)
            begins = np.flatnonzero(np.diff(row[known], prepend=-1))
            total = np.zeros((len(part), max(1, len(langs))))
            if len(begins):
                total[row[known][begins]] = np.add.reduceat(scores[place[known]], begins)
            some = np.bincount(row[known], minlength=len(part)) > 0
            out += [langs[k] if ok else None for k, ok in zip(total.round(9).argmax(1), some)]
        return pd.Series(out, dtype=object)

    return detected


def is_english_sentence(t: Column, detected: Callable[[Column], Column], english: str = "en", least: int = 15) -> Column:
    """Blank: no.  No alphabetic token: yes.  ``least`` letters and blanks or more: what is detected.  Else, or if nothing is detected: mean length above 3.2."""
    words = letters_only(t)
    lang = detected(F.when(F.length(words) >= least, words))
    return (X.stripped(t) != "") & F.when(words == "", True).otherwise(F.coalesce(lang == english, X.is_english_sentence(t)))


def is_english_block(t: Column, detected: Callable[[Column], Column], english: str = "en", least: int = 20) -> Column:
    """The share and word rules of a PDF block; short words without a common one among them are decided by what is detected in texts of ``least`` characters."""
    words = letters_only(t)
    lang = detected(F.when(F.length(t) >= least, words))
    enough = F.coalesce(X.english_share(t) >= 0.8, F.lit(False)) & (words != "")
    return enough & (X.is_english_block(t) | F.coalesce(lang == english, F.lit(False)))
