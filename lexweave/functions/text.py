"""Text cleaning, language tests and tokenising as column expressions.

All of it stays inside generated JVM code: a document is one row, its lines,
sentences and tokens are arrays, and nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that mark places inside a text while it is worked on.
BREAK, DOT, OPEN, SHUT = "\uE000", "\uE001", "\uE002", "\uE003"
SPACE = r"[ \t\n\r\f\x0B\x{00A0}]"
SPACES = " \t\n\r\f\x0B\u00A0"
WORDCHAR = r"[\p{L}\p{N}_]"
#: A word boundary by its neighbours, the same in every engine and version.
EDGE = rf"(?:(?<={WORDCHAR})(?!{WORDCHAR})|(?<!{WORDCHAR})(?={WORDCHAR}))"

# Patterns and words of the cleaning rules.
URL = r"https?://[^ \t\n\r\f\x0B\x{00A0}]+|www\.[^ \t\n\r\f\x0B\x{00A0}]+"
EMAIL = r"[^ \t\n\r\f\x0B\x{00A0}]+@[^ \t\n\r\f\x0B\x{00A0}]+\.[^ \t\n\r\f\x0B\x{00A0}]+"
ENTITY = r"&[a-z]+;"
PHONE = r"[0-9 \t\n\r\f\x0B\x{00A0}()-]{7,}"
TAG = r"<[^>]+>"
_DOT = rf"{SPACE}*(?:\[dot\]|dot){SPACE}*"
HIDDEN_EMAIL = rf"(?i)({WORDCHAR}+(?:{_DOT}{WORDCHAR}+)*){SPACE}*(?:\[at\]|at){SPACE}*{WORDCHAR}+{_DOT}{WORDCHAR}+(?:{_DOT}{WORDCHAR}+)*"
DIVIDER = r"^[^\p{L}\p{N}]+$"
#: One of these is in every text, lower-cased, that a boilerplate pattern finds, but for the last pattern.
BOILERPLATE_MARKS = ("copyright", "this portal is owned", "last updated", "web information manager", "institute repository")
BOILERPLATE = (
    r"copyright.*all rights reserved",
    r"this portal is owned.*designed.*developed",
    r"last updated[ \t]*:?[ \t]*[0-9]",
    r"web information manager",
    r"institute repository",
    r"^(home|about|contact|login|logout|search|menu|skip to)$",
)
COMMON_WORDS = (
    "the of and in to for is are on at by an as be it or from with this that not was has have may will its all but "
    "phd mtech btech department research student professor course exam semester india"
).split()
PROVENANCE = ("SOURCE_URL:", "SOURCE_PDF:")
TOKEN = "^[a-z][a-z0-9]+$"
SPLIT = r"""[ \t\n\r\f\x0B\x{00A0}\[\](){}<>,;:"?!&@#$%]+"""


def let(t: Column, f) -> Column:
    """``f(t)`` with ``t`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(t), f), 1)


def replaced(t: Column, pattern: str, to: str, *marks: str) -> Column:
    """``regexp_replace`` where one of ``marks`` is in the text, without which the pattern finds nothing; a search for a word is far cheaper."""

    def found(x: Column) -> Column:
        held = F.contains(x, F.lit(marks[0]))
        for mark in marks[1:]:
            held = held | F.contains(x, F.lit(mark))
        return F.when(held, F.regexp_replace(x, pattern, to)).otherwise(x)

    return let(t, found)


def lines(t: Column) -> Column:
    return F.split(t, "\n")


def stripped(t: Column) -> Column:
    return F.btrim(t, F.lit(SPACES))


def letters(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^\p{L}]", ""))


def english_share(t: Column) -> Column:
    """Share of A-Z among the letters; null without letters."""
    return F.try_divide(F.length(F.regexp_replace(t, "[^A-Za-z]", "")), letters(t))


def is_english(t: Column, over: float = 0.85) -> Column:
    return F.coalesce(english_share(t) > over, F.lit(False))


def alphabetic(t: Column) -> Column:
    """Whitespace-separated pieces made of letters alone."""
    return F.filter(F.split(t, rf"{SPACE}+"), lambda x: x.rlike(r"^\p{L}+$"))


def mean_length(words: Column) -> Column:
    return F.try_divide(F.length(F.array_join(words, "")), F.size(words))


def is_english_block(t: Column, least: float = 0.8) -> Column:
    words = F.transform(alphabetic(t), F.lower)
    common = F.arrays_overlap(words, F.array(*map(F.lit, COMMON_WORDS)))
    return F.coalesce(english_share(t) >= least, F.lit(False)) & (F.size(words) > 0) & F.coalesce((mean_length(words) > 3.2) | common, F.lit(False))


def is_english_sentence(t: Column) -> Column:
    return (stripped(t) != "") & let(alphabetic(t), lambda words: (F.size(words) == 0) | F.coalesce(mean_length(words) > 3.2, F.lit(False)))


def without_provenance(t: Column) -> Column:
    return F.array_join(F.filter(lines(t), lambda x: ~(x.startswith(PROVENANCE[0]) | x.startswith(PROVENANCE[1]))), "\n")


def without_urls(t: Column) -> Column:
    return replaced(t, URL, " ", "://", "www.")


def join_hidden_emails(t: Column) -> Column:
    """``a dot b at host dot tld`` becomes ``ab``: matches are marked, then the dots go between the marks only.  Texts without a "dot" are passed by."""

    def joined(x: Column) -> Column:
        marked = F.split(F.regexp_replace(x, HIDDEN_EMAIL, f"{OPEN}$1{SHUT}"), f"[{OPEN}{SHUT}]")
        return F.array_join(F.transform(marked, lambda y, k: F.when(k % 2 == 1, F.regexp_replace(y, f"(?i){_DOT}", "")).otherwise(y)), "")

    return let(t, lambda x: F.when(x.rlike("(?i)dot"), joined(x)).otherwise(x))


def without_emails(t: Column) -> Column:
    return replaced(t, EMAIL, " ", "@")


def without_entities(t: Column) -> Column:
    return replaced(t, ENTITY, " ", "&")


def without_phones(t: Column) -> Column:
    """Runs of seven or more digits, blanks, hyphens and brackets between word boundaries; texts without such a run are passed by."""
    return let(t, lambda x: F.when(x.rlike(PHONE), F.regexp_replace(x, rf"{EDGE}\+?{PHONE}{EDGE}", " ")).otherwise(x))


def without_tags(t: Column) -> Column:
    return replaced(t, TAG, " ", "<")


def is_boilerplate(line: Column) -> Column:
    """Whether a pattern finds something in the stripped line."""

    def found(x: Column) -> Column:
        marked = x.rlike("(?i)" + BOILERPLATE[-1])
        for mark in BOILERPLATE_MARKS:
            marked = marked | F.contains(F.lower(x), F.lit(mark))
        return marked & x.rlike("(?i)" + "|".join(BOILERPLATE))

    return let(stripped(line), found)


def without_dividers(t: Column) -> Column:
    """Without boilerplate lines and lines that hold neither letter nor number but something else than blanks."""
    return F.array_join(F.filter(lines(t), lambda line: ~(stripped(line).rlike(DIVIDER) | is_boilerplate(line))), "\n")


def collapse_punctuation(t: Column) -> Column:
    t = replaced(t, r"[.]{3,}", ".", "...")
    t = replaced(t, r"-{3,}", " ", "---")
    t = replaced(t, r"_{3,}", " ", "___")
    return replaced(t, r"[*]{2,}", " ", "**")


def plain_spaces(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("\u00A0"), F.lit(" ")), F.lit("\u200B"), F.lit(""))


def clean(t: Column, hidden_emails: bool = True, phones: bool = True) -> Column:
    """The whole chain, in order."""
    t = without_urls(without_provenance(t))
    t = join_hidden_emails(t) if hidden_emails else t
    t = without_entities(without_emails(t))
    t = without_phones(t) if phones else t
    return plain_spaces(collapse_punctuation(without_dividers(without_tags(t))))


def clean_pdf(t: Column) -> Column:
    t = F.regexp_replace(F.translate(t, "\f", "\n"), "\n{3,}", "\n\n")
    return stripped(F.regexp_replace(t, "[ \t]{2,}", " "))


def distinct_lines(t: Column) -> Column:
    """Lines without blanks, the first of each stripped line kept as it was."""
    none = F.array().cast("array<string>")
    kept = F.filter(lines(t), lambda x: stripped(x) != "")

    def add(held: Column, x: Column) -> Column:
        new = F.struct(F.array_append(held["keys"], stripped(x)).alias("keys"), F.array_append(held["lines"], x).alias("lines"))
        return F.when(F.array_contains(held["keys"], stripped(x)), held).otherwise(new)

    return F.array_join(F.aggregate(kept, F.struct(none.alias("keys"), none.alias("lines")), add, lambda held: held["lines"]), "\n")


def distinct_stripped_lines(t: Column) -> Column:
    """The same with the lines stripped: one hash pass, for where outer blanks do not matter."""
    return F.array_join(F.array_distinct(F.filter(F.transform(lines(t), stripped), lambda x: x != "")), "\n")


def sentences(t: Column) -> Column:
    """Split after . ! ? and blanks before a capital or digit, but not after a single capital; a newline alone ends nothing."""
    t = F.regexp_replace(t, r"(?<=[A-Z])(?<![A-Za-z0-9_][A-Z])\.", DOT)
    t = F.regexp_replace(t, r"(?<=[.!?])[ \n\t]+(?=[A-Z0-9])", BREAK)
    return F.transform(F.split(t, BREAK), lambda x: F.replace(x, F.lit(DOT), F.lit(".")))


def tokens(t: Column) -> Column:
    pieces = F.transform(F.split(t, SPLIT), lambda x: F.lower(F.trim(x, F.lit(".'`"))))
    return F.filter(pieces, lambda x: x.rlike(TOKEN))


def table_sentences(rows: Column) -> Column:
    """Rows of cells to lines: cells stripped, blanks dropped, at least two left."""
    cells = F.transform(rows, lambda r: F.filter(F.transform(r, stripped), lambda c: F.coalesce(c != "", F.lit(False))))
    return F.transform(F.filter(cells, lambda r: F.size(r) >= 2), lambda r: F.array_join(r, " "))


#: The rewriting steps of Penn Treebank tokenising, in order: opening quotes, punctuation, final period, brackets, dashes, closing quotes, clitics.
TREEBANK = (
    (r'^"', "`` "), ("(``)", " $1 "), (r"""([ (\[{<])("|'')""", "$1 `` "),
    ("([:,])([^0-9])", " $1 $2"), (r"([:,])\z", " $1 "), ("[.][.][.]", " ... "), ("([;@#$%&])", " $1 "),
    (r"""([^.])([.])([\])}>"']*)[ \t\n\r]*\z""", "$1 $2$3 "), ("([?!])", " $1 "), ("([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "), ("--", " -- "), (r"\z", " "), ("^", " "),
    ('"', " '' "), (r"([^ \t\n\r])('')", "$1 $2 "), ("([^' ])('[sSmMdD]|') ", "$1 $2 "), ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
)
#: Words that are two, and where the second begins.
CONTRACTIONS = {"cannot": 4, "d'ye": 2, "gimme": 4, "gonna": 4, "gotta": 4, "lemme": 4, "more'n": 5, "wanna": 4, "'tis": 3, "'twas": 3}


def treebank_tokens(sentence: Column) -> Column:
    """Penn Treebank tokens of a sentence: clitics, brackets, quotes and the final period come off, inner hyphens and periods stay."""
    for pattern, to in TREEBANK:
        sentence = F.regexp_replace(sentence, pattern, to)

    def parts(x: Column) -> Column:
        low, out = F.lower(x), F.array(x)
        for word, at in CONTRACTIONS.items():
            out = F.when(low == word, F.array(F.substring(x, 1, at - 1), F.substring(x, at, 99))).otherwise(out)
        return out

    return F.flatten(F.transform(F.filter(F.split(sentence, r"[ \t\n\r\f\x0B]+"), lambda x: x != ""), parts))


def valid_tokens(words: Column) -> Column:
    """Lower-cased words that begin with a letter of a-z and go on with such letters or digits."""
    return F.filter(F.transform(words, F.lower), lambda x: x.rlike(TOKEN))
