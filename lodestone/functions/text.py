"""Normalising and tokenising, JVM-side; the twins give the same for one Python string."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Foldings and stop words that results must share.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "ae", "Ö": "oe", "Ü": "ue", "ß": "ss"}
ACCENTS = {"a": "áàâãå", "e": "éèêë", "i": "íìîï", "o": "óòôõø", "u": "úùû", "c": "ç", "n": "ñ"}
STOPWORDS = "der die das den dem des ein eine einen einem einer eines und oder mit ohne fuer von vom the and for with".split()
OPERATORS = '+-><()~*"@'

ACCENTED = "".join(ACCENTS.values())
PLAIN = "".join(c * len(group) for c, group in ACCENTS.items())
BOOST_LENGTH = 1024


def normalize(text: Column) -> Column:
    """Umlauts spelled out, lower case, accents folded, all but letters and digits one space, trimmed."""
    spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), UMLAUTS.items(), text)
    folded = F.translate(F.lower(spelled), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def normalized(text: str) -> str:
    for umlaut, letters in UMLAUTS.items():
        text = text.replace(umlaut, letters)
    text = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text)).strip()


def tokenize(text: Column, min_length: int = 2) -> Column:
    """Distinct words of the normalised text in their order, without stop words and short ones."""
    words = F.split(normalize(text), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*STOPWORDS)))


def tokens_of(text: str, min_length: int = 2) -> list[str]:
    return list(dict.fromkeys(w for w in normalized(text).split(" ") if w and len(w) >= min_length and w not in STOPWORDS))


def words(normal: Column) -> Column:
    """All words of a text that is normalised already."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def bucket(term: Column) -> Column:
    return F.substring(term, 1, 2)


def is_stopword(term: Column) -> Column:
    return term.isin(*STOPWORDS)


def strip_operators(text: Column) -> Column:
    """Full-text operator characters become spaces."""
    return F.translate(text, OPERATORS, " " * len(OPERATORS))


def operators_stripped(text: str) -> str:
    return text.translate(str.maketrans(OPERATORS, " " * len(OPERATORS)))


def strip_markup(text: Column) -> Column:
    """Tags go without a trace: words on either side are joined, entities stay."""
    return F.regexp_replace(text, "<[^>]*>", "")


def boost_text(title: Column, brand: Column, variant: Column, artnum: Column, ean: Column, mpn: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, brand, variant, artnum, ean, mpn)]
    return normalize(F.concat_ws(" ", *parts))


def search_text(boost: Column, paths: Column, values: Column, short: Column, long: Column) -> Column:
    """paths and values: arrays of strings. The boost text goes in whole."""
    parts = [boost, F.array_join(paths, " "), F.array_join(values, " "), F.coalesce(short, F.lit("")), strip_markup(F.coalesce(long, F.lit("")))]
    return normalize(F.concat_ws(" ", *parts))


def list_of(csv: str | None) -> list[str]:
    """A comma-separated list: trimmed, distinct, without blanks."""
    return list(dict.fromkeys(x.strip() for x in (csv or "").split(",") if x.strip()))


ID_SHAPE = re.compile(r"[a-zA-Z0-9_.-]{1,64}")


def is_id(value: object) -> bool:
    return isinstance(value, str) and ID_SHAPE.fullmatch(value) is not None
