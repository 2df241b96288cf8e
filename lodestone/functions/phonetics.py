"""Cologne phonetics: each letter, seen with its original neighbours, becomes digits.

One table of rules serves the word, the Column and the SQL of the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the order of the rules: letters, what must stand ahead (None: anything, "": no letter a to z),
# what must follow (None: anything), and the code.
RULES: list[tuple[str, str | None, str | None, str]] = [
    ("aeijouy", None, None, "0"),
    ("b", None, None, "1"),
    ("p", None, "h", "3"),
    ("p", None, None, "1"),
    ("dt", None, "csz", "8"),
    ("dt", None, None, "2"),
    ("fvw", None, None, "3"),
    ("gkq", None, None, "4"),
    ("c", "", "ahkloqrux", "4"),
    ("c", "", None, "8"),
    ("c", "sz", None, "8"),
    ("c", None, "ahkoqux", "4"),
    ("c", None, None, "8"),
    ("x", "ckq", None, "8"),
    ("x", None, None, "48"),
    ("l", None, None, "5"),
    ("mn", None, None, "6"),
    ("r", None, None, "7"),
    ("sz", None, None, "8"),
]


def _code(before: str, here: str, after: str) -> str:
    for letters, ahead, follow, code in RULES:
        fits = ahead is None or (before in ahead and before != "" if ahead else not "a" <= before <= "z")
        if here in letters and fits and (follow is None or (after != "" and after in follow)):
            return code
    return ""


def encoded(word: str) -> str:
    """Code of one normalised word: runs of a digit are one, and 0 stays only in front."""
    raw = "".join(_code(word[i - 1 : i] if i else "", c, word[i + 1 : i + 2]) for i, c in enumerate(word))
    once = "".join(c for i, c in enumerate(raw) if not i or raw[i - 1] != c)
    return once[:1] + once[1:].replace("0", "")


def encode(word: Column) -> Column:
    """The same as a Column."""

    def letter(i: Column) -> Column:
        here = F.substring(word, i, F.lit(1))
        before = F.when(i > 1, F.substring(word, i - 1, F.lit(1))).otherwise("")
        after = F.substring(word, i + 1, F.lit(1))
        cases = []
        for letters, ahead, follow, code in RULES:
            fits = [here.isin(*letters)]
            if ahead is not None:
                fits.append(before.isin(*ahead) if ahead else ~before.between("a", "z"))
            if follow is not None:
                fits.append(after.isin(*follow))
            cases.append((reduce(lambda a, b: a & b, fits), code))
        (first, code), *others = cases
        return reduce(lambda out, c: out.when(*c), others, F.when(first, code)).otherwise("")

    raw = F.array_join(F.transform(F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>")), letter), "")
    once = F.regexp_replace(raw, r"(.)\1+", "$1")
    return F.concat(F.substring(once, 1, 1), F.replace(F.substring(once, 2, 1_000_000), F.lit("0"), F.lit("")))
