"""Inputs that are no search terms: the first reason that fits, or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARACTERS = 80
SYMBOLS_FROM, SYMBOL_SHARE = 12, 0.4

# Reasons in the order in which they are asked, with the shapes that make them.
SHAPES: dict[str, list[str]] = {
    "markup": [r"(?i)<\s*[a-z!/?]", r"(?i)javascript\s*:", r"(?i)\bon(?:error|load|click|mouse\w+)\s*=", r"(?i)&#x?[0-9a-f]{2,};"],
    "sql": [
        r"(?i)\bunion\b[\s\S]{0,20}\bselect\b",
        r"(?i)\bselect\b[\s\S]{0,40}\bfrom\b",
        r"(?i)\b(?:insert\s+into|update\s+\w+\s+set|delete\s+from|drop\s+table)\b",
        r"(?i)\binformation_schema\b",
        r"(?i)\b(?:sleep|benchmark|extractvalue|updatexml|load_file)\s*\(",
        r"(?i)(?:'|\")\s*(?:or|and)\s+(?:\d+\s*=\s*\d+|'[^']*'\s*=)",
        r"(?:--|#|/\*)\s*$",
    ],
    "path": [r"\.\.[/\\]", r"(?i)/(?:etc|proc)/[a-z]", r"(?i)\b(?:php|file|data|expect)://"],
    "template": [r"\{\{.*\}\}", r"\$\{.*\}", r"<%.*%>", r"#\{.*\}"],
    "shell": [r"\$\(.*\)", r"`[^`]+`", r"(?i)[|;&]\s*(?:curl|wget|nc|bash|sh|python|powershell)\b"],
    "url": [r"(?i)\bhttps?://", r"(?i)\bwww\.[a-z0-9-]+\.[a-z]{2,}"],
}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def reason(term: Column) -> Column:
    """Why a raw term is no search, null if it is one (or blank)."""
    raw = F.trim(term, F.lit(" \t\n\r\x00\x0b"))
    length = F.length(raw)
    rest = F.length(F.regexp_replace(raw, r"[^\p{L}\p{N}\s]", ""))
    out = F.when(raw == "", F.lit(None).cast("string")).when(raw.rlike(CONTROL), "control").when(length > MOST_CHARACTERS, "length")
    for name, shapes in SHAPES.items():
        out = out.when(reduce(lambda a, b: a | b, (raw.rlike(s) for s in shapes)), name)
    return out.when((length >= SYMBOLS_FROM) & ((length - rest) / length > SYMBOL_SHARE), "symbols")
