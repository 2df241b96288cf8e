"""Synonym rules, compiled on the driver: a catalogue has few of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodestone.functions.text import list_of, tokens_of

LONGEST = 4


@dataclass(frozen=True)
class Rule:
    kind: str  # "both" or "oneway"
    term: str
    synonyms: str
    active: bool = True

    @property
    def complete(self) -> bool:
        return bool(self.term.strip()) and bool(list_of(self.synonyms))


Words = tuple[str, ...]


def _phrase(text: str) -> Words:
    return tuple(tokens_of(text, 1))


def _directed(names_of_rules: list[tuple[str, list]]) -> dict:
    """name -> names that stand for it, in the order of the rules; one-way rules lead from their first name alone.

    Takes (kind, names) pairs. The inner dict serves as a set that keeps its order.
    """
    pairs = [(a, b) for kind, names in names_of_rules for a in (names if kind == "both" else names[:1]) for b in names if a != b]
    out: dict = {a: {} for a, _ in pairs}
    for a, b in pairs:
        out[a][b] = None
    return {a: list(b) for a, b in out.items()}


def _in_use(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.active and r.complete]


class Expander:
    """Groups of alternatives for a token list: every group must match, any alternative of it may.

    All phrases that some rule knows make one pattern over the joined tokens, those of more words first, so a scan
    from the left covers the term with the longest known phrases and single words between them.
    """

    def __init__(self, rules: list[Rule]):
        folded = [(r.kind, _phrase(r.term), [_phrase(x) for x in list_of(r.synonyms)]) for r in _in_use(rules)]
        fit = [(kind, list(dict.fromkeys(p for p in (term, *others) if 1 <= len(p) <= LONGEST))) for kind, term, others in folded if 1 <= len(term) <= LONGEST]
        several = [(kind, names) for kind, names in fit if len(names) > 1]
        self.known = {word for _, names in several for phrase in names for word in phrase}
        self.others: dict[Words, list[Words]] = _directed(several)
        longest_first = sorted(self.others, key=len, reverse=True)
        self.pattern = re.compile("|".join([*(rf"(?<!\S){re.escape(' '.join(p))}(?!\S)" for p in longest_first), r"\S+"]))

    def expand(self, tokens: list[str]) -> list[list[Words]]:
        found = (tuple(x.split(" ")) for x in self.pattern.findall(" ".join(tokens)))
        return [[phrase, *self.others.get(phrase, [])] for phrase in found]


def exported(rules: list[Rule]) -> dict[str, list[str]]:
    """Term to replacements, lower-cased only; a two-way rule gives every direction."""
    return _directed([(r.kind, [x.strip().lower() for x in (r.term, *list_of(r.synonyms))]) for r in _in_use(rules)])


def covers(rules: list[Rule], term: str) -> bool:
    """Does a rule speak of the term: by its own term, or if it is two-way by a synonym."""
    spoken = {_phrase(x) for r in rules for x in (r.term, *(list_of(r.synonyms) if r.kind == "both" else ()))}
    return _phrase(term) in spoken


def to_edit(rules: list[Rule], handed: str = "") -> list[Rule]:
    """The rules an editor shows: those there are, and an empty one for a term handed over that none speaks of."""
    new = handed.strip()
    return [*rules, Rule("both", new, "")] if new and not covers(rules, new) else list(rules)
