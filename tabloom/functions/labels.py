"""Row labels of printed tables: notes, statistics, qualifiers and units taken off the name."""

from __future__ import annotations

import re
from functools import lru_cache

from tabloom.functions.fold import bare, fold
from tabloom.functions.ngrams import edit_similarity, words

_NOTE = re.compile(r"[*†‡§¶#]+|(?<=[^\W_]|[)%.\]])\s+[a-c](?:\s*,\s*[a-c])*(?=\s*(?:$|[,(\[–:]))")
_STATISTIC = re.compile(
    r"[\s,–:-]*(?:\b(?:n|no\.?)\s*\(\s*%\s*\)|\b(?:mean|median)\b\s*(?:\(\s*(?:sd|iqr|se)\s*\)|±\s*s[de])?|\(\s*(?:yes|no|%)\s*\)|,\s*(?:yes|no\.?|n)|\bn)\s*$", re.I
)
_QUALIFIER = re.compile(r"[\s,–:-]*(?:\b(?:overall|at baseline)|(?<=[a-z.]) (?:patients|group))\s*$", re.I)
_PREFIX = re.compile(r"^\s*(?:self-reported|reported|baseline|patient|participants['’]?)\s+", re.I)


def _without(text: str, *patterns: re.Pattern[str]) -> str:
    while True:
        new = text
        for pattern in patterns:
            new = pattern.sub("", new).strip().rstrip(":,").strip()
        if new == text or not new:
            return text
        text = new


# Qualifiers that may be misspelt, at the end and at the beginning.
_LAST, _FIRST = ("patients", "group", "overall", "baseline"), ("reported", "self-reported", "baseline", "patient", "participants'")


def _without_misspelt(text: str) -> str:
    """A name of several words without a misspelt qualifier at either end."""
    parts = text.split()
    if len(parts) > 1 and max(edit_similarity(parts[-1].lower(), q) for q in _LAST) >= 0.7:
        parts = parts[:-1]
        while len(parts) > 1 and parts[-1].lower() in ("at", "–", "-"):
            parts = parts[:-1]
    if len(parts) > 1 and max(edit_similarity(parts[0].lower(), q) for q in _FIRST) >= 0.75:
        parts = parts[1:]
    return " ".join(parts).rstrip(":,–- ")


@lru_cache(maxsize=200_000)
def stages(label: str) -> tuple[str, str, str]:
    """The label in folded form, without note marks and statistics, and without qualifiers as well."""
    whole = " ".join(fold(label).replace("_", " ").split())
    if whole.startswith("(") and whole.endswith(")"):
        whole = whole[1:-1].strip()
    named = _without(whole, _NOTE, _STATISTIC)
    short = _without(named, _NOTE, _STATISTIC, _QUALIFIER)
    short = _PREFIX.sub("", _PREFIX.sub("", short)) or short
    return whole, named, _without_misspelt(short)


def stripped(label: str) -> str:
    return stages(label)[2]


def unit_tails(label: str) -> list[tuple[str, str]]:
    """(name, tail) ways to read the end of a stripped label as a unit, the longest tail last."""
    out = []
    text = stripped(label)
    for match in re.finditer(r"\s*[(\[]|\s*,\s*|\s+–\s+|\s+in\s+", text, re.I):
        tail = text[match.end() :].strip().rstrip(")]").strip()
        if tail and match.start():
            out.append((text[: match.start()].strip().rstrip(":,").strip(), tail))
    return out[::-1]


def variants(label: str, unit_like=None) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """Word lists under which a label may name its entry: all of them, the fullest first, and those worth a search.

    All: whole, step by step stripped, and without what its end says of a unit. A search needs the stripped ones only,
    without the unit if there is one.
    """
    lists = [words(bare(t)) for t in stages(label)]
    search = lists[1:]
    if unit_like is not None:
        named = [[words(bare(t)) for t in stages(name)] for name, tail in unit_tails(label) if unit_like(tail)]
        lists += [w for group in named for w in group]
        search = [w for group in named for w in group[1:]] or search
    return [tuple(w) for w in lists if w], list(dict.fromkeys(tuple(w) for w in search if w))
