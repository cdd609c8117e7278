"""Visually identical text with different characters, brought to one consistent form.

A mapping from grapheme clusters to plain ones is precomputed for widths, spaces, invisible characters, letters with any
number of combining accents in any order, ligatures and look-alikes, checked for conflicts, and compiled into one
longest-match transducer that reads a text once. Longer entries keep characters that are meant: a Greek designation before a hyphen (beta-blocker) is a longer
match than the look-alike capital alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.fold import HYPHENS, INVISIBLE, LOOKALIKES, SPACES, WIDE

# Greek letters that name a substance, a drug class or a particle when a hyphen follows.
DESIGNATIONS = "ΑΒΓΔαβγδ"
#: Ranges whose compatibility forms are only another way to print plain letters and digits.
_COMPATIBLE = [(0x2160, 0x2180), (0xFB00, 0xFB07), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x24B6, 0x24EA), (0x3300, 0x3400), (0x2100, 0x2114)]
# Of these ranges, signs that are meant.
_MEANT = "℃℉№℅℆℀℁"


def _composed() -> Iterator[int]:
    """Letters and signs of the alphabets that have a canonical decomposition."""
    for low, high in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2126, 0x212C), (0x374, 0x388)):
        yield from (c for c in range(low, high) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<"))


def build_mapping() -> dict[str, str]:
    """Cluster to plain cluster. Raises ValueError if two rules disagree or a result would be mapped again."""
    mapping: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if mapping.setdefault(source, target) != target:
            raise ValueError(f"two targets for {source!r}: {mapping[source]!r} and {target!r}")

    for c in INVISIBLE:
        add(c, "")
    for c in SPACES:
        add(c, " ")
    for c in HYPHENS:
        add(c, "-")
    for code in range(0x21, 0x7F):
        add(chr(code + WIDE), chr(code))
    for low, high in _COMPATIBLE:
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKC", c)
            if c not in mapping and c not in _MEANT and plain != c and plain.isascii():
                add(c, plain)
    for source, target in LOOKALIKES.items():
        add(source, target)
    written: dict[str, list[str]] = defaultdict(list)
    for source, target in mapping.items():
        if len(source) == 1 and len(target) == 1 and target.isalpha():
            written[target].append(source)
    native: dict[str, str] = {}
    for c in map(chr, _composed()):
        plain = unicodedata.normalize("NFC", c)
        if len(plain) == 1 and plain != c and c not in mapping:  # one character, listed twice
            add(c, plain)
        letter, *marks = unicodedata.normalize("NFD", c)
        if plain != c or not marks:
            continue
        for order in set(permutations(marks)):
            typed = letter + "".join(order)
            if unicodedata.normalize("NFC", typed) != c:  # marks of one class keep their order
                continue
            for k in range(len(order)):  # any of the first marks may be in the letter already
                head = unicodedata.normalize("NFC", typed[: 1 + k])
                if len(head) == 1:
                    native[head + typed[1 + k :]] = c
            for first in written[letter]:
                add(first + typed[1:], c)
    for source, target in native.items():  # a look-alike with an accent is the letter that it looks like
        mapping.setdefault(source, target)
    again = [s for s, t in mapping.items() if any(c in mapping for c in t)]
    if again:
        raise ValueError(f"targets that are mapped again: {again[:5]}")
    return mapping


class Transducer:
    """The compiled mapping: ``apply`` gives the plain form of a text in one pass, the longest entry first."""

    def __init__(self) -> None:
        self.mapping = build_mapping()
        singles = "".join(sorted(c for c in self.mapping if len(c) == 1))
        letters = "".join(sorted({c[0] for c in self.mapping if len(c) > 1}))
        marks = "".join(sorted({m for c in self.mapping for m in c[1:]}))
        # A designation at the start of a word stands; a word written wholly in a look-alike's own script stands, too.
        self._pattern = re.compile(
            rf"(?P<meant>(?<![^\W\d_])[{DESIGNATIONS}](?=[-‐‑－][^\W\d_]))|(?<![^\W\d_])(?P<own>(?:[Ѐ-ӿ][{marks}]*){{2,}}|(?:[Ͱ-Ͽ][{marks}]*){{2,}})(?![^\W\d_])"
            rf"|(?P<hangul>[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2])"
            rf"|[{re.escape(letters)}][{marks}]+|[{re.escape(singles)}]"
        )
        self._cluster = re.compile(rf"[{re.escape(letters)}][{marks}]+|.", re.S)
        self._alike = frozenset(LOOKALIKES)
        #: Characters without which a text can't change.
        self.trigger = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in singles + marks) + "\\x{1161}-\\x{1175}\\x{11a8}-\\x{11c2}]"

    def _mapped(self, cluster: str) -> str:
        """The longest beginning that has an entry, mapped; marks that go with no letter stay."""
        for n in range(len(cluster), 0, -1):
            if cluster[:n] in self.mapping:
                return self.mapping[cluster[:n]] + cluster[n:]
        return cluster

    def _one(self, match: re.Match[str]) -> str:
        text = match.group()
        if match.lastgroup == "meant":
            return text
        if match.lastgroup == "hangul":
            return unicodedata.normalize("NFC", text)
        if match.lastgroup == "own":  # look-alikes only: a Latin word in disguise; else a word of that script, with its accents composed
            clusters = self._cluster.findall(text)
            return "".join(map(self._mapped, clusters)) if all(c[0] in self._alike for c in clusters) else unicodedata.normalize("NFC", text)
        return self._mapped(text)

    def apply(self, text: str) -> str:
        return self._pattern.sub(self._one, text)


def canonical_text(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``keep``, ``text``, ``canonical``, ``changed``: one per row of ``df``, repeats included.

    canonical displays like text in plain characters; accents, meant Greek letters, dashes and table symbols stay, as do
    ordinary spaces, line breaks and case. Null gives null and not changed; an empty text stays empty. A word in
    Cyrillic or Greek that has letters without a Latin double stays.
    """
    kinds = [(k, df.schema[k].dataType) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer()
        for batch in batches:
            text = batch.column("canonical_source")
            may = pc.fill_null(pc.match_substring_regex(text, transducer.trigger), False)
            found = pc.indices_nonzero(may)
            new = pa.array([transducer.apply(t) for t in text.take(found).to_pylist()], pa.string())
            canonical = pc.replace_with_mask(text.cast(pa.string()), may, new)
            changed = pc.fill_null(pc.not_equal(text, canonical), False)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), text, canonical, changed], names=[*keep, "text", "canonical", "changed"])

    schema = ", ".join([*(f"`{k}` {t.simpleString()}" for k, t in kinds), "text string, canonical string, changed boolean"])
    return df.select(*[F.col(k) for k in keep], F.col(text_col).alias("canonical_source")).mapInArrow(run, schema)
