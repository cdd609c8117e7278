"""One plain form of text for comparisons: widths, spaces, invisible characters and look-alikes."""

from __future__ import annotations

import unicodedata

# Characters that show nothing.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
# Spaces other than the ordinary one.
SPACES = "               　"
# Hyphens that look like the ordinary one.
HYPHENS = "‐‑"
# Cyrillic letters that look like Latin ones, and the Latin ones.
CYRILLIC = "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝһ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXYaesijopcyxdqwh"
# Greek letters that look like Latin ones, and the Latin ones.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXovcj"
#: Fullwidth forms lie this far above ASCII.
WIDE = 0xFEE0

LOOKALIKES = dict(zip(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN, strict=True))

_TABLE: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
_TABLE |= {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
_TABLE |= {c + WIDE: chr(c) for c in range(0x21, 0x7F)} | {ord(k): v for k, v in LOOKALIKES.items()}


def fold(text: str) -> str:
    """Same look in plain characters; line breaks and case stay. For comparison, not for display."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_TABLE))


def bare(text: str) -> str:
    """Folded, without accents, in lower case, with single spaces."""
    folded = fold(text)
    if not folded.isascii():
        folded = "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))
    return " ".join(folded.split()).lower()
