"""Evaluation texts leaking into training text: Wu-Manber search for many strings at once.

The test strings are windows of fixed length at each word of each evaluation text, in a plain form (lower case, no marks
and accents, one space between words, signs of scripts without spaces as words of their own). A table of shifts by block,
sized to the strings, skips places where no string can end; where the shift is zero, the bucket of the block's hash, the
strings' last bytes, selects candidates, which are compared directly. Texts shorter than a window are searched in the
same way with shorter windows. The search runs over the byte buffer of a whole batch with many cursors in step. Strings
found give word offsets between document and item; the item's words are then compared along these offsets.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.runtime import reference_rows

#: Bytes of a test string, and (string, block) bytes for items that are shorter than one.
WINDOW, BLOCK, SHORTER = 24, 8, ((16, 8), (8, 4), (4, 2), (2, 2))
#: Bytes between neighbouring cursors, evaluation texts that a task may hold, and strings searched for in one pass.
STRIDE, MAX_ITEMS, STRINGS = 2048, 100_000, 1_000_000
#: Share of equal words within a running passage, and share of the item that the passage must cover.
ALIKE, COVER = 0.8, 1 / 3
#: Offsets that differ by at most so many words are one passage with words put in or left out.
DRIFT = 3

# Scripts written without spaces, whose signs count as words.
_SPACELESS = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MARKS = re.compile(r"[^\w\s]+|_")
_BLANKS = re.compile(r"\s+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0
for _c in b" \t\n\r\f\v\x1c\x1d\x1e\x1f":
    _FOLD[_c] = 32
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32


@lru_cache(maxsize=None)
def _plain_sign(sign: str) -> str:
    """What stands for a character beyond ASCII: its letters in lower case without accents, or nothing for a mark."""
    return _BLANKS.sub(" ", _SPACELESS.sub(r" \1 ", _MARKS.sub("", unicodedata.normalize("NFKD", sign.casefold()))))


class _Signs(dict):
    def __missing__(self, code: int) -> str | int:
        self[code] = _plain_sign(chr(code)) if code > 127 else code
        return self[code]


_SIGNS = _Signs()


def _plain_text(text: str) -> str:
    """The text with what the byte table can't fold in plain form."""
    if text.isascii():
        return text
    signs = [c for c in set(text) if c > "\x7f"]
    if len(signs) > 30:
        return text.translate(_SIGNS)
    for c in signs:
        text = text.replace(c, _plain_sign(c))
    return text


def plain(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of the texts in one buffer, each led by one space, and their offsets; a space and 8 spare bytes follow."""
    encoded = [b" " + _plain_text(t).encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(e) for e in encoded]))).astype(np.int64)
    folded = _FOLD[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
    kept = np.flatnonzero(folded)
    values = folded[kept]
    double = np.zeros(len(values), dtype=bool)
    double[1:] = (values[1:] == 32) & (values[:-1] == 32)
    starts = np.searchsorted(kept, offsets[:-1])
    double[starts] = False
    kept, values = kept[~double], values[~double]
    return np.concatenate((values, np.array([32] + [0] * 8, dtype=np.uint8))), np.searchsorted(kept, offsets)


def _words64(buffer: np.ndarray) -> np.ndarray:
    return np.ndarray((max(0, len(buffer) - 7),), dtype="<u8", buffer=buffer, strides=(1,))


class Strings:
    """Shift table and buckets of test strings of one length, given by their places in a buffer."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, item: np.ndarray, word: np.ndarray, window: int, block: int):
        self.window, self.block = window, block
        self._mask = np.uint64((1 << 8 * block) - 1)
        view = _words64(buffer)
        parts = self._parts(view, start)
        order = np.lexsort(parts)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([p[order][1:] != p[order][:-1] for p in parts], axis=0)
        #: Where in ``item`` and ``word`` each distinct string's occurrences begin.
        self.item, self.word, self.first = item[order], word[order], np.append(np.flatnonzero(new), len(order))
        heads = order[new]
        entries = len(heads) * (window - block + 1)
        self.bits = min(26, max(12, int(entries).bit_length() + 2))
        suffix = self._hash(view[start[heads] + window - block])
        by_suffix = np.argsort(suffix, kind="stable")
        self.string, self.suffix = by_suffix, suffix[by_suffix]
        self.parts = [p[heads] for p in parts]
        self.shift = np.full(1 << self.bits, window - block + 1, dtype=np.uint8)
        for k in range(window - block + 1):  # from far to near: the smallest shift stays
            self.shift[self._hash(view[start[heads] + k])] = window - block - k

    def _parts(self, view: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        if self.window >= 8:
            return [view[at + k] for k in range(0, self.window, 8)]
        return [view[at] & np.uint64((1 << 8 * self.window) - 1)]

    def _hash(self, words: np.ndarray) -> np.ndarray:
        return ((words & self._mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, occurrence of a test string) of every occurrence in the buffer."""
        last = len(buffer) - 8 - self.window
        none = np.zeros(0, dtype=np.int64)
        if last < 0:
            return none, none
        view = _words64(buffer)
        pos = np.arange(0, last + 1, STRIDE, dtype=np.int64)
        stop = np.minimum(pos + STRIDE, last + 1)
        hits = []
        while len(pos):
            step = self.shift[self._hash(view[pos + (self.window - self.block)])]
            zero = step == 0
            if zero.any():
                hits.append(pos[zero])
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        place = np.concatenate(hits) if hits else none
        place = place[buffer[place] == 32]
        suffix = self._hash(view[place + self.window - self.block])
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        where, at = _expanded(place, low, high - low)
        string = self.string[at]
        same = np.ones(len(string), dtype=bool)
        for own, there in zip(self.parts, self._parts(view, where)):
            same &= own[string] == there
        where, string = where[same], string[same]
        return _expanded(where, self.first[string], self.first[string + 1] - self.first[string])


def _expanded(values: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value as often as ``many`` says, with the numbers from ``low`` on."""
    return np.repeat(values, many), np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


class WuManber:
    """The test strings of all items: every word-aligned window of those that hold one, the beginning of shorter ones."""

    def __init__(self, items: Sequence[str], strings: int = STRINGS):
        buffer, offsets = plain(items)
        self.words = [bytes(buffer[offsets[i] : offsets[i + 1]]).split() for i in range(len(items))]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for words in self.words for w in words))}
        self.codes = [np.array([self.vocabulary[w] for w in words], dtype=np.int32) for words in self.words]
        spaces = np.flatnonzero(buffer == 32)
        spaces = spaces[spaces < offsets[-1]]
        item = np.searchsorted(offsets, spaces, side="right") - 1
        word = np.arange(len(spaces)) - np.searchsorted(spaces, offsets[item])
        fits = spaces + WINDOW <= offsets[item + 1]
        #: Items without a window of full length: held only whole.
        self.short = np.ones(len(items), dtype=bool)
        self.short[item[fits]] = False
        self.searches = []
        for at in range(0, int(fits.sum()), strings):
            rows = np.flatnonzero(fits)[at : at + strings]
            self.searches.append(Strings(buffer, spaces[rows], item[rows], word[rows], WINDOW, BLOCK))
        # a short item's length counts the space that follows it
        size = np.diff(offsets) + 1
        left = np.flatnonzero(self.short & (np.diff(offsets) > 1))
        for window, block in SHORTER:
            rows = left[size[left] >= window]
            left = left[size[left] < window]
            if len(rows):
                self.searches.append(Strings(buffer, offsets[rows], rows, np.zeros(len(rows), dtype=np.int64), window, block))

    def find(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, word of the item, length) of every test string in the buffer."""
        found = [(place, s.item[n], s.word[n], np.full(len(place), s.window)) for s in self.searches for place, n in [s.find(buffer)]]
        return tuple(np.concatenate(column) for column in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 4


def longest_passage(equal: np.ndarray, alike: float = ALIKE) -> int:
    """Words of the longest stretch that begins and ends with an equal word and of which ``alike`` are equal."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0
    lead = np.arange(len(at)) - alike * at
    # the first equal word from which on the share holds: the running minimum falls, so it is found by bisection
    lowest = np.minimum.accumulate(lead)
    begin = np.searchsorted(-lowest, -(lead + 1 - alike + 1e-9))
    return int((at - at[begin] + 1).max())


def search_batch(texts: Sequence[str], matcher: WuManber, cover: float = COVER) -> list[tuple[int, int, int]]:
    """(text, item, words covered) of the passages found that cover a share ``cover`` of the item."""
    buffer, offsets = plain(texts)
    place, item, word, size = matcher.find(buffer)
    doc = np.searchsorted(offsets, place, side="right") - 1
    inside = (doc < len(texts)) & (place + size <= offsets[np.minimum(doc, len(texts) - 1) + 1] + 1)
    place, item, word, doc = place[inside], item[inside], word[inside], doc[inside]
    spaces = np.flatnonzero(buffer == 32)
    offset = np.searchsorted(spaces, place) - np.searchsorted(spaces, offsets[doc]) - word
    found: dict[tuple[int, int], set[int]] = defaultdict(set)
    for d, i, o in zip(doc.tolist(), item.tolist(), offset.tolist()):
        found[d, i].add(o)
    out, coded = [], {}
    known = matcher.vocabulary.get
    for (d, i), shifts in found.items():
        if d not in coded:
            coded[d] = np.array([known(w, -1) for w in bytes(buffer[offsets[d] : offsets[d + 1]]).split()], dtype=np.int32)
        there, words = coded[d], matcher.codes[i]
        alike, least = (1.0, len(words)) if matcher.short[i] else (ALIKE, cover * len(words))
        best, equal, last = 0, np.zeros(len(words), dtype=bool), None
        for o in [*sorted(shifts), None]:
            if last is not None and (o is None or o - last > DRIFT):
                if equal.sum() >= alike * least:  # fewer can't be enough
                    best = max(best, longest_passage(equal, alike))
                equal = np.zeros(len(words), dtype=bool)
            if o is not None:
                low, high = max(0, -o), min(len(words), len(there) - o)
                equal[low:high] |= there[low + o : high + o] == words[low:high]
            last = o
        if best >= least:
            out.append((d, i, best))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """One row per document and item it holds: ``id_col``, ``item_col``, covered_words, item_words.

    Held: a running passage of the document has a share ``cover`` or more of the item's words, whatever their case,
    marks, accents and line breaks, and with single words changed, put in or left out; an item of under WINDOW bytes is
    held only whole. The items are held-out texts of fixed number (ValueError beyond MAX_ITEMS), searched for in as many
    passes as their strings need. Null and empty texts and items give no rows; a repeated item id is searched
    once per text. Repeated documents each get their rows.
    """
    rows = [(r[0], r[1]) for r in reference_rows(items.select(item_col, item_text).where(F.col(item_text).isNotNull()).distinct(), MAX_ITEMS)]
    texts, ids = [r[1] for r in rows], [r[0] for r in rows]
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = WuManber(texts)
        for batch in batches:
            found = search_batch(batch.column("text").to_pylist(), matcher, cover)
            best: dict[tuple[int, object], tuple[int, int]] = {}
            for d, i, n in found:
                best[d, ids[i]] = max(best.get((d, ids[i]), (0, 0)), (n, len(matcher.words[i])))
            keys = list(best)
            doc = batch.column("doc").take(pa.array([d for d, _ in keys], pa.int64()))
            out = {item_col: [i for _, i in keys], "covered_words": [best[k][0] for k in keys], "item_words": [best[k][1] for k in keys]}
            yield pa.RecordBatch.from_arrays([doc, pa.array(out[item_col]).cast(item_arrow), pa.array(out["covered_words"], pa.int32()), pa.array(out["item_words"], pa.int32())], names=[id_col, item_col, "covered_words", "item_words"])

    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    narrow = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, `{item_col}` {item_type}, covered_words int, item_words int")
