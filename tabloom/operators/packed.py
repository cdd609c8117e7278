"""Several values packed in one field: one row per value, with its position.

The folded texts of a batch are scanned as one byte buffer. A prefix parity of the quotes and a prefix sum of the brackets
outside them mark the bytes that may separate; delimiter masks of growing width then give the cuts of each level, the cuts
give piece spans, and the spans are gathered into Arrow arrays whose kinds are told once per distinct piece. A text is cut
at the first level at which all its pieces are values. The counts of its pieces are the child offsets of a list array,
which is flattened with the ordinals of the parents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.fold import INVISIBLE, SPACES, bare, fold

_NUMBER = r"(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)"
_WORD = r"\p{L}[\p{L}\p{N}_%°/.²-]*"
_UNIT = rf"(?:%|{_WORD}(?: {_WORD}){{0,4}}|°[\p{{L}}\p{{N}}_]+)"
_RANGE = rf"(?:\s*(?:,|;|-|–|to)\s*-?{_NUMBER})?"
_PAIR = rf"(?:\(\s*[<>≤≥]?\s*-?{_NUMBER}\s*%?{_RANGE}\s*%?\s*\)|\[\s*-?{_NUMBER}\s*%?{_RANGE}\s*\]|(?:±|\+/-|-|–|6)\s*{_NUMBER})"
_MARK = r"(?:\s*[*†‡§¶#]+)?"
#: A number with its unit and companion; a number alone.
WITH_COMPANION = rf"^[<>≤≥~]?\s*[-−]?{_NUMBER}(?:\s*{_UNIT})?\s*{_PAIR}\s*%?(?:\s*{_UNIT})?{_MARK}$"
BARE_NUMBER = rf"^(?:[pP]\s*)?[<>≤≥=~]?\s*[-−]?{_NUMBER}(?:\s*{_UNIT})?{_MARK}$"
#: A piece that only goes on with the value before it, and the end of one that asks for more.
_GOES_ON = r"^(?:[(\[±%]|\+/-|[-–]\s*\d|6 \d)"
_OPEN_END = r"(?:±|\+/-|[(\[,-]|\s6)$"
#: Delimiters of each level; a level also cuts at those of the one before.
STRONG, LINES, ALL = 3, 2, 1


def cut_levels(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of the texts in one buffer the level at which it separates, 0 within quotes, brackets and values."""
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    quotes = np.cumsum(buf == 34)
    odd = ((quotes - np.concatenate(([0], quotes))[offsets[:-1]][text_of]) & 1) == 1
    steps = np.where(odd, 0, ((buf == 40) | (buf == 91)).astype(np.int32) - ((buf == 41) | (buf == 93)))
    depth = np.cumsum(steps)
    depth = depth - np.concatenate(([0], depth))[offsets[:-1]][text_of]
    after, before = np.append(buf[1:], 0), np.concatenate(([0], buf[:-1]))
    digit = (buf >= 48) & (buf <= 57)
    in_number = np.append(digit[1:], False) & np.concatenate(([False], digit[:-1]))
    dot = (buf == 0xC2) & (after == 0xB7)
    strong = (buf == 59) | (buf == 124) | (buf == 9) | dot | np.concatenate(([False], dot[:-1]))
    first = np.zeros(len(buf), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    lines = (buf == 10) | ((buf == 47) & ((before != 43) | first)) | ((buf == 32) & (before == 32) & ~first)
    comma = (buf == 44) & ~in_number
    level = np.where(strong, STRONG, np.where(lines, LINES, np.where(comma, ALL, 0)))
    return level * (~odd & (depth <= 0))


class Spans:
    """Pieces (owner, start, end) of the texts of one buffer, without blank ones; quotes round a whole piece are taken off."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, cut: np.ndarray, solid: np.ndarray):
        places = np.flatnonzero(cut)
        start = np.concatenate((offsets[:-1], places + 1))
        end = np.concatenate((places, offsets[1:]))
        # a text that ends where the next begins: its end sorts with its own cuts
        text = np.searchsorted(offsets, places, side="right") - 1
        owner = np.concatenate((np.arange(len(offsets) - 1), text))
        order = np.lexsort((start, owner))
        end_order = np.lexsort((end, np.concatenate((text, np.arange(len(offsets) - 1)))))
        self.owner, self.start, self.end = owner[order], start[order], end[end_order]
        self._trim(solid)
        quoted = (self.end - self.start >= 2) & (buf[self.start] == 34) & (buf[self.end - 1] == 34)
        self.start, self.end = self.start + quoted, self.end - quoted
        self._trim(solid)

    def _trim(self, solid: np.ndarray) -> None:
        """Blanks off both ends; pieces with nothing left go."""
        low = np.searchsorted(solid, self.start)
        high = np.searchsorted(solid, self.end) - 1
        full = low <= high
        self.owner, self.start, self.end = self.owner[full], solid[low[full]], solid[high[full]] + 1

    def kept(self, rows: np.ndarray) -> Spans:
        new = object.__new__(Spans)
        new.owner, new.start, new.end = self.owner[rows], self.start[rows], self.end[rows]
        return new

    def texts(self, buf: np.ndarray) -> pa.Array:
        """The pieces' texts with single blanks, gathered from the buffer."""
        size = self.end - self.start
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        data = buf[np.repeat(self.start - offsets[:-1], size) + np.arange(offsets[-1])]
        pieces = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        return pc.replace_substring_regex(pieces, r"\s+", " ")


def _matches(pieces: pa.Array, pattern: str) -> np.ndarray:
    """Which pieces match; each distinct one is tried once."""
    coded = pieces.dictionary_encode()
    hit = pc.match_substring_regex(coded.dictionary, pattern)
    return hit.take(coded.indices).to_numpy(zero_copy_only=False) if len(pieces) else np.zeros(0, dtype=bool)


def _named(pieces: pa.Array, names: pa.Array) -> np.ndarray:
    coded = pieces.dictionary_encode()
    plain = pa.array([bare(p) for p in coded.dictionary.to_pylist()], pa.string())
    return pc.is_in(plain, value_set=names).take(coded.indices).to_numpy(zero_copy_only=False) if len(pieces) else np.zeros(0, dtype=bool)


def _buffer(array: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array that begins at its buffer's beginning."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[: len(array) + 1] if len(array) else np.zeros(1, dtype=np.int64)
    data = array.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[: offsets[-1]]), offsets


def _all_of(owner: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
    """Texts with two or more pieces, every one of them good."""
    count = np.bincount(owner, minlength=n)
    return (count > 1) & (np.bincount(owner, weights=good, minlength=n) == count)


def _rejoined(spans: Spans, buf: np.ndarray, hard: np.ndarray) -> Spans:
    """Pieces with those put back to the one before that only go on with it, where nothing but blanks lies between."""
    if not len(spans.owner):
        return spans
    pieces = spans.texts(buf)
    goes_on, open_end, bare_number = _matches(pieces, _GOES_ON), _matches(pieces, _OPEN_END), _matches(pieces, BARE_NUMBER)
    soft = (spans.owner[1:] == spans.owner[:-1]) & (hard[spans.start[1:]] == hard[spans.end[:-1]])
    joins = np.concatenate(([False], soft & ((goes_on[1:] & bare_number[:-1]) | open_end[:-1])))
    heads = np.flatnonzero(~joins)
    out = spans.kept(heads)
    out.end = spans.end[np.append(heads[1:], len(joins)) - 1]
    return out


def split_batch(texts: Sequence[str], names: frozenset[str]) -> tuple[np.ndarray, pa.Array]:
    """Offsets into the flat values of the texts (len + 1), and the values. ``names``: level names in bare form."""
    array, rows, owners, values = pa.array([fold(t) for t in texts], pa.large_string()), np.arange(len(texts)), [], [pa.array([], pa.large_string())]
    for _ in range(2):  # the texts without any cut go after the first look
        buf, offsets = _buffer(array)
        level = cut_levels(buf, offsets)
        has = np.unique(np.searchsorted(offsets, np.flatnonzero(level), side="right") - 1)
        if len(has) == len(array):
            break
        array, rows = array.take(pa.array(has)), rows[has]
    n = len(array)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    solid = np.flatnonzero(~blank)
    hard = np.concatenate(([0], np.cumsum((level > 0) & ~blank)))
    spans = {at: Spans(buf, offsets, level >= at, solid) for at in (STRONG, LINES, ALL)}
    known, undecided = pa.array(sorted(names), pa.string()), np.ones(n, dtype=bool)
    # values with companions at every delimiter; any numbers at the strong ones; then names at the fewest that do
    for at, numbers in ((ALL, True), (STRONG, True), (STRONG, False), (LINES, False), (ALL, False)):
        several = undecided & (np.bincount(spans[at].owner, minlength=n) > 1)
        part = spans[at].kept(np.flatnonzero(several[spans[at].owner]))
        if not numbers:  # a text whose first piece is no name needs no look at the others
            heads = part.kept(np.flatnonzero(np.diff(part.owner, prepend=-1)))
            named = np.zeros(n, dtype=bool)
            named[heads.owner[_named(heads.texts(buf), known)]] = True
            part = part.kept(np.flatnonzero(named[part.owner]))
        else:
            part = _rejoined(part, buf, hard)
        pieces = part.texts(buf)
        if numbers:
            good = _matches(pieces, WITH_COMPANION)
            if at == STRONG:
                good |= _matches(pieces, BARE_NUMBER)
        else:
            good = _named(pieces, known)
        chosen = _all_of(part.owner, good, n)
        undecided &= ~chosen
        of_chosen = np.flatnonzero(chosen[part.owner])
        owners.append(rows[part.owner[of_chosen]])
        values.append(pieces.take(pa.array(of_chosen)))
    owner = np.concatenate(owners)
    flat = pa.concat_arrays(values).take(pa.array(np.argsort(owner, kind="stable"))).cast(pa.string())
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32), flat


def split_values(text: str, names: frozenset[str]) -> list[str]:
    """The values of one field, or [] if it holds fewer than two."""
    return split_batch([text], names)[1].to_pylist()


#: What must occur in a text for it to hold two values: a delimiter, or a character that may fold to one.
MAY_SPLIT = rf'[;|\t\n,/"·]|[ {SPACES}][{INVISIBLE}]*[ {SPACES}]|[；｜，／＂]'


def split_packed(df: DataFrame, text_col: str, names: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``keep``, ``pos``, ``value``: one per value of each field with two or more values, pos from 0 as printed.

    A value is a number with its unit and companion, or one of ``names``. Delimiters (; | tab · , / line break, two
    spaces) inside quotes or brackets don't separate, a value wrapped over lines is one value, and empty pieces are
    none. Null, blank and single-valued fields give no rows. Repeated rows are each split. Other columns are dropped.
    """
    known = frozenset(bare(n) for n in names)
    kinds = [(k, df.schema[k].dataType) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("packed_text")
            may = pc.fill_null(pc.match_substring_regex(text, MAY_SPLIT), False)
            rows = batch.filter(may)
            if not rows.num_rows:
                continue
            offsets, values = split_batch(rows.column("packed_text").to_pylist(), known)
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            parent = pc.list_parent_indices(lists)
            pos = pa.array(np.arange(len(values), dtype=np.int32) - offsets[parent.to_numpy(zero_copy_only=False)], pa.int32())
            out = rows.select(list(keep)).take(parent)
            yield pa.RecordBatch.from_arrays([*out.columns, pos, values], names=[*keep, "pos", "value"])

    schema = ", ".join([*(f"`{k}` {t.simpleString()}" for k, t in kinds), "pos int", "value string"])
    return df.select(*[F.col(k) for k in keep], F.col(text_col).alias("packed_text")).mapInArrow(run, schema)
