"""Nested records as flat, linked tables.

Typed nesting (arrays of arrays of structs) is flattened by Spark's own generators. JSON text is indexed
structurally: over one byte buffer of bounded size, bitmaps of escapes, quotes, brackets, commas and colons are
built, the nesting depth is the prefix sum of the brackets outside strings, and the spans between separators
of one depth are the elements, each linked to the container that holds it. The same bitmaps tell which texts are
valid: what may follow what, in which container, what stands in strings and what scalars look like. Linked rows are
emitted from the index's arrays; only distinct keys and scalars are decoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of JSON text that are indexed at once.
BLOCK = 1 << 20
# Tokens of JSON.
_END, _OBJECT, _ARRAY, _OBJECT_END, _ARRAY_END, _COMMA, _COLON, _STRING, _SCALAR = range(9)
_SCALARS = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
_ESCAPE = np.zeros(256, dtype=bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


def _spans(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each span, as a dictionary array."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    data = buffer[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


class JsonIndex:
    """Elements of many JSON texts: arrays ``doc, parent, ordinal, kind, start, end, key_start, key_end``, and ``valid`` by text.

    ``parent`` is the element that holds this one, -1 for a root; ``kind`` is the first byte of the value. Texts that
    aren't valid JSON have no elements.
    """

    def __init__(self, texts: Sequence[bytes]):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        buf, n = self.buffer, len(texts)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
        first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        doc_of = np.repeat(np.arange(n), lengths + 1)
        at = np.arange(len(buf), dtype=np.int64)
        slash = buf == 92
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        escaped = np.concatenate(([False], ((at - last_other) & 1)[:-1] == 1))
        quote = (buf == 34) & ~escaped
        count = np.cumsum(quote)
        inside = ((count - np.concatenate(([0], count))[first][doc_of]) & 1) == 1
        outside = ~inside & ~quote
        opens = outside & ((buf == 123) | (buf == 91))
        closes = outside & ((buf == 125) | (buf == 93))
        depth = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32))
        depth = depth - np.concatenate(([0], depth))[first][doc_of]
        space = (buf == 32) | (buf == 10) | (buf == 13) | (buf == 9)
        mark = opens | closes | (outside & ((buf == 44) | (buf == 58)))
        plain = outside & ~mark & ~space
        head = plain & ~np.concatenate(([False], plain[:-1]))
        place = np.flatnonzero(mark | (quote & inside) | head)
        byte, doc = buf[place], doc_of[place]
        kind = np.full(len(place), _SCALAR)
        for sign, token in ((123, _OBJECT), (91, _ARRAY), (125, _OBJECT_END), (93, _ARRAY_END), (44, _COMMA), (58, _COLON)):
            kind[mark[place] & (byte == sign)] = token
        kind[(quote & inside)[place]] = _STRING
        # a token lies in the container that was opened last at its level, an opening one in that of the level above
        ends = (kind == _OBJECT_END) | (kind == _ARRAY_END)
        is_open = (kind == _OBJECT) | (kind == _ARRAY)
        level = depth[place] + ends  # of the container that a token opens, closes or lies in
        rank = doc * (int(level.max(initial=0)) + 2) + level
        span = len(buf) + 1
        opened = np.flatnonzero(is_open)
        opened = opened[np.lexsort((place[opened], rank[opened]))]
        keys = rank[opened] * span + place[opened]
        sought = rank - is_open
        hit = np.searchsorted(keys, sought * span + place) - 1
        held = opened[np.maximum(hit, 0)] if len(opened) else np.zeros(len(place), dtype=np.int64)
        container = np.where((hit >= 0) & (level - is_open > 0), held, -1)
        if len(opened):
            container = np.where((container >= 0) & (rank[held] == sought), container, -1)
        self._check(n, first, lengths, inside, escaped, slash, depth, count, kind, doc, container, place, plain, outside)
        self._elements(kind, doc, container, place, quote, plain)

    def _check(self, n, first, lengths, inside, escaped, slash, depth, count, kind, doc, container, place, plain, outside) -> None:
        buf = self.buffer
        bad = np.zeros(n, dtype=bool)
        last = first + lengths - 1
        full = lengths > 0
        bad |= ~full
        base = np.concatenate(([0], count))
        bad |= ((base[first + lengths] - base[first]) & 1) == 1
        bad[full] |= depth[last[full]] != 0
        blame = lambda mask: np.unique(np.searchsorted(first, np.flatnonzero(mask), side="right") - 1)
        bad[blame(depth < 0)] = True
        bad[blame(slash & outside)] = True
        bad[blame(inside & (buf < 32))] = True
        after = escaped & inside
        bad[blame(after & ~_ESCAPE[buf])] = True
        for k in range(1, 5):
            code = np.flatnonzero(after & (buf == 117))
            wrong = ~_HEX[buf[np.minimum(code + k, len(buf) - 1)]]
            bad[np.searchsorted(first, code[wrong], side="right") - 1] = True
        scalars = np.flatnonzero(kind == _SCALAR)
        if len(scalars):
            stops = np.flatnonzero(~plain)
            ends = stops[np.searchsorted(stops, place[scalars])]
            coded = _spans(buf, place[scalars], ends)
            wrong = np.array([_SCALARS.fullmatch(x) is None for x in coded.dictionary.to_pylist()], dtype=bool)
            bad[doc[scalars[wrong[coded.indices.to_numpy()]]]] = True
        # what may stand after what
        starts = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=bool)
        before = np.where(starts, _END, np.concatenate(([_END], kind[:-1])) if len(kind) else kind)
        within = np.where(container >= 0, kind[container], _END)
        key = (kind == _STRING) & (within == _OBJECT) & ((before == _OBJECT) | (before == _COMMA))
        after_key = np.concatenate(([False], key[:-1])) & ~starts if len(key) else key
        begins = np.isin(kind, (_OBJECT, _ARRAY, _STRING, _SCALAR))
        ended = np.isin(before, (_OBJECT_END, _ARRAY_END, _SCALAR)) | ((before == _STRING) & ~after_key)
        good = np.where(
            starts, begins,
            np.where(after_key, kind == _COLON,
            np.where(before == _OBJECT, key | (kind == _OBJECT_END),
            np.where(before == _ARRAY, begins | (kind == _ARRAY_END),
            np.where(before == _COLON, begins,
            np.where(before == _COMMA, np.where(within == _OBJECT, key, begins & (within == _ARRAY)),
            ended & (((within == _OBJECT) & ((kind == _COMMA) | (kind == _OBJECT_END))) | ((within == _ARRAY) & ((kind == _COMMA) | (kind == _ARRAY_END))))))))),
        )
        bad[doc[~good]] = True
        bad |= ~np.isin(np.arange(n), doc)
        finals = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True]))) if len(doc) else np.zeros(0, dtype=np.int64)
        bad[doc[finals[np.isin(kind[finals], (_OBJECT, _ARRAY, _COMMA, _COLON)) | key[finals]]]] = True
        self.valid = ~bad
        self._key = key

    def _elements(self, kind, doc, container, place, quote, plain) -> None:
        """Every token that begins a value of a valid text is an element."""
        value = np.isin(kind, (_OBJECT, _ARRAY, _STRING, _SCALAR)) & ~self._key & self.valid[doc]
        where = np.flatnonzero(value)
        number = np.full(len(kind) + 1, -1, dtype=np.int64)
        number[where] = np.arange(len(where))
        self.doc, self.start, self.kind = doc[where], place[where], self.buffer[place[where]]
        self.parent = number[container[where]]
        stops = np.flatnonzero(~plain)
        quotes = np.flatnonzero(quote)
        self.end = self.start + 1
        scalar, text = kind[where] == _SCALAR, kind[where] == _STRING
        self.end[scalar] = stops[np.searchsorted(stops, self.start[scalar])]
        closing = np.flatnonzero(((kind == _OBJECT_END) | (kind == _ARRAY_END)) & (container >= 0))
        closed = number[container[closing]]
        self.end[closed[closed >= 0]] = place[closing[closed >= 0]] + 1
        self.end[text] = quotes[np.searchsorted(quotes, self.start[text]) + 1] + 1
        # the key of a member is the string two tokens before it
        keyed = np.flatnonzero((kind[np.maximum(where - 1, 0)] == _COLON) & (self.parent >= 0))
        self.key_start, self.key_end = np.full(len(where), -1, dtype=np.int64), np.full(len(where), -1, dtype=np.int64)
        self.key_start[keyed] = place[where[keyed] - 2]
        self.key_end[keyed] = quotes[np.searchsorted(quotes, self.key_start[keyed]) + 1] + 1
        # elements come in order of place, so those of one parent do
        order = np.argsort(self.parent, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], np.diff(self.parent[order]) != 0))) if len(order) else order
        self.ordinal = np.empty(len(where), dtype=np.int64)
        self.ordinal[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        self.ordinal[self.parent < 0] = 0


    def key(self, i: int) -> str | None:
        return json.loads(bytes(self.buffer[self.key_start[i] : self.key_end[i]])) if self.key_start[i] >= 0 else None

    def value(self, i: int) -> str:
        return bytes(self.buffer[self.start[i] : self.end[i]]).decode()


def is_json(text: str) -> bool:
    return bool(JsonIndex([text.encode("utf-8", "surrogatepass")]).valid[0])


_KINDS = {123: "object", 91: "array", 34: "string", 110: "null", 116: "boolean", 102: "boolean"}


def _pieces(texts: Sequence[str | None], size: int = BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``size`` bytes, with the place of the first; a longer text is a run of its own."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > begin and held + n > size:
            yield begin, list(texts[begin:i])
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, list(texts[begin:])


class Forest:
    """The elements of texts and of the JSON texts held as strings in them: arrays text, parent, ordinal, kind, key and value codes.

    A text in a string hangs below the string. ``keys`` and ``values`` are the distinct decoded keys and raw scalars;
    code -1 is none.
    """

    def __init__(self, texts: Sequence[str | None]):
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        keys: dict[bytes, int] = {}
        values: dict[bytes, int] = {}
        source = np.array([i for i, t in enumerate(texts) if t is not None], dtype=np.int64)
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in source]
        above, base = np.full(len(raw), -1, dtype=np.int64), 0
        while raw:
            index = JsonIndex(raw)
            n = len(index.doc)
            parent = np.where(index.parent >= 0, index.parent + base, above[index.doc])
            code = np.full(n, -1, dtype=np.int64)
            named = np.flatnonzero(index.key_start >= 0)
            code[named] = self._coded(_spans(index.buffer, index.key_start[named], index.key_end[named]), keys)
            told = np.full(n, -1, dtype=np.int64)
            scalar = np.flatnonzero((index.kind != 123) & (index.kind != 91))
            spans = _spans(index.buffer, index.start[scalar], index.end[scalar])
            told[scalar] = self._coded(spans, values)
            for column, part in zip(columns, (source[index.doc], parent, index.ordinal, index.kind, code, told)):
                column.append(part)
            # strings that may hold JSON in their turn
            maybe = np.array([x[1:2] in (b"[", b"{") or x[1:3] == b'\\"' for x in spans.dictionary.to_pylist()], dtype=bool)
            inner = scalar[maybe[spans.indices.to_numpy()] & (index.kind[scalar] == 34)] if len(scalar) else scalar
            raw = [json.loads(bytes(index.buffer[index.start[i] : index.end[i]])).encode("utf-8", "surrogatepass") for i in inner]
            source, above, base = source[index.doc[inner]], inner + base, base + n
        self.text, self.parent, self.ordinal, self.kind, self.key, self.value = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in columns)
        self.keys, self.values = [json.loads(k) for k in keys], list(values)
        order = np.argsort(self.parent, kind="stable")
        self._child, self._from = order, np.searchsorted(self.parent[order], np.arange(len(self.text) + 1))

    @staticmethod
    def _coded(spans: pa.Array, known: dict[bytes, int]) -> np.ndarray:
        codes = np.array([known.setdefault(k, len(known)) for k in spans.dictionary.to_pylist()], dtype=np.int64)
        return codes[spans.indices.to_numpy()] if len(codes) else np.zeros(0, dtype=np.int64)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, child) of all children, in order."""
        low, many = self._from[nodes], self._from[nodes + 1] - self._from[nodes]
        owner = np.repeat(np.arange(len(nodes)), many)
        return owner, self._child[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]

    def member(self, nodes: np.ndarray, name: str, scalar: bool = True) -> np.ndarray:
        """For each node its first member of that name, a scalar one if asked, or -1."""
        out = np.full(len(nodes), -1, dtype=np.int64)
        codes = [k for k, key in enumerate(self.keys) if key == name]
        owner, child = self.children(nodes)
        fits = np.isin(self.key[child], codes) & (~np.isin(self.kind[child], (123, 91)) if scalar else True)
        out[owner[fits][::-1]] = child[fits][::-1]
        return out

    def scalars(self, nodes: np.ndarray) -> list:
        """Decoded scalars; None for node -1."""
        codes = np.where(nodes >= 0, self.value[nodes], -1)
        decoded = {c: json.loads(self.values[c]) for c in np.unique(codes) if c >= 0}
        return [decoded.get(c) for c in codes.tolist()]

    def items(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``nodes``, position, element) of list fields that may be arrays, objects keyed by position, one bare object or JSON in a string."""
        own = np.arange(len(nodes))
        while (self.kind[nodes] == 34).any():
            text = self.kind[nodes] == 34
            owner, child = self.children(nodes[text])
            own, nodes = np.concatenate((own[~text], own[text][owner])), np.concatenate((nodes[~text], child))
        owner, child = self.children(nodes)
        digits = np.array([k.isdecimal() and k.isascii() for k in self.keys] + [False], dtype=bool)
        by_place = np.array([int(k) if d else 0 for k, d in zip(self.keys, digits)] + [0], dtype=np.int64)
        code = self.key[child]
        array = self.kind[nodes] == 91
        count = np.bincount(owner, minlength=len(nodes))
        keyed = (self.kind[nodes] == 123) & (count > 0) & (np.bincount(owner, weights=digits[code], minlength=len(nodes)) == count)
        bare = np.flatnonzero((self.kind[nodes] == 123) & (count > 0) & ~keyed)
        listed = array[owner] | keyed[owner]
        position = np.where(array[owner], self.ordinal[child], by_place[code])
        out = np.concatenate((own[owner[listed]], own[bare])), np.concatenate((position[listed], np.zeros(len(bare), dtype=np.int64))), np.concatenate((child[listed], nodes[bare]))
        order = np.argsort(out[0], kind="stable")
        return tuple(x[order] for x in out)


def json_nodes(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Every element of the JSON texts: record_id, node, parent, key, ordinal, kind, value (scalars only).

    ``node`` counts from 0 within the record, ``parent`` is -1 at a root; JSON held in a string hangs below the
    string. Null, blank and invalid texts give no rows; an empty object or array gives its own row only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _pieces(batch.column(json_col).to_pylist()):
                forest = Forest(texts)
                order = np.argsort(forest.text, kind="stable")
                first = np.searchsorted(forest.text[order], forest.text)
                local = np.empty(len(order), dtype=np.int64)
                local[order] = np.arange(len(order))
                node = local - first
                parent = np.where(forest.parent >= 0, node[forest.parent], -1)
                kinds = [_KINDS.get(k, "number") for k in forest.kind.tolist()]
                decoded = forest.scalars(np.where(np.isin(forest.kind, (34,)), np.arange(len(order)), -1))
                value = [d if k == "string" else None if k in ("object", "array", "null") else forest.values[v].decode() for k, d, v in zip(kinds, decoded, forest.value.tolist())]
                key = [forest.keys[k] if k >= 0 else None for k in forest.key.tolist()]
                ids = batch.column("record_id").take(pa.array(at + forest.text))
                columns = [ids, pa.array(node, pa.int32()), pa.array(parent, pa.int32()), pa.array(key, pa.string()), pa.array(forest.ordinal, pa.int32()), pa.array(kinds, pa.string()), pa.array(value, pa.string())]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(order)) for c in columns], names=["record_id", "node", "parent", "key", "ordinal", "kind", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("record_id"), F.col(json_col)).mapInArrow(run, f"record_id {kind}, node int, parent int, key string, ordinal int, kind string, value string")


def _boundary_rows(texts: Sequence[str | None]) -> pa.RecordBatch:
    forest = Forest(texts)
    codes = [k for k, key in enumerate(forest.keys) if key == "boundary_candidates"]
    lists = np.flatnonzero(np.isin(forest.key, codes))
    told = forest.scalars(forest.member(forest.parent[lists], "table_id"))
    tables = np.array([None, *(t if t is None or isinstance(t, str) else str(t) for t in told)], dtype=object)[1:]
    owner, pos1, item = forest.items(lists)
    real = forest.kind[item] != 110
    owner, pos1, item = owner[real], pos1[real], item[real]
    fields, child = forest.children(item)
    rules_at = np.isin(forest.key[child], [k for k, key in enumerate(forest.keys) if key == "rule_references"])
    fields, child = fields[rules_at], child[rules_at]
    field, pos2, rule = forest.items(child)
    real = forest.kind[rule] != 110
    of, pos2, rule = fields[field[real]], pos2[real], rule[real]
    number = lambda node: [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in forest.scalars(node)]
    n, m = len(item), len(rule)
    source = [v if isinstance(v, str) else None for v in forest.scalars(forest.member(rule, "source"))]
    index = [v if isinstance(v, int) else None for v in forest.scalars(forest.member(rule, "source_index"))]
    columns = {
        "node_kind": pa.array(["boundary"] * n + ["rule"] * m, pa.string()), "table_id": pa.array([*tables[owner], *tables[owner[of]]], pa.string()),
        "pos1": pa.array(np.concatenate((pos1, pos1[of])), pa.int32()), "pos2": pa.array(np.concatenate((np.full(n, -1), pos2)), pa.int32()),
        "y": pa.array(number(forest.member(item, "canonical_y")) + [None] * m, pa.float64()), "coverage": pa.array(number(forest.member(item, "table_coverage_fraction")) + [None] * m, pa.float64()),
        "source": pa.array([None] * n + source, pa.string()), "source_index": pa.array([None] * n + index, pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def boundary_nodes(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """Boundary candidates and their rules in proposal payloads: node_kind, table_id, pos1, pos2, y, coverage, source, source_index.

    A proposal is any object with ``boundary_candidates``, at any depth, alone, in a list or in a string. Lists may
    also be objects keyed by position or a bare single entry. A null entry keeps its place and gives no row; null,
    blank and invalid payloads give none. Resent payloads give equal rows, which are kept here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _pieces(batch.column(json_col).to_pylist()):
                yield _boundary_rows(texts)

    return df.select(json_col).mapInArrow(run, "node_kind string, table_id string, pos1 int, pos2 int, y double, coverage double, source string, source_index long")


def grid_cells(tables: DataFrame, evidence: str = "positioned_evidence") -> DataFrame:
    """Non-null boxes of canonical_grid_cell_bboxes: table_id, pos1 (row), pos2 (column), x0, y0, x1, y1.

    Missing evidence, empty or null rows give nothing; holes keep their place. Copies of a table are kept here.
    """
    return (
        tables.select("table_id", F.posexplode(f"{evidence}.canonical_grid_cell_bboxes").alias("pos1", "grid_row"))
        .select("table_id", "pos1", F.posexplode("grid_row").alias("pos2", "box"))
        .where("box is not null")
        .select("table_id", "pos1", "pos2", "box.x0", "box.y0", "box.x1", "box.y1")
    )
