"""Character n-gram inverted index over a short reference list, with weighted cosine."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

def words(text: str) -> list[str]:
    """Words of a bare text; a dot stays on the word it cuts short."""
    return re.findall(r"[^\W_]+\.?", text)


@lru_cache(maxsize=300_000)
def edit_similarity(a: str, b: str) -> float:
    """1 less the share of letters to change, put in, leave out or swap with a neighbour; one column of the table is one integer."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    longest = max(n, m)
    if not n or not m or 2 * min(n, m) < longest:
        return min(n, m) / max(longest, 1) * 0.5
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, diagonal, before, distance = full, 0, 0, 0, n
    for c in b:
        here = places.get(c, 0)
        swapped = (((~diagonal & full) & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swapped) & full
        right, left = down | (~(diagonal | up) & full), diagonal & up
        distance += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = left | (~(diagonal | right) & full), right & diagonal
        before = here
    return 1 - distance / longest


def aligned_similarity(left: Sequence[str], right: Sequence[str]) -> float:
    """Edit similarity of two names: words paired best first in any order, or the names without blanks if that is more."""
    a, b = [w.rstrip(".") for w in left], [w.rstrip(".") for w in right]
    if len(a) == len(b) == 1:
        return edit_similarity(a[0], b[0])
    pairs = sorted(((edit_similarity(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a, used_b, total = set(), set(), 0.0
    for sim, i, j in pairs:
        if sim < 0.5:
            break
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            total += sim * max(len(a[i]), len(b[j]))
    paired = min(1.0, total / max(sum(map(len, a)), sum(map(len, b)), 1))
    return paired if paired > 0.85 else max(paired, edit_similarity("".join(a), "".join(b)))


def grams(parts: Sequence[str]) -> Counter[str]:
    """Trigrams of each word with its ends marked, pairs of letters one or two places apart in either order, and short words whole.

    The pairs stay where letters are swapped, put in or left out.
    """
    out: Counter[str] = Counter()
    for word in parts:
        word = word.rstrip(".")
        if not word:
            continue
        marked = f"^{word}$"
        if len(word) <= 3:
            out[marked] += 2
        for k in range(len(marked) - 2):
            out[marked[k : k + 3]] += 1
        for gap in (1, 2):
            for a, b in zip(marked, marked[gap:]):
                out[f"{a}~{b}" if a < b else f"{b}~{a}"] += 1
    return out


#: Weighted cosine from which on a match is accepted, and from which on the exact check may accept it.
ACCEPTED, CHECKED = 0.60, 0.25
#: Least edit similarity of the exact check, for one word and for several; entries within CLOSE of the best cosine are told apart by it.
ALIKE_WORD, ALIKE_WORDS, CLOSE = 0.66, 0.75, 0.10
#: Words whose grams an index remembers.
REMEMBERED = 100_000
#: Least lead over the next other entry.
LEAD = 0.008


class NgramIndex:
    """Inverted index of the entries (id, name) of one kind: postings (entry, weight) for each gram."""

    def __init__(self, entries: Sequence[tuple[int, str]]):
        self.ids = np.array([i for i, _ in entries], dtype=np.int64)
        self.words = [words(n) for _, n in entries]
        counts = [grams(w) for w in self.words]
        spread = Counter(g for c in counts for g in c)
        self.size = max(1, len(entries))
        self.weight = {g: math.log(1 + self.size / n) for g, n in spread.items()}
        self.unseen = math.log(1 + self.size / 0.5)
        #: Postings of all grams in one piece: the entries and weights of gram k lie from ``first[k]`` to ``first[k + 1]``.
        self.row = {g: k for k, g in enumerate(spread)}
        self.weights = np.array([self.weight[g] for g in spread])
        self.first = np.concatenate(([0], np.cumsum(list(spread.values())))).astype(np.int64)
        self.entry, self.value = np.zeros(self.first[-1], dtype=np.int32), np.zeros(self.first[-1], dtype=np.float32)
        free = self.first[:-1].copy()
        for e, c in enumerate(counts):
            norm = math.sqrt(sum(n * self.weight[g] ** 2 for g, n in c.items())) or 1.0
            for g, n in c.items():
                k = self.row[g]
                self.entry[free[k]], self.value[free[k]] = e, math.sqrt(n) * self.weight[g] / norm
                free[k] += 1
        self._known: dict[str, tuple[np.ndarray, np.ndarray, float]] = {}
        self.begins: dict[str, set[int]] = defaultdict(set)
        for e, w in enumerate(self.words):
            for word in w:
                for k in range(1, len(word) + 1):
                    self.begins[word[:k]].add(e)
        self.exact = {}
        for e, w in enumerate(self.words):
            self.exact.setdefault(tuple(sorted(w)), e)

    def _word(self, word: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows and counts of a word's grams that entries have, and the squared weight of the others."""
        known = self._known.get(word)
        if known is None:
            found = grams([word])
            seen = [(self.row[g], n) for g, n in found.items() if g in self.row]
            other = sum(n for g, n in found.items() if g not in self.row)
            known = np.array([k for k, _ in seen], dtype=np.int64), np.array([n for _, n in seen], dtype=float), other * self.unseen**2
            if len(self._known) < REMEMBERED:
                self._known[word] = known
        return known

    def cosines(self, parts: Sequence[str]) -> np.ndarray:
        """Weighted cosine of the words with every entry that shares a gram, 0 for the others."""
        each = [self._word(p) for p in parts]
        rows = np.concatenate([e[0] for e in each]) if each else np.zeros(0, dtype=np.int64)
        if not len(rows):
            return np.zeros(len(self.ids))
        counts = np.concatenate([e[1] for e in each])
        if len(each) > 1:
            rows, at = np.unique(rows, return_inverse=True)
            counts = np.bincount(at, weights=counts)
        weights = self.weights[rows]
        own = sum(e[2] for e in each) + float((counts * weights * weights).sum())
        low, many = self.first[rows], self.first[rows + 1] - self.first[rows]
        places = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        worth = np.repeat(np.sqrt(counts) * weights, many) * self.value[places]
        return np.bincount(self.entry[places], weights=worth, minlength=len(self.ids)) / math.sqrt(own)

    def _expanded(self, parts: Sequence[str], entry: int) -> list[str]:
        """The words with those cut short by a dot completed from the entry's words, each used once, in order."""
        left = list(self.words[entry])
        for p in parts:
            if not p.endswith(".") and p in left:
                left.remove(p)
        out = []
        for p in parts:
            stem = p[:-1]
            full = next((w for w in left if p.endswith(".") and stem and w.startswith(stem)), None)
            if full:
                left.remove(full)
            out.append(full or p)
        return out

    def _contenders(self, parts: Sequence[str]) -> Iterator[tuple[int, float, list[str]]]:
        """(entry, cosine, words as compared) of the entries near the best cosine; all that fit words cut short by a dot."""
        scores = self.cosines(parts)
        near = set(np.flatnonzero(scores >= max(0.15, scores.max(initial=0.0) - 1.5 * CLOSE)).tolist())
        if not any(p.endswith(".") for p in parts):
            yield from ((e, float(scores[e]), list(parts)) for e in near)
            return
        stems = [p[:-1] for p in parts if p.endswith(".") and len(p) > 1]
        near.update(e for e, n in Counter(e for x in stems for e in self.begins.get(x, ())).items() if 2 * n > len(stems))
        for e in near:
            full = self._expanded(parts, e)
            yield e, float(self.cosines(full)[e]) * (1.0 if full == list(parts) else 0.98), full

    def best(self, names: Sequence[Sequence[str]], search: Sequence[Sequence[str]], accepted: float = ACCEPTED, lead: float = LEAD) -> tuple[int, float, float]:
        """(id, weighted cosine, lead) of one value; id 0 if no entry is accepted.

        ``names`` may be listed as they are, the fullest first: their cosine is 1 and needs no search. ``search``: the names
        looked up, the fullest first; a fuller one counts a little more. A cosine of ``accepted`` decides; below it, and
        between entries of nearly the same cosine, an exact check does: the edit similarity of the words.
        """
        for order, parts in enumerate(names):
            e = self.exact.get(tuple(sorted(parts)))
            if e is not None:
                return int(self.ids[e]), 1.0 - 0.01 * order, 1.0
        kept: dict[int, tuple[float, float, bool]] = {}
        for order, parts in enumerate(search):
            for e, cosine, full in self._contenders(parts):
                i, new = int(self.ids[e]), (cosine - 0.01 * order, aligned_similarity(full, self.words[e]), len(full) == 1)
                if i not in kept or new[0] + new[1] > kept[i][0] + kept[i][1]:
                    kept[i] = new
        if not kept:
            return 0, 0.0, 0.0
        top = max(c for c, _, _ in kept.values())
        close = {i: c + a for i, (c, a, _) in kept.items() if c >= top - CLOSE}
        found = max(close, key=lambda i: close[i])
        cosine, alike, single = kept[found]
        ahead = close[found] - max((s for i, s in close.items() if i != found), default=0.0)
        good = cosine >= accepted or cosine >= CHECKED and alike >= (ALIKE_WORD if single else ALIKE_WORDS)
        return (found if good and ahead >= lead else 0), cosine, ahead
