import random

import numpy as np

from tabloom.llm.leakage import ALIKE, WINDOW, WuManber, find_leaks, longest_passage, plain, search_batch

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randrange(2, 9))) for _ in range(500)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def test_search_finds_what_a_plain_search_finds():
    items = [text(60) for _ in range(40)]
    docs = [text(400) + " " + " ".join(items[k % 40].split()[10:30]) + " " + text(50) for k in range(60)]
    matcher = WuManber(items, strings=700)  # several passes
    assert len(matcher.searches) > 1
    buffer, offsets = plain(docs)
    got = {(p, i, n) for p, i, n, _ in zip(*(c.tolist() for c in matcher.find(buffer)))}
    raw, want = bytes(buffer), set()
    for i, words in enumerate(matcher.words):
        joined = b" " + b" ".join(words)
        at = 0
        for n in range(len(words)):
            needle = joined[at : at + WINDOW]
            at += len(words[n]) + 1
            if len(needle) == WINDOW:
                p = raw.find(needle)
                while p >= 0:
                    want.add((p, i, n))
                    p = raw.find(needle, p + 1)
    assert got == want and len(got) > 500


def altered(item, every):
    words = item.split()
    for k in range(every, len(words), every):
        words[k] = "Changed"
    out = " ".join(words)
    return out.upper().replace(" ", ",\n", 3).replace(" ", " – ", 2)


def test_passages_and_decoys():
    items = [text(60) for _ in range(20)]
    docs = []
    for k, item in enumerate(items):
        docs.append(text(100) + "\n" + altered(" ".join(item.split()[20:45]), 9) + ". " + text(100))  # 25 of 60 words
        docs.append(text(100) + " " + " ".join(item.split()[:8]) + " " + text(100))  # a short phrase
        parts = item.split()
        docs.append(text(80) + " " + " ".join(parts[:10] + parts[11:30] + ["extra"] + parts[30:]) + " " + text(30))  # a word left out, one put in
    found = {(d, i) for d, i, _ in search_batch(docs, WuManber(items))}
    assert found == {(3 * k, k) for k in range(20)} | {(3 * k + 2, k) for k in range(20)}


def test_other_scripts():
    items = ["Тревожность и качество сна у взрослых пациентов после плановой операции на сердце", "患者の睡眠の質と不安の関係を調べた研究の結果について", "Größe und Gewicht der Patienten wurden zu Beginn und am Ende gemessen"]
    docs = [f"before — {t.upper()} after" for t in items] + [items[2].replace("ö", "o\u0308"), items[0][:14]]
    assert {(d, i) for d, i, _ in search_batch(docs, WuManber(items))} == {(0, 0), (1, 1), (2, 2), (3, 2)}


def test_short_items_are_held_whole():
    items = ["alpha beta gamma one", "tiny one", "ab cd", "x", "q z", "", "..."]
    docs = ["so Alpha, beta gamma one. end", "alpha beta gamma two", "a tiny one", "tiny\none", "AB cd", "drab cd", "x", "fix y", "q z q z"]
    got = {(d, i) for d, i, _ in search_batch(docs, WuManber(items))}
    assert got == {(0, 0), (2, 1), (3, 1), (4, 2), (6, 3), (8, 4)}


def test_longest_passage_is_the_brute_force_one():
    for _ in range(300):
        equal = np.array([RNG.random() < 0.75 for _ in range(RNG.randrange(0, 30))], dtype=bool)
        spans = [j - i + 1 for i in range(len(equal)) for j in range(i, len(equal)) if equal[i] and equal[j] and equal[i : j + 1].sum() >= ALIKE * (j - i + 1) - 1e-9]
        assert longest_passage(equal) == max(spans, default=0)
    assert longest_passage(np.ones(1_000_000, dtype=bool)) == 1_000_000


def test_densely_changed_passages():
    items = [text(60) for _ in range(200)]
    held = 0
    for every in (5, 6, 7):
        found = {(d, i) for d, i, _ in search_batch([altered(" ".join(t.split()[10:50]), every) for t in items], WuManber(items))}
        held += sum((k, k) in found for k in range(200))
    assert held >= 0.9 * 600, held


def test_rows(spark):
    item = text(40)
    docs = [(1, item), (2, None), (3, ""), (1, item), (4, "short one"), (5, text(60_000) + " " + item), (6, "…" * 1000)]
    df = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id int, text string, doc int, item_id int")
    items = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "Short, one")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in find_leaks(df, items).collect())
    assert got == [(1, 10, 40), (1, 10, 40), (4, 13, 2), (5, 10, 40)]
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0
