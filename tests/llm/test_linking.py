import random

from tabloom.functions.fold import bare
from tabloom.functions.ngrams import NgramIndex, aligned_similarity, edit_similarity
from tabloom.llm.linking import link_values

CANON = [
    (1, "variable", "Body weight", ["Weight"]), (2, "variable", "Age at enrolment", ["Age"]), (3, "variable", "Age band", ["Age group"]), (4, "variable", "Serum albumin", ["Alb"]),
    (5, "variable", "Anticoagulant therapy", []), (6, "variable", "Statin therapy", None), (7, "level", "Former smoker", []), (8, "level", "Active, regular", []), (9, "level", "Active, irregular", []), (10, "level", "Female", []), (11, "level", "Male", []),
]
CASES = [
    ("variable", "Body weight", 1), ("variable", "WEIGHT, BODY – mean (SD)", 1), ("variable", "Bodyweight, g", 1), ("variable", "Body weigth (kgs)", 1), ("variable", "Age group, n (%)", 3), ("variable", "Self-reported Age at enrolmnt at baseline, months", 2),
    ("variable", "Anti. ther., No. (%)", 5), ("variable", "Statin therapy (yes)", 6), ("variable", "Albumin vial colour 7", 0), ("variable", "Weight of returned pill bottles", 0), ("variable", "Kiosk check-in method", 0), ("variable", None, 0), ("variable", " ", 0),
    ("level", "former_smoker", 7), ("level", "Former smоker*", 7), ("level", "Former address", 0), ("level", "active, iregular", 9), ("level", "Active,  regulr", 8), ("level", "femlae", 10), ("level", "Body weight", 0), ("other", "Male", 0), (None, "Male", 0), ("level", "x" * 20_000, 0),
]


def test_links(spark):
    df = spark.createDataFrame([(n, k, v, 5, "c") for n, (k, v, _) in enumerate(CASES)] * 2, "n int, k string, v string, canon_id int, value string")
    canon = spark.createDataFrame([(*c, None) for c in CANON], "canon_id int, label_kind string, canon_text string, aliases array<string>, quantity string")
    out = link_values(df, "k", "v", canon, ["n"]).collect()
    assert len(out) == 2 * len(CASES)
    wrong = [(CASES[r["n"]], r["canon_id"], r["score"]) for r in out if r["canon_id"] != CASES[r["n"]][2]]
    assert not wrong
    assert link_values(df.limit(0), "k", "v", canon, ["n"]).count() == 0
    assert {r["canon_id"] for r in link_values(df, "k", "v", canon.limit(0), ["n"]).collect()} == {0}


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_similarity_against_the_table():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        if 2 * min(len(a), len(b)) >= max(len(a), len(b)):
            assert abs(edit_similarity(a, b) - (1 - osa(a, b) / max(len(a), len(b)))) < 1e-9, (a, b)
    assert aligned_similarity(["weight", "body"], ["body", "weight"]) == 1.0


def test_cosine_against_brute_force():
    from tabloom.functions.ngrams import grams, words

    names = [bare(n) for _, _, t, a in CANON for n in [t, *(a or [])]]
    index = NgramIndex([(i, n) for i, n in enumerate(names)])
    for query in ("body weigth", "age", "serum albumine", "zzz"):
        got = index.cosines(words(query))
        q = {g: n**0.5 * index.weight.get(g, index.unseen) for g, n in grams(words(query)).items()}
        for e, name in enumerate(names):
            v = {g: n**0.5 * index.weight[g] for g, n in grams(words(name)).items()}
            want = sum(q[g] * v.get(g, 0) for g in q) / (sum(x * x for x in q.values()) * sum(x * x for x in v.values())) ** 0.5
            assert abs(got[e] - want) < 1e-4


def test_no_other_entry_beats_the_candidates():
    from tabloom.functions.ngrams import words

    index = NgramIndex([(i, bare(n)) for i, _, t, a in CANON for n in [t, *(a or [])]])
    rng, hit, n = random.Random(4), 0, 0
    for _, _, t, _ in CANON:
        for _ in range(20):
            k = rng.randrange(1, len(t) - 1)
            typed = words(bare(t[:k] + rng.choice(["", "x", t[k] * 2, t[k + 1] + t[k]]) + t[k + 1 :]))
            true = max(range(len(index.words)), key=lambda e: aligned_similarity(typed, index.words[e]))
            hit += true in {e for e, _, _ in index._contenders(typed)}
            n += 1
    assert hit >= 0.97 * n


def test_index_of_many_entries_is_sparse():
    rng = random.Random(1)
    names = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10))) for _ in range(3)) for _ in range(5000)]
    index = NgramIndex(list(enumerate(names, 1)))
    assert index.entry.nbytes + index.value.nbytes + index.first.nbytes < 5_000_000
    assert index.best([], [tuple(names[4321].replace("a", "", 1).split())])[0] == 4322
