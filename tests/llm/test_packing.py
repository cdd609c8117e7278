from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm.packing import pack, plan, tokenizer


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_all_and_overfills_none(lengths):
    counts = Counter(lengths)
    slots, total = plan(counts, 40)
    load, seen = [0] * total, Counter()
    for length, rank, per, first, many in slots:
        assert rank == seen[length]
        seen[length] += per * many
        for c in range(first, first + many):
            load[c] += per * length
    assert seen == counts and all(0 < x <= 40 for x in load)
    # two containers that could be merged are never both left
    assert sum(1 for x in load if x <= 20) <= 1


def test_assignment(spark):
    texts = [(k, "word " * (1 + 7 * k % 60)) for k in range(300)] + [(300, "long word " * 300), (301, ""), (302, None), (303, "x" * 30_000), (304, " "), (5, "word " * 3), (5, "word " * 3)]
    df = spark.createDataFrame([(*t, 1, 1) for t in texts], "doc_id int, text string, doc int, n_tokens int")
    cap = 100
    rows = pack(df, capacity=cap).collect()
    encode = tokenizer().encode_ordinary
    sizes = Counter((k, len(encode(t))) for k, t in texts if t is not None)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows if r["piece"] == 0) == sizes
    load = Counter()
    for r in rows:
        if r["piece_tokens"]:
            load[r["container_id"]] += r["piece_tokens"]
        else:
            assert r["container_id"] is None and r["n_tokens"] == 0
        assert r["n_pieces"] == max(1, -(-r["n_tokens"] // cap)) and r["start_token"] == r["piece"] * cap
    assert max(load.values()) <= cap and sorted(load) == list(range(len(load)))
    per_doc = Counter()
    for r in rows:
        per_doc[r["doc_id"], r["n_tokens"]] += r["piece_tokens"]
    assert all(per_doc[k] == k[1] * n for k, n in sizes.items())
    whole = sum(n * c for (_, n), c in sizes.items())
    assert len(load) <= whole / cap * 1.02 + 1


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["container_id"]) for r in pack(df).collect()] == [(2, None)]
    assert pack(df.limit(0)).count() == 0
