import datetime as dt
import random

from tabloom.operators.references import find_orphans, missing_ids, parent_runs

REF = "reference_id string, resolved_visual_id string, observed_at timestamp_ntz, visual_id string, ref_id string"
VIS = "visual_id string, recorded_at timestamp_ntz, withdrawn_at timestamp_ntz, ref_row string, at int"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def brute(refs, visuals):
    out = set()
    for ref, vid, at in refs:
        if vid is None:
            continue
        rows = [v for v in visuals if v[0] == vid]
        if at is not None and any(r is not None and r <= at and (w is None or w > at) for _, r, w in rows):
            continue
        if not rows:
            fault = "missing"
        elif at is not None and all(r is None or r > at for _, r, _ in rows):
            fault = "late"
        else:
            fault = "withdrawn"
        out.add((ref, fault))
    return out


def run(spark, refs, visuals):
    r = spark.createDataFrame([(a, b, day(c), "clash", "clash") for a, b, c in refs], REF)
    v = spark.createDataFrame([(a, day(b), day(c), "clash", 1) for a, b, c in visuals], VIS)
    return {tuple(x) for x in find_orphans(r, v).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    ids = [f"pap{p}-table-{n}" for p in (1, 2) for n in (1, 2, 3, 7, 1023, 1024, 1025)] + ["no digits", "x-007", "x-7", "7", ""]
    visuals = [(rng.choice(ids), rng.choice([None, *range(0, 200, 5)]), rng.choice([None, None, *range(0, 300, 5)])) for _ in range(60)]
    refs = [(f"r{k}", rng.choice([None, *ids, "pap1-table-4", "pap3-table-1"]), rng.choice([None, *range(0, 300, 5)])) for k in range(300)]
    refs += refs[:40]
    assert run(spark, refs, visuals) == brute(refs, visuals)


def test_edges(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("a", "v-1", 1)], []) == {("a", "missing")}
    assert run(spark, [], [("v-1", 1, None)]) == set()
    # the moment of recording counts as live, the moment of withdrawal doesn't
    assert run(spark, [("a", "v-1", 5), ("b", "v-1", 9)], [("v-1", 5, 9)]) == {("b", "withdrawn")}
    long_id = "x" * 50_000 + "-1"
    assert run(spark, [("a", long_id, 5)], [(long_id, 1, None)]) == set()
    assert run(spark, [("a", "v-1", None)], [("v-1", 1, None)]) == {("a", "withdrawn")}


def test_runs_and_hot_id(spark):
    keys = spark.createDataFrame([(f"t-{k}",) for k in [1, 2, 3, 5, 1023, 1024, 1025, 99999999999999999]], "visual_id string")
    runs = {(r["prefix"], x["start"], x["end"]) for r in parent_runs(keys, "visual_id").collect() for x in r["runs"]}
    assert runs == {("t-", 1, 3), ("t-", 5, 5), ("t-", 1023, 1023), ("t-", 1024, 1025), ("t-", 99999999999999999, 99999999999999999)}
    wanted = spark.createDataFrame([(f"t-{k}",) for k in [0, 1, 3, 4, 5, 6, 1024, 2000]], "i string")
    assert {r[0] for r in missing_ids(wanted, "i", keys, "visual_id").collect()} == {"t-0", "t-4", "t-6", "t-2000"}
    refs = [(f"r{k}", "hot-1", k % 50) for k in range(2000)]
    assert run(spark, refs, [("hot-1", 10, 20)]) == brute(refs, [(("hot-1"), 10, 20)])
