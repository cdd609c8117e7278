import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.operators.nested import JsonIndex, boundary_nodes, grid_cells, is_json, json_nodes

values = st.recursive(
    st.none() | st.booleans() | st.integers(-999, 999) | st.text(alphabet='ab"\\[]{},: \né', max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(alphabet='k"\\{,', max_size=3), c, max_size=4), max_leaves=12
)


def walk(value, key=None, ordinal=0):
    yield key, ordinal, {dict: "{", list: "["}.get(type(value), json.dumps(value) if not isinstance(value, str) else value)
    items = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
    for n, (k, v) in enumerate(items):
        yield from walk(v, k, n)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=4), st.sampled_from([None, 1]))
def test_index_finds_every_element(docs, indent):
    texts = [json.dumps(d, indent=indent, ensure_ascii=False).encode() for d in docs]
    index = JsonIndex(texts)
    for n, doc in enumerate(docs):
        mine = [i for i in range(len(index.doc)) if index.doc[i] == n]
        got = sorted(
            (str(index.key(i)), int(index.ordinal[i]), {123: "{", 91: "["}.get(int(index.kind[i]), str(json.loads(index.value(i)) if index.kind[i] == 34 else index.value(i)))) for i in mine
        )
        assert got == sorted((str(k), o, v) for k, o, v in walk(doc))
        for i in mine:
            p = index.parent[i]
            assert (p == -1) == (i == mine[0]) and (p == -1 or index.start[p] < index.start[i] < index.end[i] <= index.end[p])


def strict(_):
    raise ValueError


def parses(text):
    try:
        json.loads(text, parse_constant=strict)
        return True
    except ValueError:
        return False


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet='{}[]:,"\\ u0e-1.tn', max_size=8), values.map(json.dumps), st.tuples(values.map(json.dumps), st.integers(0, 30), st.sampled_from(['', ',', '"', '}', ']', ':', '\\', '0', 'x', '\n', '\t']))), min_size=1, max_size=5))
def test_validity_is_that_of_a_parser(docs):
    texts = [d if isinstance(d, str) else d[0][: d[1]] + d[2] + d[0][d[1] + 1 :] for d in docs]
    assert JsonIndex([t.encode() for t in texts]).valid.tolist() == [parses(t) for t in texts]


def boundary(**more):
    return {"canonical_y": 1.5, "table_coverage_fraction": 0.5, **more}


RULE = {"source": "rule_segment", "source_index": 3, "canonical_segment": [1, 2, 3, 4]}
SHAPES = [
    {"table_id": "t", "boundary_candidates": [boundary(rule_references=[RULE, None, RULE]), None, boundary()]},
    [{"table_id": "t", "boundary_candidates": {"0": boundary(rule_references={"0": RULE, "2": RULE}), "2": boundary(rule_references=None)}}],
    {"proposals": [{"boundary_candidates": json.dumps([boundary(rule_references=json.dumps([RULE, None, RULE])), None, boundary(rule_references=[])]), "table_id": "t"}]},
    {"payload": {"run": 1, "boundary_proposal": {"table_id": "t", "boundary_candidates": [boundary(rule_references=[RULE, None, RULE]), None, boundary(other={"rule_references": [RULE]})]}}},
]


def test_shapes_give_the_same_nodes(spark):
    want = {("boundary", "t", 0, -1), ("boundary", "t", 2, -1), ("rule", "t", 0, 0), ("rule", "t", 0, 2)}
    for shape in [*SHAPES, json.dumps(SHAPES[0])]:
        df = spark.createDataFrame([(json.dumps(shape, indent=1), "clash")], "payload string, table_id string")
        assert {tuple(r)[:4] for r in boundary_nodes(df).collect()} == want, shape


def test_single_entries_and_bad_payloads(spark):
    one = {"table_id": "t", "boundary_candidates": boundary(rule_references=RULE)}
    rows = [json.dumps(one), None, "", "{", json.dumps(one)[:-1], "NaN", "null", "{}", '{"boundary_candidates": null}', '{"boundary_candidates": []}']
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    assert {tuple(r)[:4] for r in boundary_nodes(df).collect()} == {("boundary", "t", 0, -1), ("rule", "t", 0, 0)}
    assert boundary_nodes(df.limit(0)).count() == 0
    assert not is_json("[NaN]") and is_json("[1e5]")


def test_generic_nodes_link_to_parents(spark):
    df = spark.createDataFrame([(7, '{"a": [1, {"b": "x"}], "c": "[2]"}'), (8, None), (9, "nope")], "id long, node string")
    out = {r["node"]: r for r in json_nodes(df, "id", "node").collect()}
    assert {r["record_id"] for r in out.values()} == {7}
    x = next(r for r in out.values() if r["value"] == "x")
    assert out[x["parent"]]["kind"] == "object" and out[out[x["parent"]]["parent"]]["key"] == "a"
    two = next(r for r in out.values() if r["value"] == "2")
    assert out[out[two["parent"]]["parent"]]["key"] == "c"


def test_grid_cells(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"table_id string, positioned_evidence struct<canonical_grid_cell_bboxes:array<array<{box}>>>, pos1 int, box int"
    b = (1.0, 2.0, 3.0, 4.0)
    df = spark.createDataFrame([("t", ([[None, b], None, [], [b]],), 1, 1), ("u", (None,), 1, 1), ("v", None, 1, 1)], schema)
    assert {tuple(r)[:3] for r in grid_cells(df).collect()} == {("t", 0, 1), ("t", 3, 0)}
