import json

import pytest

from tabloom.sources import artifacts, specs
from tabloom.streaming.references import counts_by_month, missing_references

SPEC = {
    "document_title": "A & B", "table_caption": "Table 1. Baseline", "columns": ["Characteristics", "Overall", "p-value"], "paragraphs": ["One."], "footnotes": ["n <5"],
    "rows": [
        {"type": "continuous", "label": "Walking speed (m/s)", "values": ["1.14 (0.27)", "<0.05"]},
        {"type": "section_header", "label": "History"},
        {"type": "categorical", "label": "Sex", "levels": [{"label": "Male", "values": ["44 (44.0)", ""]}, {"label": "Female", "values": ["56 (56.0)", "0.3"]}]},
        {"type": "categorical_inline", "label": "Lives alone, yes", "values": ["31 (31.0)", "0.64"]},
    ],
}


def test_specification_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SPEC, indent=1))
    read = specs.read_specs(spark, str(tmp_path))
    rows = specs.display_rows(read).orderBy("body_row_idx").collect()
    assert [(r["row_type"], r["label"], r["variable_name"], r["indent_level"]) for r in rows] == [
        ("continuous", "Walking speed (m/s)", "walking_speed_m_s", 0), ("section_header", "History", "history", 0), ("categorical_parent", "Sex", "sex", 0), ("level", "Male", "sex", 1), ("level", "Female", "sex", 1), ("categorical_inline", "Lives alone, yes", "lives_alone_yes", 0)
    ]
    records = {(r["table_row_idx"], r["col_idx"]): (r["column_name"], r["raw_value"]) for r in specs.value_records(read).collect()}
    assert records[4, 1] == ("Overall", "44 (44.0)") and records[1, 2] == ("p-value", "<0.05") and len(records) == 8
    html = specs.to_html(read).first()["html"]
    assert "<h1>A &amp; B</h1>" in html and "<td>&lt;0.05</td>" in html and html.count("<tr") == 7


@pytest.mark.parametrize("change", [{"rows": [{"type": "other", "label": "x"}]}, {"columns": []}, {"table_caption": None}])
def test_bad_specification(spark, tmp_path, change):
    (tmp_path / "a.json").write_text(json.dumps(SPEC | change))
    with pytest.raises(Exception, match="not a table specification"):
        specs.read_specs(spark, str(tmp_path)).collect()


def test_artifacts(spark, tmp_path):
    root = str(tmp_path)
    assert artifacts.read_artifact(spark, root, "none") is None
    df = spark.createDataFrame([("p1", 1, None), ("p2", 2, [])], "paper_id string, n int, notes array<string>")
    artifacts.write_artifact(df, root, "notes")
    assert artifacts.read_artifact(spark, root, "notes", "p2").select("n").collect() == [(2,)]
    artifacts.write_json(df, f"{root}/json")
    assert sorted(map(str, artifacts.read_json(spark, f"{root}/json", df.schema).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        artifacts.reader("other")
    assert artifacts.reader("parquet")(spark, f"{root}/notes").count() == 2


def test_streamed_references(spark, tmp_path):
    rows = [("r1", "p", "v1", "resolved", "2024-01-01 00:00:00"), ("r2", "p", "v9", "resolved", "2024-01-02 00:00:00"), ("r3", "p", None, "resolved", "2024-01-03 00:00:00")]
    schema = "reference_id string, paper_id string, resolved_visual_id string, resolution_status string, observed_at string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    visuals = spark.createDataFrame([("v1",), (None,)], "visual_id string")
    for name, df, mode in (("gone", missing_references(stream, visuals), "append"), ("months", counts_by_month(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert [r["reference_id"] for r in spark.table("gone").collect()] == ["r2"]
    assert sum(r["n_references"] for r in spark.table("months").collect()) == 3
