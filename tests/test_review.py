import json

from tabloom.operators.review import StaticClient, review, review_payloads


def test_review(spark):
    v = spark.createDataFrame([(1, "a", "Sex", "categorical", 3), (2, "a", "Age", "continuous", 1), (2, "a", "Age", "continuous", 1), (3, "b", None, None, 1), (4, "c", "X", "binary", 1), (5, "d", "Y", "binary", 1)], "variable_id long, table_id string, variable_label string, variable_type string, row_start int")
    lv = spark.createDataFrame([(1, "Female", 5), (1, "Male", 4), (1, "Male", 4)], "variable_id long, level_label string, row_idx int")
    payloads = review_payloads(v, lv)
    first = json.loads(payloads.where("table_id = 'a'").first()["payload"])
    assert [(x["variable_id"], x["levels"]) for x in first["variables"]] == [(2, []), (1, ["Male", "Female"])]
    replies = {
        "a": json.dumps({"table_id": "a", "variables": [{"variable_id": 1, "plausibility": 0.9}, {"variable_id": 2, "plausibility": None, "note": "?"}]}),
        "b": json.dumps({"table_id": "b", "variables": [{"variable_id": 9, "plausibility": 0.9}]}),
        "c": "not json",
    }
    out = {(r["table_id"], r["variable_id"]): (r["status"], r["problem"]) for r in review(payloads, StaticClient(replies)).collect()}
    assert out == {
        ("a", 1): ("success", None), ("a", 2): ("success", None), ("b", None): ("validation_error", "other variables"), ("c", None): ("validation_error", "unreadable: JSONDecodeError"), ("d", None): ("provider_error", "KeyError")
    }
    assert review(payloads.limit(0), StaticClient({})).count() == 0
