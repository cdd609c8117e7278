"""Review of variables by an outside client: payloads, replies, and checks that a reply speaks of the same records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A client gets a payload and gives a reply, both JSON text. It must pickle, as it is called in tasks.
Client = Callable[[str], str]


class StaticClient:
    """A client with canned replies by table id; others raise KeyError. For tests."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def __call__(self, payload: str) -> str:
        return self.replies[json.loads(payload)["table_id"]]


def review_payloads(variables: DataFrame, levels: DataFrame) -> DataFrame:
    """(table_id, payload): each table's variables in row order, with their levels, as one JSON object. Copies count once."""
    names = levels.select("variable_id", "level_label", "row_idx").distinct().groupBy("variable_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "level_label"))), lambda x: x["level_label"]).alias("levels"))
    own = variables.select("table_id", "variable_id", "variable_label", "variable_type", "row_start").distinct().join(names, "variable_id", "left")
    item = F.struct("row_start", "variable_id", F.col("variable_label").alias("label"), F.col("variable_type").alias("type"), F.coalesce("levels", F.array().cast("array<string>")).alias("levels"))
    tables = own.groupBy("table_id").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["row_start"] < b["row_start"], -1).when(a["row_start"] > b["row_start"], 1).when(a["variable_id"] < b["variable_id"], -1).when(a["variable_id"] > b["variable_id"], 1).otherwise(0)).alias("variables"))
    return tables.select("table_id", F.to_json(F.struct("table_id", "variables"), {"ignoreNullFields": "false"}).alias("payload"))


def _fault(payload: dict, reply: str) -> tuple[list[dict], str | None]:
    """The verdicts of a reply, or what is wrong with it: it must name the table and exactly its variables, once each."""
    try:
        said = json.loads(reply)
        verdicts = said["variables"]
        ids = [int(v["variable_id"]) for v in verdicts]
        scores = [None if v.get("plausibility") is None else float(v["plausibility"]) for v in verdicts]
    except (ValueError, KeyError, TypeError, AttributeError) as problem:
        return [], f"unreadable: {type(problem).__name__}"
    if said.get("table_id") != payload["table_id"]:
        return [], "other table"
    if sorted(ids) != sorted(v["variable_id"] for v in payload["variables"]):
        return [], "other variables"
    if any(s is not None and not 0 <= s <= 1 for s in scores):
        return [], "score out of range"
    return [{"variable_id": i, "plausibility": s, "note": v.get("note")} for i, s, v in zip(ids, scores, verdicts)], None


def review(payloads: DataFrame, client: Client) -> DataFrame:
    """table_id, status, problem, variable_id, plausibility, note: one row per verdict, or one per table that has none.

    status: success, provider_error if the client raised, validation_error if its reply doesn't fit. Each payload is sent
    once per attempt of its task; definitions are never changed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for table, payload in zip(frame["table_id"], frame["payload"]):
                empty = {"table_id": table, "variable_id": None, "plausibility": None, "note": None}
                try:
                    reply = client(payload)
                except Exception as problem:  # a provider may raise anything
                    rows.append(empty | {"status": "provider_error", "problem": type(problem).__name__})
                    continue
                verdicts, fault = _fault(json.loads(payload), reply)
                if fault:
                    rows.append(empty | {"status": "validation_error", "problem": fault})
                rows += [{"table_id": table, "status": "success", "problem": None} | v for v in verdicts]
            out = pd.DataFrame(rows, columns=["table_id", "status", "problem", "variable_id", "plausibility", "note"])
            yield out.astype({"variable_id": "Int64", "plausibility": "Float64"})

    return payloads.mapInPandas(run, "table_id string, status string, problem string, variable_id long, plausibility double, note string")
