"""Quantities recorded in different units, brought to each quantity's common unit.

A variable's unit is told by its hint, its label or its printed cells. Each unit of the variable's quantity is a candidate;
a calibrated forest of randomised trees, trained on the variables whose unit is recorded once and plainly, with some or all
of what they record hidden or falsified, gives each candidate's probability from what is recorded, how far the magnitude
and the spread in the common unit lie from what the label's entry usually shows, the style, the extractor, and what the same
paper and table use elsewhere. It decides where evidence is missing or sources disagree and judges what is recorded; unsure
cases go to review.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import units as U
from tabloom.functions.fold import HYPHENS, INVISIBLE, LOOKALIKES, SPACES, WIDE, bare, fold
from tabloom.functions.forest import CalibratedForest
from tabloom.functions.labels import stages, unit_tails, variants
from tabloom.functions.ngrams import NgramIndex
from tabloom.operators.packed import split_batch, split_values
from tabloom.runtime import checkpoint, reference_rows

#: Labelled variables the forest is trained on, the probability at which it decides a missing unit, and below which a recorded one is in doubt.
TRAINING_ROWS, CONFIDENT, DOUBT = 10_000, 0.9, 0.5
#: Keys over which the sums of a paper or table are spread.
SALT = 16
_NUMBER = re.compile(r"[<>≤≥]?\s*(-?\d[\d,]*(?:\.\d+)?|\.\d+)")


def read_cell(text: str) -> tuple[float | None, float | None, str | None]:
    """First number of a printed value, the number after it, and the unit between them."""
    folded = fold(text)
    numbers = [float(n.replace(",", "")) for n in _NUMBER.findall(folded)[:2]]
    return (numbers[0] if numbers else None), (numbers[1] if len(numbers) > 1 else None), U.cell_unit(folded)


#: A number that is no part of a word or of a power; a lost ± sign; a share in brackets; headers of columns without measured values.
_SIGNED = re.compile(r"(?<![^\W_])(?<![\d.,])(?<![^\W\d_]-)(?P<sign>[<>≤≥]=?)?\s*(?P<number>(?:(?<!\d)-)?(?:\d[\d,]*(?:\.\d+)?|\.\d+))")
_SIX, _SHARE = re.compile(r"(?<=\S)\s+6\s+(?=\d)"), re.compile(r"[(\[]\s*[<>≤≥]?\s*[\d.,]+\s*%\s*[)\]]")
_P_VALUE, _TENS = re.compile(r"\s*[pP]\s*[<>=≤≥]"), re.compile(r"\d\s+(?P<unit>10[ -]?[^\W\d_][^()\[\]±;|]*?)\s*(?=[(\[±]|\+/-|$)")
_DASH = re.compile(r"(?<=[\d)])\s*[-–]\s*(?=[\d.])")
STATISTIC_HEADER = r"(?i)^[*_ ]*p[ -]*(?:values?|(?:for )?trend)?[ *†‡§¶#_]*$|\bsmd\b|standardi[sz]ed (?:mean )?difference"


def read_values(text: str, parts: list[str] | None = None) -> list[tuple[float, float | None, float | None, float | None, str | None, str | None, bool]]:
    """(value, spread, low, high, relation, unit, share) of each value printed in a cell; a field may hold several.

    One number after the value is its spread, two are its low and high. share: the companion is a percentage.
    ``parts``: the values the field holds, if it has been split.
    """
    out = []
    for part in (split_values(text, frozenset()) if parts is None else parts) or [text]:
        plain = fold(part).replace("−", "-")
        if _P_VALUE.match(plain):
            continue
        tens = _TENS.search(plain)
        unit = tens["unit"] if tens and U.readings(tens["unit"]) else U.cell_unit(plain)
        if unit:
            at = plain.index(unit)
            plain = f"{plain[:at]} {plain[at + len(unit):]}"
        share = _SHARE.search(plain) is not None
        found = list(_SIGNED.finditer(_DASH.sub(" – ", _SIX.sub(" ± ", plain))))
        numbers = [float(f["number"].replace(",", "")) for f in found[:3]]
        if numbers:
            spread = numbers[1] if len(numbers) == 2 else None
            out.append((numbers[0], spread, *(numbers[1:3] if len(numbers) == 3 else (None, None)), found[0]["sign"], unit, share))
    return out


def _unit_of(text: str | None, units: dict[str, int]) -> int | None:
    """The one unit of a quantity that a text stands for."""
    if not text:
        return None
    said = {units[s.lower()] for s in U.readings(text) if s.lower() in units}
    return said.pop() if len(said) == 1 else None


def _label_unit(label: str, units: dict[str, int]) -> int | None:
    for text in dict.fromkeys((label, stages(label)[1])):
        for _, tail in unit_tails(text):
            unit = _unit_of(tail, units)
            if unit is not None:
                return unit
    return None


def _symbols(unit_ref: DataFrame) -> dict[str, dict[str, int]]:
    units: dict[str, dict[str, int]] = {}
    for r in reference_rows(unit_ref.select("unit_id", "quantity", "symbol")):
        units.setdefault(r["quantity"], {})[r["symbol"].lower()] = r["unit_id"]
    return units


def measured_variables(variables: DataFrame, canon: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """Variables with a quantity: variable_id, table_id, row_start, style, canon_id, quantity, hint_unit, label_unit.

    One row per variable whose label means an entry with a quantity, whatever its type; copies count once.
    The canonical list and the units are reference lists of checked size. Each distinct label is looked up once.
    """
    entries = reference_rows(canon.where("label_kind = 'variable'").select("canon_id", "canon_text", "aliases", "quantity"))
    quantity = {r["canon_id"]: r["quantity"] for r in entries}
    named = [(r["canon_id"], bare(n)) for r in entries for n in [r["canon_text"], *(r["aliases"] or [])] if n]
    units = _symbols(unit_ref)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = NgramIndex(named)
        for batch in batches:
            rows: list[tuple] = []
            for label in batch.column("variable_label").to_pylist():
                entry = index.best(*variants(label, U.is_unit))[0] if label.strip() else 0
                of = quantity.get(entry)
                if of is not None and of in units:
                    rows.append((label, entry, of, _label_unit(label, units[of])))
            types = (pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["variable_label", "canon_id", "quantity", "label_unit"])

    def hints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["variable_id", "table_id", "row_start", "style", "canon_id", "quantity", "label_unit"]
        for batch in batches:
            said = [_unit_of(h, units[of]) for h, of in zip(batch.column("units_hint").to_pylist(), batch.column("quantity").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(said, pa.int32())], names=[*kept, "hint_unit"])

    tasks = int(variables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = variables.where("variable_label is not null").select("variable_id", "table_id", "variable_label", "units_hint", "row_start", F.col("summary_style_hint").alias("style"))
    found = narrow.select("variable_label").distinct().repartition(tasks, "variable_label").mapInArrow(labels, "variable_label string, canon_id int, quantity string, label_unit int")
    joined = narrow.distinct().join(found.hint("merge"), "variable_label")
    schema = "variable_id long, table_id string, row_start int, style string, canon_id int, quantity string, label_unit int, hint_unit int"
    return checkpoint(joined.mapInArrow(hints, schema))


def recorded_units(measured: DataFrame, cells: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """What is recorded of each measured variable: variable_id, table_id, canon_id, quantity, hint_unit, label_unit, cell_unit, magnitude, spread, style, extractor, paper."""
    units = _symbols(unit_ref)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, spread, unit = [], [], []
            for text, of in zip(batch.column("text").to_pylist(), batch.column("quantity").to_pylist()):
                first, second, said = read_cell(text) if text else (None, None, None)
                value.append(first)
                spread.append(second)
                unit.append(_unit_of(said, units[of]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("variable_id"), batch.column("extractor"), batch.column("paper"), batch.column("col_idx"), pa.array(value, pa.float64()), pa.array(spread, pa.float64()), pa.array(unit, pa.int32())],
                names=["variable_id", "extractor", "paper", "col_idx", "value", "spread", "unit"],
            )

    paper = F.col("paper_id") if "paper_id" in cells.columns else F.lit(None).cast("string")
    printed = cells.where("col_idx > 0").select("table_id", F.col("row_idx").alias("row_start"), "col_idx", "text", F.col("extractor_name").alias("extractor"), paper.alias("paper"))
    read_cells = (
        measured.select("variable_id", "table_id", "row_start", "quantity").join(printed, ["table_id", "row_start"])
        .select("variable_id", "quantity", "extractor", "paper", "col_idx", "text")
        .mapInArrow(read, "variable_id long, extractor string, paper string, col_idx int, value double, spread double, unit int")
    )
    # several values of a variable: the unit most of them print, the middle magnitude
    told = read_cells.groupBy("variable_id").agg(
        F.mode("unit", True).alias("cell_unit"), F.percentile_approx("value", 0.5).alias("magnitude"), F.percentile_approx("spread", 0.5).alias("spread"), F.min("extractor").alias("extractor"), F.min("paper").alias("paper")
    )
    return measured.join(told, "variable_id", "left").drop("row_start")


def _features(df: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """What is recorded, with the share of common units that the same table and paper record elsewhere."""
    common = F.broadcast(unit_ref.where("is_common").select(F.col("unit_id").alias("plain"), F.lit(1.0).alias("is_plain")))
    df = df.withColumn("plain", F.coalesce("hint_unit", "label_unit", "cell_unit")).join(common, "plain", "left")
    df = df.withColumn("known", F.col("plain").isNotNull().cast("double")).withColumn("is_plain", F.coalesce("is_plain", F.lit(0.0)))
    df = df.withColumn("salt", F.pmod(F.xxhash64("variable_id"), F.lit(SALT))).withColumn("paper", F.coalesce("paper", F.concat(F.lit("\x00"), "table_id")))
    for name, key in (("table", "table_id"), ("paper", "paper")):
        # one paper may hold a large share of all rows: its sum is spread, not its rows gathered
        sums = df.groupBy(key).agg(F.sum("known").alias(f"{name}_known"), F.sum("is_plain").alias(f"{name}_plain"))
        spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        df = df.join(spread.hint("merge"), [key, "salt"], "left")
        rest = F.col(f"{name}_known") - F.col("known")
        df = df.withColumn(f"{name}_share", F.when(rest > 0, (F.col(f"{name}_plain") - F.col("is_plain")) / rest).otherwise(0.5))
    return df.select(
        "variable_id", "table_id", "canon_id", "quantity", "hint_unit", "label_unit", "cell_unit", "magnitude", "spread", "table_share", "paper_share",
        F.pmod(F.hash(F.coalesce("style", F.lit(""))), F.lit(64)).cast("double").alias("style_code"),
        F.pmod(F.hash(F.coalesce("extractor", F.lit(""))), F.lit(64)).cast("double").alias("extractor_code"),
    )


_SAID = ["hint_unit", "label_unit", "cell_unit"]


class UnitModel:
    """Probability of each unit of a variable's quantity. ``units``: quantity to (unit_id, factor, shift, is_common) each."""

    def __init__(self, sample: pd.DataFrame, units: dict[str, list[tuple[int, float, float, bool]]]):
        self.units = units
        self.typical: dict[int, tuple[float, float]] = {}
        self.usual: dict[tuple[int, int], float] = {}
        self.forest = None
        if not len(sample):
            return
        known = {u: (f, s) for rows in units.values() for u, f, s, _ in rows}
        factor, shift = (sample["unit"].map({u: x[k] for u, x in known.items()}).to_numpy(float) for k in (0, 1))
        middle = pd.DataFrame({"canon_id": sample["canon_id"], "size": self._log(sample["magnitude"].to_numpy(float) * factor + shift), "spread": self._log(sample["spread"].to_numpy(float) * factor)})
        self.typical = {int(k): (r["size"], r["spread"]) for k, r in middle.groupby("canon_id").median().iterrows()}
        counts = sample.groupby(["canon_id", "unit"]).size()
        totals = sample.groupby("canon_id").size()
        self.usual = {(int(c), int(u)): n / totals[c] for (c, u), n in counts.items()}
        rng = np.random.default_rng(11)
        shown = []
        for share_hidden, falsified in ((0.0, False), (1.0, False), (0.5, False), (0.0, True)):
            part = sample.copy()
            for name in _SAID:
                part.loc[rng.random(len(part)) < share_hidden, name] = np.nan
            if falsified:  # one source is wrong
                wrong = pd.Series([rng.choice([u for u, *_ in units[of]]) for of in part["quantity"]], index=part.index)
                which = rng.integers(0, 3, len(part))
                for k, name in enumerate(_SAID):
                    part.loc[which == k, name] = wrong[which == k]
            shown.append(part)
        rows = pd.concat(shown, ignore_index=True)
        x, owner, unit = self.inputs(rows)
        y = (unit == rows["unit"].to_numpy(int)[owner]).astype(int)
        if 0 < y.sum() < len(y):
            self.forest = CalibratedForest.fit(x, y, rows["variable_id"].to_numpy()[owner], depth=9, n_trees=32)

    @staticmethod
    def _log(values: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(np.abs(values), 1e-6))

    def inputs(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of each candidate, the row it belongs to, and its unit."""
        candidates = [self.units.get(of, []) for of in frame["quantity"]]
        size = np.array([len(c) for c in candidates])
        owner = np.repeat(np.arange(len(frame)), size)
        unit, factor, shift, common = (np.array([u[k] for c in candidates for u in c], dtype=float) for k in range(4))
        canon = frame["canon_id"].to_numpy(int)[owner]
        typical = np.array([self.typical.get(c, (np.nan, np.nan)) for c in frame["canon_id"]], dtype=float).reshape(-1, 2)[owner]
        columns = []
        for name in _SAID:
            said = frame[name].to_numpy(float)[owner]
            columns.append(np.where(np.isnan(said), 0.0, np.where(said == unit, 1.0, -1.0)))
        magnitude, spread = frame["magnitude"].to_numpy(float)[owner], frame["spread"].to_numpy(float)[owner]
        for value, usual in ((magnitude * factor + shift, typical[:, 0]), (spread * factor, typical[:, 1])):
            away = self._log(value) - usual
            columns += [np.nan_to_num(away), np.nan_to_num(np.abs(away)), np.isnan(away).astype(float)]
        for name in ("table_share", "paper_share"):
            share = frame[name].to_numpy(float)[owner]
            columns.append(np.where(common == 1.0, share, 1.0 - share))
        columns += [common, np.array([self.usual.get((c, int(u)), 0.0) for c, u in zip(canon, unit)])]
        columns += [frame["style_code"].to_numpy(float)[owner], frame["extractor_code"].to_numpy(float)[owner]]
        return np.column_stack(columns) if len(owner) else np.zeros((0, 15)), owner, unit.astype(int)

    def chances(self, frame: pd.DataFrame) -> list[dict[int, float]]:
        """For each row its candidates' probabilities, adding up to 1; empty without a model or for a quantity without units."""
        out: list[dict[int, float]] = [{} for _ in range(len(frame))]
        if self.forest is None or not len(frame):
            return out
        x, owner, unit = self.inputs(frame)
        if len(owner):
            p = self.forest.predict(x)[:, list(self.forest.classes).index(1)]
            p = p / np.bincount(owner, weights=p, minlength=len(frame))[owner]
            for o, u, v in zip(owner.tolist(), unit.tolist(), p.tolist()):
                out[o][u] = v
        return out


def _labelled(rows: DataFrame) -> DataFrame:
    """Variables with a magnitude whose recorded unit is one, as ``unit``."""
    plain = F.coalesce("hint_unit", "label_unit", "cell_unit")
    agreed = plain.isNotNull() & (F.coalesce("hint_unit", plain) == plain) & (F.coalesce("label_unit", plain) == plain) & (F.coalesce("cell_unit", plain) == plain)
    return rows.where(agreed & F.col("magnitude").isNotNull()).withColumn("unit", plain)


def _sample(rows: DataFrame, size: int) -> pd.DataFrame:
    """About ``size`` rows or all if there are fewer, drawn by a hash of the id, so that no task sends more than its share."""
    share = size / max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("variable_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
    return drawn.limit(2 * size).toPandas().sort_values("variable_id", ignore_index=True)


def _known_units(unit_ref: DataFrame) -> dict[str, list[tuple[int, float, float, bool]]]:
    out: dict[str, list[tuple[int, float, float, bool]]] = {}
    for r in sorted(reference_rows(unit_ref.select("unit_id", "quantity", "factor", "shift", "is_common")), key=lambda r: r["unit_id"]):
        if r["quantity"] is not None:
            out.setdefault(r["quantity"], []).append((r["unit_id"], r["factor"], r["shift"], r["is_common"]))
    return out


def assign_units(variables: DataFrame, cells: DataFrame, canon: DataFrame, unit_ref: DataFrame, training_rows: int = TRAINING_ROWS, confident: float = CONFIDENT, measured: DataFrame | None = None) -> DataFrame:
    """One row per measured variable: variable_id, table_id, canon_id, quantity, unit_id, source, probability, magnitude.

    source: ``recorded`` if all that is recorded agrees and the forest finds it likely, ``doubtful`` if it doesn't,
    ``conflict`` if recorded units differ and the forest picked among them, ``predicted`` if none is recorded and the forest
    is sure, else ``review`` with unit_id null. The forest is fitted on about ``training_rows`` variables with one plain
    unit, drawn by a hash of their id; it is applied to all. Without labelled variables what is recorded stands, the hint
    first. Null labels and labels without quantity give no row. ``measured``: what measured_variables gave, if that is known.
    """
    measured = measured_variables(variables, canon, unit_ref) if measured is None else measured
    rows = checkpoint(_features(checkpoint(recorded_units(measured, cells, unit_ref)), unit_ref))
    model = UnitModel(_sample(_labelled(rows), training_rows), _known_units(unit_ref))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            unit, source, probability = [], [], []
            for said, chances, magnitude in zip(frame[_SAID].to_numpy(float).tolist(), model.chances(frame), frame["magnitude"].tolist()):
                told = dict.fromkeys(int(u) for u in said if u == u)
                options = told or chances
                best = max(options, key=lambda u: chances.get(u, 0.0), default=None)
                chance = chances.get(best)
                if told:
                    kind = "conflict" if len(told) > 1 else "recorded" if chance is None or chance >= DOUBT else "doubtful"
                else:
                    kind = "predicted" if chance is not None and magnitude == magnitude and chance >= confident else "review"
                unit.append(None if kind == "review" else best)
                source.append(kind)
                probability.append(chance)
            yield pd.DataFrame({**{c: frame[c] for c in ("variable_id", "table_id", "canon_id", "quantity")}, "unit_id": pd.array(unit, dtype="Int32"), "source": source, "probability": pd.array(probability, dtype="Float64"), "magnitude": frame["magnitude"]})

    return rows.mapInPandas(decide, "variable_id long, table_id string, canon_id int, quantity string, unit_id int, source string, probability double, magnitude double")


def hidden_unit_report(variables: DataFrame, cells: DataFrame, canon: DataFrame, unit_ref: DataFrame, training_rows: int = TRAINING_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """How well missing units are predicted: quantity, n, n_confident, n_right, mean_probability.

    Variables with one plainly recorded unit whose id is divisible by 5 are held out of training and judged with all that
    they record hidden. n_right and mean_probability (of the confident ones) agree if the forest is calibrated.
    """
    rows = checkpoint(_features(checkpoint(recorded_units(measured_variables(variables, canon, unit_ref), cells, unit_ref)), unit_ref))
    labelled = _labelled(rows)
    model = UnitModel(_sample(labelled.where("variable_id % 5 <> 0"), training_rows), _known_units(unit_ref))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [max(c.items(), key=lambda x: x[1], default=(None, 0.0)) for c in model.chances(frame.assign(**dict.fromkeys(_SAID, np.nan)))]
            yield pd.DataFrame({"quantity": frame["quantity"], "probability": [p for _, p in best], "is_right": [int(u == t) for (u, _), t in zip(best, frame["unit"])]})

    sure = F.col("probability") >= confident
    judged = labelled.where("variable_id % 5 = 0").mapInPandas(judge, "quantity string, probability double, is_right int")
    return judged.groupBy("quantity").agg(F.count("*").alias("n"), F.count(F.when(sure, 1)).alias("n_confident"), F.sum(F.when(sure, F.col("is_right")).otherwise(0)).alias("n_right"), F.round(F.avg(F.when(sure, F.col("probability"))), 4).alias("mean_probability"))


def common_values(assigned: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """The assigned variables with their middle value in the quantity's common unit: adds common_value."""
    factors = F.broadcast(unit_ref.select("unit_id", "factor", "shift"))
    return assigned.join(factors, "unit_id", "left").withColumn("common_value", F.col("magnitude") * F.col("factor") + F.col("shift")).drop("factor", "shift")


def printed_values(measured: DataFrame, cells: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """(variable_id, col_idx, pos, value, spread, low, high, relation, said_unit): every value printed in a variable's row.

    Several values packed in a cell have their own pos. Copies of a cell count once. Columns of p values and of standardised
    differences hold no measured values, nor does a count with its percentage; cells without a number give no row.
    """
    units = _symbols(unit_ref)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            texts = batch.column("text").to_pylist()
            offsets, parts = split_batch([t or "" for t in texts], frozenset())
            parts = parts.to_pylist()
            for row, (text, of) in enumerate(zip(texts, batch.column("quantity").to_pylist())):
                for pos, (*numbers, relation, unit, share) in enumerate(read_values(text, parts[offsets[row] : offsets[row + 1]]) if text else []):
                    if not share or "%" in units[of]:
                        owner.append(row)
                        rows.append((pos, *numbers, relation, _unit_of(unit, units[of])))
            columns = zip(*rows) if rows else [[]] * 7
            types = [pa.int32(), *[pa.float64()] * 4, pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(pa.array(owner, pa.int64())) for n in ("variable_id", "col_idx")), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                names=["variable_id", "col_idx", "pos", "value", "spread", "low", "high", "relation", "said_unit"],
            )

    plain = {chr(c + WIDE): chr(c) for c in range(0x21, 0x7F)} | LOOKALIKES | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-")
    header = F.regexp_replace(F.trim(F.translate("text", "".join(plain) + INVISIBLE, "".join(plain.values()))), r"\s+", " ")
    statistics = cells.where((F.col("col_idx") > 0) & (F.length("text") <= 60) & header.rlike(STATISTIC_HEADER)).select("table_id", "col_idx").distinct()
    printed = cells.where("col_idx > 0").select("table_id", F.col("row_idx").alias("row_start"), "col_idx", "text").join(statistics, ["table_id", "col_idx"], "left_anti")
    rows = measured.select("variable_id", "table_id", "row_start", "quantity").join(printed, ["table_id", "row_start"]).select("variable_id", "col_idx", "quantity", "text")
    return rows.mapInArrow(read, "variable_id long, col_idx int, pos int, value double, spread double, low double, high double, relation string, said_unit int").distinct()


def converted_values(assigned: DataFrame, printed: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """Every printed value of the assigned variables, also in the quantity's common unit; a unit that is not known gives nulls.

    Adds common_value, common_spread, common_low and common_high. A cell that prints its own unit is read in it, but where
    sources disagree the unit picked for the variable counts. Values, lows and highs take factor and shift, spreads the factor.
    """
    known = assigned.drop("magnitude").join(printed, "variable_id")
    own = F.when(F.col("source") == "conflict", F.col("unit_id")).otherwise(F.coalesce("said_unit", "unit_id"))
    out = known.withColumn("unit_id", own).drop("said_unit").join(F.broadcast(unit_ref.select("unit_id", "factor", "shift")), "unit_id", "left")
    for name in ("value", "spread", "low", "high"):
        out = out.withColumn(f"common_{name}", F.col(name) * F.col("factor") + (F.lit(0.0) if name == "spread" else F.col("shift")))
    return out.drop("factor", "shift")
