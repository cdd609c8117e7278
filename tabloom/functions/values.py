"""The grammar of printed values as Column expressions: pattern families and typed components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens of the grammar. The note suffix is one class and a closing class, so it can't backtrack badly.
INTEGER = r"(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)"
UNSIGNED = INTEGER + r"(?:\.[0-9]+)?"
SIGNED = "-?" + UNSIGNED
MARKS = r"(?:[ *†‡§¶#{}|a-z]*[*†‡§¶#{}|a-z])?"
P_NUMBER = r"(?:0?\.[0-9]+|1\.0+)"

COUNT_PERCENT = rf"(?i)({INTEGER}) *\( *({UNSIGNED})(?: *%)? *\){MARKS}"
DECIMAL_PERCENT = rf"(?i)({UNSIGNED}) *\( *({UNSIGNED}) *% *\){MARKS}"
MEDIAN_RANGE = rf"(?i)({SIGNED}) *[(\[] *({SIGNED}) *, *({SIGNED}) *[)\]]{MARKS}"
BRACKETED = rf"(?i)({SIGNED}) *\( *({SIGNED}) *\){MARKS}"
PLUS_MINUS = rf"(?i)({SIGNED}) *(?:±|\+/-) *({SIGNED}){MARKS}"
SPACED_SIX = rf"(?i)({SIGNED}) +6 +({SIGNED}){MARKS}"
DASHED = rf"(?i)({SIGNED}) +- +({SIGNED}){MARKS}"
P_VALUE = rf"(?i)(?:p *[=:]? *)?(<=|>=|<|>)? *({P_NUMBER}){MARKS}"
WHOLE = rf"(?i)({INTEGER}){MARKS}"
DECIMAL = rf"(?i)({SIGNED}){MARKS}"
# What stands for a missing value.
MISSING = ["-", "--", "na", "n/a", "n.a.", "not available", "not estimable", "not estimated"]


def _full(text: Column, pattern: str) -> Column:
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return text.rlike(f"{flags}^(?:{body})$")


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _component(kind: Column | str, num: Column | None = None, text: Column | None = None, fragment: Column | None = None, relation: Column | None = None, confidence: float | Column = 0.0) -> Column:
    """A typed part; a number that has no other relation is equal to what it stands for."""
    none = F.lit(None)
    if num is not None and relation is None:
        relation = F.lit("=")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (none.cast("double") if num is None else num).alias("value_num"),
        (none.cast("string") if text is None else text).alias("value_text"),
        (none.cast("string") if fragment is None else fragment).alias("raw_fragment"),
        (none.cast("string") if relation is None else relation).alias("relation"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
    )


def parse_pattern(clean: Column) -> Column:
    """The first rule of the grammar that a cleaned value meets; null stays null."""
    return (
        F.when(clean.isNull(), None)
        .when(F.lower(clean).isin(MISSING), "missing")
        .when(_full(clean, COUNT_PERCENT) | _full(clean, DECIMAL_PERCENT), "count_parenthesized_percent")
        .when(_full(clean, MEDIAN_RANGE), "median_iqr")
        .when(_full(clean, BRACKETED), "numeric_parenthesized_uncertainty")
        .when(_full(clean, PLUS_MINUS), "numeric_plusminus_uncertainty")
        .when(_full(clean, SPACED_SIX), "numeric_spaced_six_uncertainty")
        .when(_full(clean, DASHED), "numeric_dash_uncertainty")
        .when(_full(clean, P_VALUE), "p_value")
        .when(_full(clean, WHOLE), "integer")
        .when(_full(clean, DECIMAL), "numeric_scalar")
        .otherwise("free_text")
    )


# Names of the summary styles whose companion is a standard deviation or a standard error.
SD_HINTS = ["mean_sd", "mean_s_d", "mean_standard_deviation"]
SE_HINTS = ["estimate_se", "mean_se", "estimate_standard_error", "mean_standard_error"]

#: The numbers of a value in order; a rule that was met says which part each is.
NUMBERS = r"(-?(?:[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)"


def with_components(df: DataFrame, raw: str, clean: str, style: str | None = None) -> DataFrame:
    """Adds ``pattern`` and ``components``, the typed parts of a printed value; ``style`` names a summary style hint.

    Explode the components with explode_outer: they are never empty, and an inner one makes Spark infer a filter that
    repeats the whole grammar.
    """
    c, pattern = F.col(clean), F.col("pattern")
    df = df.withColumn("pattern", parse_pattern(c)).withColumn("_n", F.regexp_extract_all(c, F.lit(NUMBERS), F.lit(1)))
    one, two, three = (F.get("_n", F.lit(k)) for k in range(3))
    two = F.when(pattern == "numeric_spaced_six_uncertainty", three).otherwise(two)
    first, second, third = number(one), number(two), number(three)
    hint = F.replace(F.lower(F.trim(F.col(style))), F.lit("-"), F.lit("_")) if style else F.lit(None).cast("string")
    sd, se = hint.isin(SD_HINTS), hint.isin(SE_HINTS)
    primary = F.when(sd, "mean").otherwise("estimate")
    spread = F.when(sd, "sd").when(se, "se").otherwise("unknown")
    sure = F.when(_full(c, FAMILY["mean_sd"]), 0.9).otherwise(0.88)
    relation = F.coalesce(F.nullif(F.regexp_extract(c, "(<=|>=|<|>)", 1), F.lit("")), F.lit("="))
    percent = F.concat(two, F.regexp_extract(c, r"( *%) *\)", 1))
    components = (
        F.when(pattern == "missing", F.array(_component("missing", fragment=c, confidence=0.95)))
        .when(pattern == "count_parenthesized_percent", F.array(_component("count", first, fragment=one, confidence=0.96), _component("percent", second, fragment=percent, confidence=0.96)))
        .when(pattern == "median_iqr", F.array(*[_component(k, n, fragment=f, confidence=0.94) for k, n, f in (("median", first, one), ("q1", second, two), ("q3", third, three))]))
        .when(pattern.startswith("numeric_") & (pattern != "numeric_scalar"), F.array(_component(primary, first, fragment=one, confidence=sure), _component(spread, second, fragment=two, confidence=F.when(sd | se, sure).otherwise(0.75))))
        .when(pattern == "p_value", F.array(_component("p_value", first, fragment=c, relation=relation, confidence=F.when(c.rlike("^[<>]"), 0.98).otherwise(0.85))))
        .when(pattern == "integer", F.array(_component("count", first, fragment=one, confidence=0.9)))
        .when(pattern == "numeric_scalar", F.array(_component("estimate", first, fragment=one, confidence=0.75)))
        .when(pattern == "free_text", F.array(_component("text", text=F.col(raw), fragment=F.col(raw), confidence=0.4)))
    )
    return df.withColumn("components", components).drop("_n")


def value_family(clean: Column) -> Column:
    """The summary family of a cleaned cell: median_iqr, count_pct, p_value, mean_sd, n_only or unknown, in this order."""
    bare = F.trim(F.regexp_replace(F.lower(clean), "^p *[=:]? *", ""))
    return (
        F.when(_full(bare, FAMILY["median_iqr"]), "median_iqr")
        .when(_full(bare, FAMILY["count_pct"]), "count_pct")
        .when(_full(bare, FAMILY["p_value"]), "p_value")
        .when(_full(clean, FAMILY["mean_sd"]), "mean_sd")
        .when(_full(clean, FAMILY["n_only"]), "n_only")
        .otherwise("unknown")
    )


FAMILY = {
    "median_iqr": rf"{SIGNED} *\( *{SIGNED} *, *{SIGNED} *\)",
    "count_pct": rf"(?:{INTEGER} *\( *{UNSIGNED}%? *\)|{UNSIGNED} *\( *{UNSIGNED}% *\))",
    "p_value": rf"(?i)(?:[<>]=? *)?{P_NUMBER}{MARKS}",
    "mean_sd": rf"{SIGNED}(?: *\( *{SIGNED} *\)| *± *{SIGNED}| +6 +{SIGNED}){MARKS}",
    "n_only": INTEGER,
}
