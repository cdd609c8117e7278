"""The grammar of printed values as SQL, written out from its rules and apart from the engine's patterns."""

from __future__ import annotations

_N = r"(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?"
_I = r"(?:\d{1,3}(?:,\d{3})*|\d+)"
_S = rf"-?{_N}"
_T = r"(?:\s*(?:[*†‡§¶#{}|]+|[a-z]))*"
_P = r"(?:0?\.\d+|1\.0+)"


def pattern(c: str) -> str:
    """The rule that a cleaned column meets first."""
    return f"""case when {c} is null then null
    when lower({c}) in ('-', '--', 'na', 'n/a', 'n.a.', 'not available', 'not estimable', 'not estimated') then 'missing'
    when regexp_full_match({c}, '(?i){_I}\\s*\\(\\s*{_N}(\\s*%)?\\s*\\){_T}') or regexp_full_match({c}, '(?i){_N}\\s*\\(\\s*{_N}\\s*%\\s*\\){_T}') then 'count_parenthesized_percent'
    when regexp_full_match({c}, '(?i){_S}\\s*[(\\[]\\s*{_S}\\s*,\\s*{_S}\\s*[)\\]]{_T}') then 'median_iqr'
    when regexp_full_match({c}, '(?i){_S}\\s*\\(\\s*{_S}\\s*\\){_T}') then 'numeric_parenthesized_uncertainty'
    when regexp_full_match({c}, '(?i){_S}\\s*(±|\\+/-)\\s*{_S}{_T}') then 'numeric_plusminus_uncertainty'
    when regexp_full_match({c}, '(?i){_S}\\s+6\\s+{_S}{_T}') then 'numeric_spaced_six_uncertainty'
    when regexp_full_match({c}, '(?i){_S}\\s+-\\s+{_S}{_T}') then 'numeric_dash_uncertainty'
    when regexp_full_match({c}, '(?i)(p\\s*[=:]?\\s*)?(<=|>=|<|>)?\\s*{_P}{_T}') then 'p_value'
    when regexp_full_match({c}, '(?i){_I}{_T}') then 'integer'
    when regexp_full_match({c}, '(?i){_S}{_T}') then 'numeric_scalar' else 'free_text' end"""


def _number(c: str, regex: str) -> str:
    return f"try_cast(replace(regexp_extract({c}, '{regex}', 1), ',', '') as double)"


def first(c: str, p: str) -> str:
    """The first number of a value whose rule is ``p``."""
    return f"""case when {p} in ('missing', 'free_text') then null when {p} = 'p_value' then {_number(c, f"(?i)(?:p|=|:|<|>|^|[ ])({_P}){_T}$")}
    when {p} in ('integer', 'numeric_scalar') then {_number(c, f"(?i)^({_S}){_T}$")}
    when {p} in ('count_parenthesized_percent', 'median_iqr', 'numeric_parenthesized_uncertainty') then {_number(c, f"^({_S})[ ]*[(\\[]")}
    when {p} = 'numeric_plusminus_uncertainty' then {_number(c, f"^({_S})[ ]*(?:±|\\+/-)")} when {p} = 'numeric_spaced_six_uncertainty' then {_number(c, f"^({_S}) +6 ")}
    when {p} = 'numeric_dash_uncertainty' then {_number(c, f"^({_S}) +- ")} end"""


def second(c: str, p: str) -> str:
    return f"""case when {p} in ('count_parenthesized_percent', 'numeric_parenthesized_uncertainty') then {_number(c, f"\\( *({_S}) *%? *\\)")}
    when {p} = 'median_iqr' then {_number(c, f"[(\\[] *({_S}) *,")} when {p} = 'numeric_plusminus_uncertainty' then {_number(c, f"(?i)(?:±|\\+/-) *({_S}){_T}$")}
    when {p} = 'numeric_spaced_six_uncertainty' then {_number(c, f"(?i) 6 +({_S}){_T}$")} when {p} = 'numeric_dash_uncertainty' then {_number(c, f"(?i) - +({_S}){_T}$")} end"""


def third(c: str, p: str) -> str:
    return f"""case when {p} = 'median_iqr' then {_number(c, f", *({_S}) *[)\\]]{_T}$".replace(", *", "(?i), *", 1))} end"""


def relation(c: str) -> str:
    return f"case when contains({c}, '<=') then '<=' when contains({c}, '>=') then '>=' when contains({c}, '<') then '<' when contains({c}, '>') then '>' else '=' end"


def components(source: str, columns: str, style: str = "'none'") -> str:
    """Rows of components of a source with columns clean and pattern."""
    p, h = "pattern", f"replace(lower(trim({style})), '-', '_')"
    pair = "pattern like 'numeric%uncertainty'"
    mean_sd = f"regexp_full_match(clean, '{_S}( *\\( *{_S} *\\)| *± *{_S}| +6 +{_S}){_T}')"
    sure = f"case when {mean_sd} then 0.9 else 0.88 end"
    sd, se = f"{h} in ('mean_sd', 'mean_s_d', 'mean_standard_deviation')", f"{h} in ('estimate_se', 'mean_se', 'estimate_standard_error', 'mean_standard_error')"
    rows = [
        ("pattern = 'missing'", 0, "'missing'", "cast(null as double)", "null", "0.95"),
        ("pattern = 'count_parenthesized_percent'", 0, "'count'", first("clean", p), "'='", "0.96"),
        ("pattern = 'count_parenthesized_percent'", 1, "'percent'", second("clean", p), "'='", "0.96"),
        ("pattern = 'median_iqr'", 0, "'median'", first("clean", p), "'='", "0.94"),
        ("pattern = 'median_iqr'", 1, "'q1'", second("clean", p), "'='", "0.94"),
        ("pattern = 'median_iqr'", 2, "'q3'", third("clean", p), "'='", "0.94"),
        (pair, 0, f"case when {sd} then 'mean' else 'estimate' end", first("clean", p), "'='", sure),
        (pair, 1, f"case when {sd} then 'sd' when {se} then 'se' else 'unknown' end", second("clean", p), "'='", f"case when {sd} or {se} then {sure} else 0.75 end"),
        ("pattern = 'p_value'", 0, "'p_value'", first("clean", p), relation("clean"), "case when clean like '<%' or clean like '>%' then 0.98 else 0.85 end"),
        ("pattern = 'integer'", 0, "'count'", first("clean", p), "'='", "0.9"),
        ("pattern = 'numeric_scalar'", 0, "'estimate'", first("clean", p), "'='", "0.75"),
        ("pattern = 'free_text'", 0, "'text'", "cast(null as double)", "null", "0.4"),
    ]
    return " union all ".join(f"select {columns}, {n} as ordinal, {kind} as kind, {value} as value_num, {rel} as relation, cast({conf} as double) as confidence from {source} where {test}" for test, n, kind, value, rel, conf in rows)


def family(c: str) -> str:
    low = f"trim(regexp_replace(lower({c}), '^p *[=:]? *', ''))"
    return f"""case when regexp_full_match({low}, '{_S} *\\( *{_S} *, *{_S} *\\)') then 'median_iqr'
    when regexp_full_match({low}, '{_I} *\\( *{_N}%? *\\)') or regexp_full_match({low}, '{_N} *\\( *{_N}% *\\)') then 'count_pct'
    when regexp_full_match({low}, '(?i)([<>]=? *)?{_P}{_T}') then 'p_value'
    when regexp_full_match({c}, '{_S}( *\\( *{_S} *\\)| *± *{_S}| +6 +{_S}){_T}') then 'mean_sd'
    when regexp_full_match({c}, '{_I}') then 'n_only' else 'unknown' end"""
