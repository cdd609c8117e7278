"""Text rules as Column functions: cleaning, label forms, header matching and visual labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that become a hyphen, and signs that become comparators.
DASHES = "‐‑‒–—―−"
COMPARATORS = {"≤": "<=", "≥": ">=", "≦": "<=", "≧": ">=", "＜": "<", "＞": ">"}
# Entities that become comparators.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&le;": "<=", "&ge;": ">="}
#: Every white space character, for engines whose \s is ASCII.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A lost sign before a digit, at the start or after a space, bracket, bar or comparator.
LOST_SIGN = r"(^|[\t\n\f\r (|>])�[\t\n\f\r ]*([0-9])"


def clean_text(text: Column) -> Column:
    """Signs repaired, entities and dashes made plain, white space collapsed. Null stays null."""
    out = F.regexp_replace(text, LOST_SIGN, "$1<=$2")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.translate(out, DASHES, "-" * len(DASHES))
    for sign, plain in COMPARATORS.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


def _without_entities(text: Column) -> Column:
    # cleaning only ever turns one character that is no letter or digit into others, but for entities
    for entity in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(" "))
    return text


def label_text(text: Column) -> Column:
    """Letters and digits of a label once cleaned, ASCII, single spaces."""
    return F.trim(F.regexp_replace(_without_entities(text), "[^A-Za-z0-9]+", " "))


def alpha_text(text: Column) -> Column:
    """Letters of a label once cleaned, ASCII, single spaces."""
    return F.trim(F.regexp_replace(_without_entities(text), "[^A-Za-z]+", " "))


def header_match_text(text: Column) -> Column:
    """A header in the form roles are matched on: no markup or hyphens, and no note mark on a p header."""
    out = F.regexp_replace(F.lower(clean_text(text)), "[_*`]+", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, " *- *", " "), " +", " "))
    out = F.regexp_replace(out, r"^(p(?: *value| +for +trend| *trend)) *(?:[0-9]+|[a-z]|[*†‡§¶#{}|]+)$", "$1")
    return F.regexp_replace(out, r"^(p) *(?:[0-9]+|[*†‡§¶#{}|]+)$", "$1")


def slug(text: Column) -> Column:
    """Lower case with one underscore for each run of other characters; ``row`` if nothing is left."""
    out = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "_")
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.when(out == "", "row").otherwise(out)


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}]", ""))


def value_like(c: Column) -> Column:
    """Whether a cleaned cell reads as a value: dashes, a number with a bracket, a span of years, or at least as many digits as letters."""
    plain = c.rlike("^-+$") | c.rlike(r"^[0-9]+(?:\.[0-9]+)?%? *\([^)]*[0-9][^)]*\)$") | c.rlike("^[0-9]{4} *(?:-|,) *[0-9]{4}$")
    marked = c.rlike("[%()<>±]")
    enough = F.when(marked, digits(c) >= F.greatest(F.lit(1), letters(c))).otherwise(digits(c) >= letters(c))
    return (c != "") & (plain | ((digits(c) > 0) & enough))


def visual_kind(label: Column) -> Column:
    word = F.lower(F.regexp_extract(clean_text(label), VISUAL_LABEL, 1))
    return F.when(word == "", None).when(word.startswith("table"), "table").otherwise("figure")


def visual_number(label: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(clean_text(label), VISUAL_LABEL, 2)), F.lit(""))


#: Kind and number of a table or figure label.
VISUAL_LABEL = r"(?i)\b(tables?|figures?|figs?\.?) *([sS]?[0-9]+[A-Za-z]?)\b"


# The same rules as SQL text, for checks on another engine.
def sql_clean(x: str) -> str:
    out = f"regexp_replace({x}, '{LOST_SIGN}', '\\1<=\\2', 'g')"
    for entity, sign in ENTITIES.items():
        out = f"replace({out}, '{entity}', '{sign}')"
    out = f"translate({out}, '{DASHES}', '{'-' * len(DASHES)}')"
    for sign, plain in COMPARATORS.items():
        out = f"replace({out}, '{sign}', '{plain}')"
    return f"trim(regexp_replace({out}, '{SPACE}+', ' ', 'g'))"


def sql_label(x: str) -> str:
    return f"trim(regexp_replace({sql_clean(x)}, '[^A-Za-z0-9]+', ' ', 'g'))"


def sql_alpha(x: str) -> str:
    return f"trim(regexp_replace({sql_clean(x)}, '[^A-Za-z]+', ' ', 'g'))"


def sql_header(x: str) -> str:
    out = f"regexp_replace(lower({sql_clean(x)}), '[_*`]+', '', 'g')"
    out = f"trim(regexp_replace(regexp_replace({out}, ' *- *', ' ', 'g'), ' +', ' ', 'g'))"
    out = f"regexp_replace({out}, '^(p(?: *value| +for +trend| *trend)) *(?:[0-9]+|[a-z]|[*†‡§¶#{{}}|]+)$', '\\1')"
    return f"regexp_replace({out}, '^(p) *(?:[0-9]+|[*†‡§¶#{{}}|]+)$', '\\1')"


def sql_value_like(c: str) -> str:
    """``c`` is a cleaned column."""
    d, a = f"length(regexp_replace({c}, '[^0-9]', '', 'g'))", f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"
    return (
        f"({c} <> '' and (regexp_full_match({c}, '-+') or regexp_full_match({c}, '[0-9]+(?:\\.[0-9]+)?%? *\\([^)]*[0-9][^)]*\\)')"
        f" or regexp_full_match({c}, '[0-9]{{4}} *(?:-|,) *[0-9]{{4}}') or ({d} > 0 and case when regexp_matches({c}, '[%()<>±]')"
        f" then {d} >= greatest(1, {a}) else {d} >= {a} end)))"
    )
