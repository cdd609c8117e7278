"""Units as they are written, read as one of a quantity's units."""

from __future__ import annotations

import re
from functools import lru_cache

from tabloom.functions.fold import fold

# Ways to write a unit, under the symbol it stands for; lower case, "per" as a slash.
SPELLINGS: dict[str, str] = {
    "years": "y yr yrs year years person-years a",
    "months": "mo mos mth mths month months",
    "weeks": "w wk wks week weeks",
    "days": "d day days",
    "hours": "h hr hrs hour hours",
    "decades": "decade decades 10years 10yr 10y 10-yunits 10-yearunits 10yunits",
    "cm": "cm cms centimetre centimetres centimeter centimeters",
    "m": "m metre metres meter meters",
    "mm": "mm mms millimetre millimetres millimeter millimeters",
    "in": "in inch inches",
    "kg": "kg kgs kilo kilos kilogram kilograms",
    "lb": "lb lbs pound pounds",
    "g": "g gm gms gr gram grams",
    "st": "st stone stones",
    "oz": "oz ozs ounce ounces",
    "mmol/L": "mmol/l mm millimol/l millimole/l millimoles/l",
    "umol/L": "umol/l um micromol/l micromole/l micromoles/l",
    "nmol/L": "nmol/l nm nanomol/l nanomole/l nanomoles/l",
    "mg/dL": "mg/dl mg% milligram/dl milligrams/dl mg/100ml",
    "g/dL": "g/dl gm/dl g% gram/dl grams/dl g/100ml",
    "g/L": "g/l gm/l gram/l grams/l",
    "mg/L": "mg/l milligram/l milligrams/l",
    "ng/mL": "ng/ml nanogram/ml nanograms/ml",
    "mmol/mol": "mmol/mol ifccmmol/mol ifcc",
    "%": "% percent pct ngsp% ngsp",
    "C": "c celsius degc degreec degreesc degcelsius degreescelsius centigrade",
    "F": "f fahrenheit degf degreesf degfahrenheit degreesfahrenheit",
    "K": "k kelvin kelvins",
    "mmHg": "mmhg mm/hg millimetresofmercury millimetersofmercury torr",
    "kPa": "kpa kilopascal kilopascals",
    "cmH2O": "cmh2o cmofwater centimetresofwater cmwater",
    "kJ": "kj kilojoule kilojoules kj/d kj/day",
    "kcal": "kcal kcals cal cals kilocalorie kilocalories kcal/d kcal/day cal/d cal/day",
    "MJ": "mj megajoule megajoules mj/d mj/day",
}
_BY_SPELLING: dict[str, tuple[str, ...]] = {}
for _symbol, _names in SPELLINGS.items():
    for _name in _names.split():
        _BY_SPELLING[_name] = (*_BY_SPELLING.get(_name, ()), _symbol)


@lru_cache(maxsize=100_000)
def readings(text: str) -> tuple[str, ...]:
    """Symbols that a unit's text may stand for."""
    t = fold(text).strip().lower().replace("µ", "u").replace("μ", "u").replace("°", "deg").replace("²", "2")
    t = re.sub(r"[()\[\]]", " ", t).strip()
    t = re.sub(r"^in\s+(?=\S)", "", t).strip()
    t = re.sub(r"\bper cent\b", "percent", t)
    t = re.sub(r"\bdecilit(?:re|er)s?\b", "dl", t)
    t = re.sub(r"\bmillilit(?:re|er)s?\b", "ml", t)
    t = re.sub(r"\blit(?:re|er)s?\b", "l", t)
    t = re.sub(r"\s*(?:\bper\b|/)\s*", "/", t)
    t = re.sub(r"\s+(mol|dl|ml|l)-1\b", r"/\1", t)
    t = re.sub(r"\s+", "", t.strip(" .,:;")).lstrip("/")
    return _BY_SPELLING.get(t) or _BY_SPELLING.get(t.rstrip("."), ())


def is_unit(text: str) -> bool:
    return bool(readings(text)) or bool(re.fullmatch(r"(?i)\s*kg/m[2²]\s*", text))


_CELL = re.compile(r"\d\s*(?P<unit>[^\W\d_%°][^()\[\]±]*?|%|°\s*[A-Za-z])\s*(?:\(|\[|±|\+/-|\s-\s|\s6\s|;|\||$)")


def cell_unit(text: str) -> str | None:
    """The text between a printed value and its companion, if it reads as a unit."""
    match = _CELL.search(fold(text))
    return match.group("unit") if match and readings(match.group("unit")) else None
