"""Units of measure: names as plain words, from which the patterns and look-ups are built, and conversions from physical constants."""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

from pyspark.sql import Column, functions as F

#: Dimension types, as the sheets list them.
TYPES = ("length", "area", "angle", "weight", "force", "torque", "pressure", "capacity", "electrical", "temperature", "flow", "speed", "rotation")


class Unit(NamedTuple):
    name: str
    kind: str
    names: tuple[str, ...]
    size: float | None = None  # in the base unit of its kind
    partner: str = ""  # the unit of the other system that it is shown in


# Physical constants: an inch, a pound and standard gravity; an inch of mercury; a gallon.
INCH, POUND, GRAVITY = 0.0254, 0.45359237, 9.80665
LBF, MERCURY, GALLON = POUND * GRAVITY, 3386.389, 231 * INCH**3

#: Names in lower case. A blank stands for a blank, hyphen, dot or nothing, `per` for a slash too, 2 for a square with or without ^.
#: Words of two letters and more may have a plural s.
UNITS = (
    Unit("in", "length", ("in", "inch", "inches", '"'), INCH, "mm"),
    Unit("ft", "length", ("ft", "foot", "feet", "'"), 12 * INCH, "m"),
    Unit("yd", "length", ("yd", "yard"), 36 * INCH, "m"),
    Unit("mil", "length", ("mil", "thou", "thousandth"), INCH / 1000, "mm"),
    Unit("mm", "length", ("mm", "millimeter", "millimetre"), 0.001, "in"),
    Unit("cm", "length", ("cm", "centimeter", "centimetre"), 0.01, "in"),
    Unit("m", "length", ("m", "meter", "metre"), 1.0, "ft"),
    Unit("sq-in", "area", ("in2", "sq in", "square inch", "square inches"), INCH**2, "sq-cm"),
    Unit("sq-ft", "area", ("ft2", "sq ft", "square foot", "square feet"), (12 * INCH) ** 2, "sq-cm"),
    Unit("sq-cm", "area", (), 0.0001, "sq-in"),
    Unit("deg", "angle", ("°", "deg", "degree")),
    Unit("lb", "weight", ("lb", "pound"), POUND, "kg"),
    Unit("oz", "weight", ("oz", "ounce"), POUND / 16, "g"),
    Unit("ton", "weight", ("ton",), 2000 * POUND, "kg"),
    Unit("kg", "weight", ("kg", "kilogram"), 1.0, "lb"),
    Unit("g", "weight", ("g", "gram"), 0.001, "oz"),
    Unit("lbf", "force", ("lbf",), LBF, "N"),
    Unit("N", "force", ("n",), 1.0, "lbf"),
    Unit("kN", "force", ("kn", "kilonewton"), 1000.0, "lbf"),
    Unit("ft-lb", "torque", ("ft lb", "lb ft", "foot pound"), 12 * INCH * LBF, "N-m"),
    Unit("in-lb", "torque", ("in lb", "inch pound"), INCH * LBF, "N-m"),
    Unit("N-m", "torque", ("n m", "newton meter", "newton metre"), 1.0, "ft-lb"),
    Unit("psi", "pressure", ("psi", "psia", "psig", "lb per in2", "lb per square inch"), LBF / INCH**2, "kPa"),
    Unit("kPa", "pressure", ("kpa", "kilopascal"), 1e3, "psi"),
    Unit("MPa", "pressure", ("mpa", "megapascal"), 1e6, "psi"),
    Unit("bar", "pressure", ("bar",), 1e5, "psi"),
    Unit("inHg", "pressure", ("in hg", "inch of mercury", "inches of mercury"), MERCURY, "kPa"),
    Unit("gal", "capacity", ("gal", "gallon"), GALLON, "L"),
    Unit("qt", "capacity", ("qt", "quart"), GALLON / 4, "L"),
    Unit("pt", "capacity", ("pt", "pint"), GALLON / 8, "L"),
    Unit("fl-oz", "capacity", ("fl oz", "fluid ounce"), GALLON / 128, "mL"),
    Unit("L", "capacity", ("l", "liter", "litre"), 1e-3, "gal"),
    Unit("mL", "capacity", ("ml", "milliliter", "millilitre", "cc", "cubic cent", "cubic centimeter"), 1e-6, "fl-oz"),
    Unit("V", "electrical", ("v", "volt", "vdc", "vac")),
    Unit("A", "electrical", ("a", "amp", "ampere")),
    Unit("mA", "electrical", ("ma", "milliamp")),
    Unit("ohm", "electrical", ("ohm", "Ω")),
    Unit("W", "electrical", ("w", "watt")),
    Unit("Hz", "electrical", ("hz", "hertz")),
    Unit("degF", "temperature", ("f", "° f", "deg f", "degree f", "deg fahrenheit", "degree fahrenheit")),
    Unit("degC", "temperature", ("c", "° c", "deg c", "degree c", "deg celsius", "degree celsius", "deg centigrade", "degree centigrade")),
    Unit("gpm", "flow", ("gpm", "gal per min", "gallon per min"), GALLON / 60, "L/min"),
    Unit("cfm", "flow", ("cfm", "cu ft per min"), (12 * INCH) ** 3 / 60, "L/min"),
    Unit("L/min", "flow", (), 1e-3 / 60, "gpm"),
    Unit("mph", "speed", ("mph", "mile per hr", "mile per hour"), 63360 * INCH / 3600, "km/h"),
    Unit("km/h", "speed", ("kph", "kmh", "km per h", "kilometer per hr", "kilometre per hr", "kilometer per hour", "kilometre per hour"), 1 / 3.6, "mph"),
    Unit("rpm", "rotation", ("rpm", "rev per min", "revolution per min")),
)
BY_NAME = {u.name: u for u in UNITS}
IMPERIAL = ("in", "ft", "yd", "mil", "ft-lb", "in-lb", "psi", "inHg", "gal", "qt", "pt", "fl-oz", "lb", "oz", "ton", "lbf", "mph", "gpm", "cfm", "sq-in", "sq-ft", "degF")
METRIC = ("mm", "cm", "m", "N-m", "kPa", "MPa", "bar", "L", "mL", "kg", "g", "N", "kN", "km/h", "L/min", "sq-cm", "degC")
#: Units with a name of one letter, which a number of the line before must not be joined to.
BARE = tuple(u.name for u in UNITS if any(len(n) == 1 and n.isalpha() and n.isascii() for n in u.names))

_JOIN, _PER, _DOTS = r"[\s\-.·•∙]{0,2}", r"(?:\s*/\s*|[\s\-]+per[\s\-]+|\s)", r"[\s\-.·•∙^]"


def _plurals(word: str) -> tuple[str, ...]:
    return (word, f"{word}s") if len(word) > 1 and word.isalpha() and not word.endswith("s") else (word,)


def _pattern(name: str) -> str:
    def of(word: str) -> str:
        bare = re.escape(word).replace("2", r"\^?2")
        return f"{bare}s?" if len(_plurals(word)) > 1 else bare

    parts = [_JOIN.join(map(of, half.split(" "))) for half in name.split(" per ")]
    # no letter, digit or hyphen goes on after a unit; after one letter no slash either
    guard = r"(?![\w/\-])" if len(name) == 1 and name.isalnum() else r"(?![\w\-])"
    return _PER.join(parts) + guard


def _keys(name: str) -> set[str]:
    """What is left of a name, or of its plurals, without blanks, dots and hyphens."""
    halves = [["".join(x) for x in itertools.product(*map(_plurals, half.split(" ")))] for half in name.split(" per ")]
    return {sep.join(x) for x in itertools.product(*halves) for sep in ("/", "")}


def _choices(names: list[str]) -> str:
    """One of the names, in their order. Names that begin alike stand together, so that a letter that none begins with is compared with each beginning only."""
    groups = {}
    for n in names:
        groups.setdefault(n[0], []).append(_pattern(n))
    first = lambda c: len(re.escape(c))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(x[first(c):] for x in same)})" for c, same in groups.items())


#: Longer names first, so that a name is never taken for the beginning of another; names that begin differently never match at one place.
PATTERN = _choices(sorted({n for u in UNITS for n in u.names}, key=lambda n: (-len(n), n)))
NUMBER = r"[+\-]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)"
AMOUNT = rf"({NUMBER})\s*(?:(?:-|–|to|through)\s*({NUMBER})\s*)?(?:(?:±|\+/-|plus or minus)\s*({NUMBER})\s*)?"
#: What a number begins with is looked for before anything else.
MEASURE = rf"(?i)(?=[+\-.\d])(?<![\w.]){AMOUNT}({PATTERN})"
KEYS = {k: u for u in UNITS for n in u.names for k in _keys(n)}


def resolve(spelling: Column) -> Column:
    """unit and type of a spelling that PATTERN has found."""
    key = F.regexp_replace(F.regexp_replace(F.lower(spelling), _PER.replace(r"|\s)", ")"), "/"), _DOTS, "")
    known = F.create_map(*[x for k, u in KEYS.items() for x in (F.lit(k), F.struct(F.lit(u.name).alias("unit"), F.lit(u.kind).alias("type")))])
    return F.try_element_at(known, key)


def _of(unit: Column, what: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in what.items() for x in pair]), unit)


def convert(value: Column, unit: Column, to: Column | str) -> Column:
    """A value in another unit of its kind; null for units of another kind and for those without a size. Temperatures by their formulae."""
    to = F.lit(to) if isinstance(to, str) else to
    size, kind = {u.name: u.size for u in UNITS if u.size}, {u.name: u.kind for u in UNITS}
    scaled = F.when(_of(unit, kind) == _of(to, kind), value * _of(unit, size) / _of(to, size))
    warm = F.when((unit == "degF") & (to == "degC"), (value - 32) * 5 / 9).when((unit == "degC") & (to == "degF"), value * 9 / 5 + 32)
    return F.coalesce(warm, scaled)


def partner(unit: Column) -> Column:
    """The unit of the other system that a unit is shown in."""
    return _of(unit, {u.name: u.partner for u in UNITS if u.partner} | {"degF": "degC", "degC": "degF"})


def system(unit: Column) -> Column:
    return F.when(unit.isin(*IMPERIAL), "imperial").when(unit.isin(*METRIC), "metric").otherwise("")


def dual(value: Column, unit: Column) -> Column:
    """The value in its partner unit as text, to two decimals (one for temperatures) and six digits in all; empty where there is none."""
    other = convert(value, unit, partner(unit))
    other = F.when(unit.isin("degF", "degC"), F.round(other, 1)).otherwise(F.round(other, 2))
    whole = F.length(F.regexp_replace(F.format_string("%.0f", F.floor(F.abs(other)).cast("double")), "-", ""))
    cut = F.when(whole >= 6, F.format_string("%.0f", other)).when(whole == 5, F.format_string("%.1f", other)).otherwise(F.format_string("%.2f", other))
    plain = F.when(cut.contains("."), F.regexp_replace(F.regexp_replace(cut, "0+$", ""), r"\.$", "")).otherwise(cut)
    return F.coalesce(F.when(other.isNotNull(), F.concat_ws(" ", plain, partner(unit))), F.lit(""))
