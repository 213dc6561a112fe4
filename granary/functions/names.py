"""Text: units, commodity names, identifiers."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commodity families, in the order in which a name is tried against them.
STAPLES = ("Maize", "Sorghum", "Wheat", "Rice", "Beans")
STAPLES_AND_TEFF = ("Maize", "Sorghum", "Wheat", "Rice", "Beans", "Teff")
NATIONAL_STAPLES = ("Maize", "Sorghum", "Wheat", "Teff", "Barley", "Beans")

# Patterns and labels.
FIRST_NUMBER = r"(\d+(\.\d+)?)"
FIRST_DIGITS = r"(\d+)"
NOT_NUMERIC = r"[^0-9.]"
SACK_UNIT, SACK_KG = "100 KG", 100.0
NOT_FOOD = "Milling cost"


def weight_first_number(unit: Column) -> Column:
    """First number in the unit text, 1 where there is none."""
    return F.coalesce(F.regexp_extract(unit, FIRST_NUMBER, 1).try_cast("double"), F.lit(1.0))


def weight_kg_or_litre(unit: Column) -> Column:
    """All digits and dots of a kg or litre unit joined; 1 without digits; NULL otherwise."""
    text = F.lower(unit)
    digits = F.regexp_replace(text, NOT_NUMERIC, "")
    known = F.contains(text, F.lit("kg")) | F.contains(text, F.lit("l"))
    return F.when(known & (digits == ""), F.lit(1.0)).when(known, digits.try_cast("double"))


def weight_first_digits(unit: Column) -> Column:
    """First run of digits as a whole number, 1 where there is none."""
    return F.coalesce(F.regexp_extract(unit, FIRST_DIGITS, 1).try_cast("int"), F.lit(1))


def weight_sack(unit: Column) -> Column:
    """100 for the 100 kg sack, 1 for every other unit."""
    return F.when(unit == SACK_UNIT, F.lit(SACK_KG)).otherwise(F.lit(1.0))


UNIT_WEIGHTS = {
    "first_number": weight_first_number,
    "kg_or_litre": weight_kg_or_litre,
    "first_digits": weight_first_digits,
    "sack": weight_sack,
}


def unit_weight(unit: Column, mode: str = "first_number") -> Column:
    return UNIT_WEIGHTS[mode](unit)


def names_any(name: Column, targets: Sequence[str]) -> Column:
    # One pattern: a name that is a long expression itself is computed once, not once per target.
    return name.rlike("|".join(re.escape(t) for t in targets))


def commodity_group(name: Column, targets: Sequence[str], ignore_case: bool = False) -> Column:
    """First target contained in the name, in list order; the name itself if none is."""

    text = F.lower(name) if ignore_case else name
    # Contained and absent are told apart in compiled code; a lambda over the name is interpreted row by row.
    out = name
    for t in reversed(targets):
        out = F.when(F.contains(text, F.lit(t.lower() if ignore_case else t)), F.lit(t)).otherwise(out)
    return out


def matches(name: Column, pattern: str) -> Column:
    """Case-insensitive search for a pattern."""
    return name.rlike("(?i)" + pattern)


def key_safe(name: Column, blank: str = "_") -> Column:
    """A name fit for use as a key: no slash, blanks replaced."""
    return F.replace(F.replace(name, F.lit("/"), F.lit("_")), F.lit(" "), F.lit(blank))


def relabel(c: Column, labels: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in labels.items()], c)
