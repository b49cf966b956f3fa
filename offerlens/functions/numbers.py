"""Numbers: amounts in text, rounding, clamps, completeness and the two ranking scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(c: Column, variant: str = "promotion") -> Column:
    """A price in text as double, or null. `promotion` and `page` strip what isn't a number and read 1.234,50 the German way;
    `official` gives 0 where nothing is left; `plain` only turns the comma and knows the $undefined mark."""
    if variant == "plain":
        return F.when(c == "$undefined", None).otherwise(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"))
    digits = F.regexp_replace(c, r"[^\d,.-]+", "")
    value = F.replace(F.regexp_replace(digits, r"\.(?=\d{3}(?:\D|$))", ""), F.lit(","), F.lit(".")).try_cast("double")
    if variant == "official":
        return F.when(c.isNull() | (c == ""), None).when(digits == "", F.lit(0.0)).otherwise(value)
    return F.when(c.isNull() | (digits == ""), None).otherwise(value)


def _units(x: Column, factor: int) -> Column:
    """The whole number next to the exact value of x * factor, the larger of two as near; x >= 0.

    The product is rounded, so one that seems to lie halfway may come from either side: its error term, exact by
    splitting x into halves of 26 bits, tells.
    """
    product, wide = x * factor, x * 134217729.0
    upper = wide - (wide - x)
    error = (upper * factor - product) + (x - upper) * factor
    down = F.floor(product)
    rest = product - down
    return down + F.when((rest > 0.5) | ((rest == 0.5) & (error >= 0)), 1).otherwise(0)


def fixed(c: Column, places: int) -> Column:
    """c with so many decimals, as its exact binary value rounds: 0.015 is 0.01. Halves go away from zero.

    The argument occurs several times in the result: where it is more than a few columns, use once(c, money).
    """
    x = c.cast("double")
    return F.signum(x) * _units(F.abs(x), 10**places) / 10**places


def once(c: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    """f of c with c behind a lambda: f's many references to it don't copy the expression into the plan."""
    return F.transform(F.array(c), f)[0]


def money(c: Column) -> Column:
    return fixed(c, 2)


def cents(c: Column) -> Column:
    x = c.cast("double")
    return (F.signum(x) * _units(F.abs(x), 100)).cast("long")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamped(c: Column, low: float, high: float) -> Column:
    """Null stays null, unlike under greatest and least alone."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def truthy(c: Column, kind: str) -> Column:
    """Given, and not empty, zero, NaN or false."""
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))


def share_of(*conditions: Column) -> Column:
    """Share of the conditions that hold."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    return total / F.lit(float(len(conditions)))


def count_of(*conditions: Column) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    return total


def _points(condition: Column, n: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)


def sort_score(active: Column, safe: Column, program: Column, conditions: Column, quantity: Column, confidence: Column, unit_price: Column) -> Column:
    base = _points(active, 100) + _points(safe, 50) + _points(~program, 20) + _points(conditions == "", 10) + _points(quantity <= 1, 10)
    return base + half_up(F.coalesce(confidence, F.lit(0.0)) * 10) + F.coalesce(F.greatest(F.lit(0), 20 - F.least(F.lit(20), half_up(unit_price))), F.lit(0))


def consumer_score(base: Column, active: Column, comparable: Column, unit_price: Column, single: Column, program: Column, conditions: Column) -> Column:
    cheap = F.coalesce(F.greatest(F.lit(0), 200 - F.least(F.lit(200), half_up(unit_price * 10))), F.lit(0))
    return base + _points(active, 1000) + _points(comparable, 500) + cheap + _points(single, 100) + _points(~program, 80) + _points(conditions == "", 60)


def amount_or_zero(c: Column) -> Column:
    """c as double, 0 where it is none."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
