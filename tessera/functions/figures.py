"""Numbers in messages, as C and Python print them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on a double has no more digits than print anyway.
_LARGE = 1e11


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _scaled(size: Column, unit: float) -> Column:
    """A struct of size * unit as a rounded double (p) and what the rounding lost, exactly, by halves of 26 bits (lost)."""
    split = float((1 << 27) + 1)
    unit_high = unit * split - (unit * split - unit)
    unit_low = unit - unit_high
    lost = lambda high, low, p: (high * unit_high - p) + high * unit_low + low * unit_high + low * unit_low
    return _let(size * split - (size * split - size), lambda high: _let(size * unit, lambda p: F.struct(p.alias("p"), lost(high, size - high, p).alias("lost"))))


def figure(x: Column, places: int) -> Column:
    """``x`` with so many decimal places, rounded by its exact binary value, and to even where that is a tie.

    Null stays null; nan and infinities are ``nan``, ``inf`` and ``-inf``; a negative number keeps its sign when it rounds to zero.
    """

    def digits(z: Column) -> Column:
        whole = F.floor(z["p"])
        over = z["p"] - whole
        # only where the rounded product is a tie can its loss decide
        up = (over > 0.5) | ((over == 0.5) & ((z["lost"] > 0) | ((z["lost"] == 0) & (whole % 2 == 1))))
        return (whole + up.cast("long")).cast("string")

    def pointed(d: Column) -> Column:
        if not places:
            return d
        padded = F.lpad(d, F.greatest(F.length(d), F.lit(places + 1)), F.lit("0"))
        return F.regexp_replace(padded, f"(.{{{places}}})$", ".$1")

    def whole(v: Column) -> Column:
        text = _let(_let(_scaled(F.abs(v), float(10**places)), digits), pointed)
        finite = F.when(F.abs(v) < _LARGE, text).otherwise(F.format_string(f"%.{places}f", F.abs(v)))
        sign = F.when(v < 0, "-").otherwise("")
        return F.when(F.isnan(v), "nan").otherwise(F.concat(sign, F.when(F.abs(v) == float("inf"), "inf").otherwise(finite)))

    return F.when(x.isNotNull(), _let(x.cast("double"), whole))


def told(template: str, *values: Column) -> Column:
    """``template`` with a ``%s`` for each value; null where any value is null."""
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    return F.when(known, F.format_string(template, *[v.cast("string") for v in values]))
