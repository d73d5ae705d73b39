"""Decimal rounding of doubles from their exact binary value, ties to even.

``round`` and ``format_string`` round the shortest decimal text of a double, so a few percent of all
hybrid scores would come out one unit off. Here a value is compared with the double next to the
midpoint; only if they are equal, the side of the true midpoint decides. Scaling by a power of two is
exact, so DECIMAL arithmetic can tell it; for the few midpoints too small for that it is listed.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from serupa.functions.binding import bind


def _exact_units(value: Column, units: int, power: int) -> Column:
    """``value * units`` rounded to a whole number (value >= 0 and value * 2**power < 2**63)."""
    scale, small = 2**power, 2.0 ** (53 - power)
    low = F.floor(value * float(units)).cast("bigint")
    middle = (low * 2 + 1) / F.lit(2.0 * units)
    exact = (value * float(scale)).cast("bigint").cast("decimal(20,0)") * F.lit(2 * units)
    true_middle = (low.cast("decimal(12,0)") * 2 + 1) * F.lit(scale).cast("decimal(19,0)")
    above = [
        n for n in range(int(units * small) + 1) if Fraction((2 * n + 1) / (2 * units)) > Fraction(2 * n + 1, 2 * units)
    ]
    up_at_middle = F.when(value < small, low.isin(above)).otherwise(
        (exact > true_middle) | ((exact == true_middle) & (low % 2 == 1))
    )
    up = (value > middle) | ((value == middle) & up_at_middle)
    return low + up.cast("bigint")


def round4(value: Column) -> Column:
    """Four decimals, for values in (-2, 2)."""
    return bind(value, lambda v: F.signum(v) * (_exact_units(F.abs(v), 10_000, 62) / F.lit(10_000.0)))


def percent_text(score: Column) -> Column:
    """``87.3%`` for a score between -1 and 1."""

    def text(v: Column) -> Column:
        sign = F.when(F.signum(v).cast("string").startswith("-"), "-").otherwise("")  # also for -0.0
        tenths = _exact_units(F.abs(v) * 100.0, 10, 56)
        body = bind(tenths, lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))
        return F.concat(sign, body, F.lit("%"))

    return bind(score, text)


def snap(value: Column, digits: int = 10) -> Column:
    """Nearest multiple of 10**-digits: removes summation-order noise before ranking."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)
