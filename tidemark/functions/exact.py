"""Exact numbers as strings: decimals that terminate, rationals, and admission of 96-bit decimals."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal
from fractions import Fraction

CONTEXT = Context(prec=50, rounding=ROUND_HALF_EVEN)


def terminating(value: Fraction, most_scale: int = 18, most_digits: int = 43) -> str | None:
    """The decimal of a rational whose denominator holds only twos and fives and that fits; else None."""
    den, twos, fives = value.denominator, 0, 0
    while den % 2 == 0:
        den, twos = den // 2, twos + 1
    while den % 5 == 0:
        den, fives = den // 5, fives + 1
    scale = max(twos, fives)
    if den != 1 or scale > most_scale:
        return None
    units = value.numerator * 10**scale // value.denominator
    if len(str(abs(units))) > most_digits:
        return None
    sign, digits = "-" * (units < 0), str(abs(units)).rjust(scale + 1, "0")
    return sign + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)


def fifty_digits(value: Fraction) -> Decimal:
    return CONTEXT.divide(Decimal(value.numerator), Decimal(value.denominator))


def fits_96_bits(text: str) -> bool:
    """Whether a decimal has a coefficient under 2^96 and a scale of 0 to 28."""
    _, digits, exponent = Decimal(text).as_tuple()
    coefficient = int("".join(map(str, digits))) * 10 ** max(0, exponent)
    return coefficient < 1 << 96 and 0 <= max(0, -exponent) <= 28


def single_entry_nav(cash: Fraction, rate: Fraction) -> Fraction:
    """Value after fees of a new book with one sleeve of either sign."""
    return cash / (1 + 2 * rate)
