"""How amounts are shown: yen in tiers of 兆, 億 and 万. One rule, several ways to round; halves go up, in absolute value."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ((10**12, "兆円"), (10**8, "億円"), (10**4, "万円"))


def fixed(x: Column, places: int, grouped: bool = False) -> Column:
    """x with so many places; grouped: with thousands separators."""
    text = F.format_number(F.round(x.cast("decimal(38,12)"), places), places)
    return text if grouped else F.replace(text, F.lit(","), F.lit(""))


def by_digits(v: Column) -> Column:
    """Two places up to 99, one up to 999, none and separators beyond."""
    return F.when(v >= 1000, fixed(v, 0, True)).when(v >= 100, fixed(v, 1)).otherwise(fixed(v, 2))


def tiered(yen: Column, forms: tuple, one=lambda v: fixed(v, 0, True)) -> Column:
    """The largest tier that an amount reaches, each with its form."""
    size, exact = F.abs(yen), yen.cast("decimal(38,12)")
    out = None
    for (unit, name), form in zip(TIERS, forms, strict=True):
        if form:
            text = F.concat(form(exact / F.lit(unit)), F.lit(name))
            out = F.when(size >= unit, text) if out is None else out.when(size >= unit, text)
    last = F.concat(one(exact), F.lit("円"))
    return F.when(yen.isNotNull(), out.otherwise(last))


def yen_short(yen: Column) -> Column:
    """Two places of 兆, one of 億, whole 万 and yen."""
    return tiered(yen, (lambda v: fixed(v, 2), lambda v: fixed(v, 1), lambda v: fixed(v, 0, True)))


def yen_or_dash(yen: Column) -> Column:
    """As yen_short, a dash for null."""
    return F.coalesce(yen_short(yen), F.lit("—"))


def oku(yen: Column) -> Column:
    """One place of 兆, else whole 億."""
    exact = yen.cast("decimal(38,12)")
    return F.when(yen >= 10**12, F.concat(fixed(exact / F.lit(10**12), 1), F.lit("兆円"))).otherwise(F.concat(fixed(exact / F.lit(10**8), 0), F.lit("億円")))


def budget(thousands: Column, about: bool = True) -> Column:
    """Thousands of yen, with places by how many digits there are; about: marked as rounded. Tiers begin at amounts above zero."""
    text = tiered(thousands * 1000, (by_digits, by_digits, by_digits))
    return F.concat(F.lit("約"), text) if about else text


def budget_from_yen(yen: Column) -> Column:
    """Two places of every tier, whole yen below."""
    two = lambda v: fixed(v, 2)
    return tiered(yen, (two, two, two))


def rate(x: Column) -> Column:
    """A share in percent with one place, a dash for null."""
    return F.coalesce(F.concat(fixed(x.cast("decimal(38,12)") * 100, 1), F.lit("%")), F.lit("—"))


def yen(value: float) -> str:
    """A single amount, for labels: two places of 兆, whole 億 from 100 on and two places below, whole 万 and yen."""
    size = abs(Decimal(str(value)))
    text = lambda unit, places: f"{(size / unit).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):{',' if not places else ''}}"
    body = (text(10**12, 2) + "兆円" if size >= 10**12 else text(10**8, 0) + "億円" if size >= 10**10 else text(10**8, 2) + "億円" if size >= 10**8
            else text(10**4, 0) + "万円" if size >= 10**4 else text(1, 0) + "円")
    return ("-" if value < 0 else "") + body
