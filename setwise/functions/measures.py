"""Numeric, label and bitmask expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from setwise.functions.times import col

MONEY = "decimal(18,2)"


def money(x: Column | str) -> Column:
    """Exact two-decimal value: sums of it do not depend on row order."""
    return col(x).cast(MONEY)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``, NULL where ``b`` is zero."""
    return col(a) / F.nullif(col(b), F.lit(0))


def smoothed_ratio(a: Column | str, n: Column | str) -> Column:
    """``a / (1 + n)``: defined for every count including zero."""
    return col(a) / (F.lit(1).cast("decimal(12,0)") + col(n))


def floor_zero(x: Column | str, floor: str = "0.001") -> Column:
    """Zero becomes a small positive number so that it can be divided by."""
    v = col(x)
    return F.when(v == 0, F.lit(floor).cast("decimal(18,3)")).otherwise(v)


def code_label(x: Column | str, labels: Mapping, otherwise: Column | str | None = None) -> Column:
    """Map codes to labels; unmatched codes give ``otherwise``."""
    code, out = col(x), None
    for value, label in labels.items():
        out = (F.when if out is None else out.when)(code == F.lit(value), F.lit(label))
    return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def has_flag(mask: Column | str, bit: int) -> Column:
    return col(mask).bitwiseAND(F.lit(bit)) != 0


def flag_mark(mask: Column | str, bit: int, mark: str = "X") -> Column:
    return F.when(has_flag(mask, bit), F.lit(mark)).otherwise(F.lit(""))


def flag_names(mask: Column | str, names: Sequence[str], separator: str = ", ") -> Column:
    """Names of the set bits, lowest bit first."""
    return F.concat_ws(separator, *[F.when(has_flag(mask, 1 << i), F.lit(n)) for i, n in enumerate(names)])
