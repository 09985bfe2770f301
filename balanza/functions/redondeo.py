"""Exact rounding of ratios of integers.

``ROUND(a / b, k)`` on numerics is half away from zero.  Doing it with integers
gives the same digits on every engine and never overflows: the arithmetic runs on
``decimal(38, 0)``, and only on rows that are already aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTERO = "decimal(38,0)"


def cociente(num: Column, den: Column, escala: int) -> Column:
    """``escala * num / den`` rounded half up to a long; null when ``den`` is not positive."""
    d = F.when(den > 0, den).cast(_ENTERO)
    n = num.cast(_ENTERO)
    return F.call_function("div", n * F.lit(2 * escala) + d, d * F.lit(2))


def razon(num: Column, den: Column, decimales: int = 4) -> Column:
    """Ratio of sums with ``decimales`` digits; 0 when nothing was filed."""
    escala = 10**decimales
    return F.coalesce(cociente(num, den, escala), F.lit(0)) / F.lit(float(escala))


def promedio(suma: Column, n: Column, decimales: int) -> Column:
    """Mean from an integer sum and a count, null on an empty group."""
    escala = 10**decimales
    return cociente(suma, n, escala) / F.lit(float(escala))


def porcentaje(parte: Column, total: Column) -> Column:
    """``100 * parte / total`` with two digits; null for an empty total."""
    return cociente(parte, total, 10_000) / F.lit(100.0)


def variacion(actual: Column, previo: Column) -> Column:
    """Percent change with two digits, half away from zero; null without a base."""
    dif = actual - previo
    return F.signum(dif) * cociente(F.abs(dif), previo, 10_000) / F.lit(100.0)


def tres_decimales(c: Column) -> Column:
    """Three digits, half to even on the scaled double."""
    return F.rint(c * F.lit(1000.0)) / F.lit(1000.0)
