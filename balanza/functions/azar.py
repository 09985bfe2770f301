"""Drawn numbers from whole-number arithmetic, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A prime below 2 ** 31, so that squares fit a long, and the factors of the mixing step.
PRIMO = 2_147_483_647
FACTOR, SUMANDO = 48_271, 11


def sorteo(semilla: int, *claves: Column) -> Column:
    """A number from 1 to PRIMO for each combination of whole-number keys; each key goes through two steps."""
    pasos = [p for c in claves for p in (F.pmod(c.cast("long"), F.lit(PRIMO)), F.lit(0).cast("long"))]

    def paso(a: Column, k: Column) -> Column:
        x = (a + k) % PRIMO
        return (x * (x + FACTOR) + SUMANDO) % PRIMO

    return F.aggregate(F.array(*pasos), F.lit(sorteo_de(semilla) - 1).cast("long"), paso) + 1


def sorteo_de(semilla: int, *claves: int) -> int:
    """The same number for plain integers."""

    def mezcla(x: int) -> int:
        return (x * (x + FACTOR) + SUMANDO) % PRIMO

    x = mezcla(mezcla(semilla))
    for c in claves:
        x = mezcla(mezcla((x + c % PRIMO) % PRIMO))
    return x + 1
