"""Coercion of raw text: missing tokens, numbers, dates, normalised names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from balanza.esquema import SENTINELA

# Text that a yearly file uses for a missing cell.
FALTANTES = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Upper-cased text that means "no speciality".
SIN_ESPECIALIDAD = ("NAN", "NONE", "NULL", "", "NA", ",,")

# Every character counted as white space at the ends of a name.
ESPACIOS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

FORMATOS_FECHA = ("dd/MM/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd")

_NUMERO = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def faltante_a_nulo(c: Column, faltantes: Sequence[str] = FALTANTES) -> Column:
    return F.when(~c.isin(*faltantes), c)


def limpiar_texto(c: Column) -> Column:
    """Upper case without leading and trailing white space of any kind."""
    return F.upper(F.trim(c, F.lit(ESPACIOS)))


def a_numero(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(c.rlike(_NUMERO), c.try_cast("double"))


def a_entero(c: Column) -> Column:
    """Number to int, truncating; what does not fit becomes 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def a_fecha(c: Column, formatos: Sequence[str] = FORMATOS_FECHA) -> Column:
    """First format that parses wins; otherwise null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formatos])


def normalizar_especializada(c: Column) -> Column:
    """Clean name of a specialised office, or the sentinel when there is none."""
    t = limpiar_texto(c)
    vacio = t.isNull() | t.isin(*SIN_ESPECIALIDAD) | t.rlike(r"^,+$")
    return F.when(vacio, F.lit(SENTINELA)).otherwise(t)
