"""Classes, bands, labels and name-to-class rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  Cuts, labels and word lists that results must agree with.
# ---------------------------------------------------------------------------
SIN_ESPECIALIZACION = "Sin Especialización"

CORTES_EFICIENCIA = ((0.95, "Excelente"), (0.85, "Bueno"), (0.70, "Regular"))
RESTO_EFICIENCIA = "Deficiente"

CORTES_VOLUMEN = ((10000, "Muy Alto"), (5000, "Alto"), (1000, "Medio"))
RESTO_VOLUMEN = "Bajo"
SUFIJO_VOLUMEN = " Volumen"

TRAMOS_VOLUMEN = (
    (10, "Muy Bajo"),
    (50, "Bajo"),
    (200, "Medio"),
    (1000, "Alto"),
    (None, "Muy Alto"),
)
TRAMOS_EFICIENCIA = (
    (0.5, "Muy Baja (<0.5)"),
    (0.8, "Baja (0.5-0.8)"),
    (1.0, "Buena (0.8-1.0)"),
    (1.2, "Excelente (1.0-1.2)"),
    (None, "Excepcional (>1.2)"),
)

FUERZA_CORRELACION = (
    (0.9, "Muy fuerte"),
    (0.7, "Fuerte"),
    (0.5, "Moderada"),
    (0.3, "Débil"),
)
RESTO_FUERZA = "Muy débil"

CONCENTRACION = (
    (80, "Muy alta concentración - dominada por pocas categorías"),
    (60, "Alta concentración - algunas categorías dominantes"),
    (40, "Concentración moderada - distribución desbalanceada"),
)
RESTO_CONCENTRACION = "Baja concentración - distribución relativamente balanceada"

# Each rule: (class, alternatives); an alternative is a tuple of words that must all appear.
CATEGORIAS_CASO = (
    ("INGRESO", (("DENUNCIA",),)),
    ("RECURSO", (("APELACION",), ("QUEJA",))),
    ("PROCESO_FORMAL", (("PROCESO",),)),
)
RESTO_CATEGORIA = "PROCESO_GENERAL"

AREAS = (
    ("Anticorrupción", (("CORRUPCION",),)),
    ("Medio Ambiente", (("AMBIENTAL",), ("AMBIENTE",))),
    ("Crimen Organizado", (("CRIMINALIDAD",),)),
    ("Trafico ilicito de drogas", (("DROGAS",), ("TRAFICO",))),
    ("Violencia de Género", (("VIOLENCIA", "MUJER"),)),
    ("Lavado de Activos", (("LAVADO", "ACTIVOS"),)),
    ("Propiedad Intelectual", (("ADUANEROS",), ("PROPIEDAD INTELECTUAL",))),
    ("Trata de Personas", (("TRATA", "PERSONAS"),)),
    ("Tránsito y Seguridad Vial", (("TRANSITO",), ("VIAL",))),
    ("Tributario", (("TRIBUTARIOS",),)),
    ("Turismo", (("TURISMO",),)),
)
RESTO_AREA = "General"

REGIONES = (
    ("NORTE", ("TUMBES", "PIURA", "LAMBAYEQUE", "LA LIBERTAD", "CAJAMARCA", "AMAZONAS")),
    ("CENTRO", ("ANCASH", "LIMA", "CALLAO", "ICA", "HUANCAVELICA", "JUNIN", "PASCO")),
    ("SUR", ("AREQUIPA", "MOQUEGUA", "TACNA", "CUSCO", "APURIMAC", "AYACUCHO", "PUNO")),
    ("SELVA", ("LORETO", "UCAYALI", "MADRE DE DIOS", "SAN MARTIN", "HUANUCO")),
)
RESTO_REGION = "REGION_NO_CLASIFICADA"

NIVELES = (("SUPREMA", 1), ("SUPERIOR", 2), ("PROVINCIAL", 3))
RESTO_NIVEL = 4

# Outlier labels on the flagged percentage.
ATIPICOS_IQR = ((10, "alta"), (5, "moderada"))
RESTO_ATIPICOS_IQR = "baja"
ATIPICOS_Z = ((15, "muchos"), (5, "algunos"))
RESTO_ATIPICOS_Z = "pocos"
# ---------------------------------------------------------------------------


def _desde(c: Column, cortes: Sequence[tuple], resto, estricto: bool = False) -> Column:
    """Class of the first cut (from the top) that ``c`` reaches."""
    ramas = [(c > corte if estricto else c >= corte, F.lit(v)) for corte, v in cortes]
    primera, *otras = ramas
    cadena = reduce(lambda w, r: w.when(*r), otras, F.when(*primera))
    return cadena.otherwise(F.lit(resto))


def _tramo_derecho(c: Column, tramos: Sequence[tuple]) -> Column:
    """Right-closed bins starting at 0; values at or below 0 belong to no bin."""
    w = F.when(c.isNull() | (c <= 0), F.lit(None).cast("string"))
    for tope, nombre in tramos:
        if tope is None:
            return w.otherwise(F.lit(nombre))
        w = w.when(c <= tope, F.lit(nombre))
    return w


def clase_eficiencia(tasa: Column) -> Column:
    return _desde(tasa, CORTES_EFICIENCIA, RESTO_EFICIENCIA)


def clase_volumen(casos: Column) -> Column:
    return _desde(casos, CORTES_VOLUMEN, RESTO_VOLUMEN)


def clase_volumen_total(casos: Column) -> Column:
    return F.concat(clase_volumen(casos), F.lit(SUFIJO_VOLUMEN))


def clase_volumen_fila(casos: Column) -> Column:
    return _tramo_derecho(casos, TRAMOS_VOLUMEN)


def clase_eficiencia_fila(tasa: Column) -> Column:
    return _tramo_derecho(tasa, TRAMOS_EFICIENCIA)


def banda(tasa: Column, medio: float) -> Column:
    """Colour band of a bar: below .8, below ``medio``, or above."""
    return (
        F.when(tasa < 0.8, F.lit("rojo"))
        .when(tasa < medio, F.lit("amarillo"))
        .when(tasa.isNotNull(), F.lit("verde"))
    )


def fuerza_correlacion(r: Column) -> Column:
    return _desde(F.abs(r), FUERZA_CORRELACION, RESTO_FUERZA)


def signo_correlacion(r: Column) -> Column:
    return F.when(r > 0, F.lit("Positiva")).otherwise(F.lit("Negativa"))


def nivel_concentracion(pct: Column) -> Column:
    return _desde(pct, CONCENTRACION, RESTO_CONCENTRACION)


def direccion_tendencia(pendiente: Column) -> Column:
    return (
        F.when(pendiente > 0, F.lit("Creciente"))
        .when(pendiente < 0, F.lit("Decreciente"))
        .otherwise(F.lit("Estable"))
    )


def etiqueta_iqr(pct: Column) -> Column:
    return _desde(pct, ATIPICOS_IQR, RESTO_ATIPICOS_IQR, estricto=True)


def etiqueta_z(pct: Column) -> Column:
    return _desde(pct, ATIPICOS_Z, RESTO_ATIPICOS_Z, estricto=True)


def _contiene_regla(c: Column, alternativas: Sequence[Sequence[str]]) -> Column:
    todas = [reduce(lambda a, b: a & b, [c.contains(p) for p in alt]) for alt in alternativas]
    return reduce(lambda a, b: a | b, todas)


def _por_nombre(c: Column, reglas, resto: str) -> Column:
    """First rule whose words occur in the upper-cased name."""
    nombre = F.upper(c)
    w = F.when(c.isNull(), F.lit(None).cast("string"))
    for clase, alternativas in reglas:
        w = w.when(_contiene_regla(nombre, alternativas), F.lit(clase))
    return w.otherwise(F.lit(resto))


def categoria_caso(c: Column) -> Column:
    return _por_nombre(c, CATEGORIAS_CASO, RESTO_CATEGORIA)


def area_especializacion(c: Column) -> Column:
    return _por_nombre(c, AREAS, RESTO_AREA)


def region_geografica(dpto: Column) -> Column:
    reglas = [(r, [(d,) for d in dptos]) for r, dptos in REGIONES]
    return _por_nombre(dpto, reglas, RESTO_REGION)


def nivel_jerarquico(c: Column) -> Column:
    nombre = F.upper(c)
    w = F.when(c.isNull(), F.lit(None).cast("int"))
    for palabra, nivel in NIVELES:
        w = w.when(nombre.contains(palabra), F.lit(nivel))
    return w.otherwise(F.lit(RESTO_NIVEL))
