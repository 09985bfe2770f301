"""Column names, column roles and explicit schemas of the case-load tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed value: text that marks an office without a speciality.
SENTINELA = "NO_TIPO_ESPECIALIZADA"

# Columns of the flat yearly table.
COLUMNAS_PLANAS = (
    "periodo",
    "anio",
    "fecha_descarga",
    "fecha_corte",
    "distrito_fiscal",
    "tipo_fiscalia",
    "materia",
    "especialidad",
    "tipo_caso",
    "especializada",
    "ingresado",
    "atendido",
    "ubigeo_pjfs",
    "dpto_pjfs",
    "prov_pjfs",
    "dist_pjfs",
)

ANIO_DESCARGA = "año_descarga"


@dataclass(frozen=True)
class RolesColumnas:
    """Which columns play which part; operators use these as defaults."""

    numericas: tuple[str, ...] = ("anio", "ingresado", "atendido")
    categoricas: tuple[str, ...] = (
        "distrito_fiscal",
        "tipo_fiscalia",
        "materia",
        "especialidad",
        "tipo_caso",
        "especializada",
        "dpto_pjfs",
        "prov_pjfs",
    )
    identificacion: tuple[str, ...] = ("ubigeo_pjfs", "dist_pjfs")
    fechas: tuple[str, ...] = ("fecha_descarga", "fecha_corte", "periodo")
    redundantes: tuple[str, ...] = (ANIO_DESCARGA,)
    metricas: tuple[str, ...] = ("ingresado", "atendido")
    geograficas: tuple[str, ...] = ("distrito_fiscal", "dpto_pjfs", "prov_pjfs")
    # Rows lacking any of these are dropped by the cleaning job.
    criticas: tuple[str, ...] = tuple(
        c for c in COLUMNAS_PLANAS if c not in ("especializada", "ingresado", "atendido")
    )
    # Columns whose text is upper-cased and stripped.
    texto: tuple[str, ...] = (
        "distrito_fiscal",
        "tipo_fiscalia",
        "materia",
        "especialidad",
        "tipo_caso",
        "especializada",
        "dpto_pjfs",
        "prov_pjfs",
        "dist_pjfs",
    )
    perfil_categorico: tuple[str, ...] = (
        "distrito_fiscal",
        "tipo_fiscalia",
        "materia",
        "especialidad",
        "tipo_caso",
        "especializada",
    )
    perfil_numerico: tuple[str, ...] = ("anio", "ingresado", "atendido", "ubigeo_pjfs")
    correlacion: tuple[str, ...] = (
        "ingresado",
        "atendido",
        "tasa_atencion",
        "casos_pendientes",
    )


ROLES = RolesColumnas()


def esquema_crudo() -> T.StructType:
    """Raw files are read as text only; types are given later, value by value."""
    return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNAS_PLANAS])
