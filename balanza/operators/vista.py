"""The wide view: one row per case record with every dimension attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.esquema import SENTINELA
from balanza.functions import clases
from balanza.functions.tasas import tasa_almacen

# Columns of the wide view, in order, after the record id.
COLUMNAS_VISTA = (
    "anio",
    "periodo",
    "distrito_fiscal",
    "departamento",
    "provincia",
    "distrito",
    "ubigeo_pjfs",
    "region_geografica",
    "tipo_fiscalia",
    "nivel_jerarquico",
    "materia",
    "especialidad",
    "tipo_caso",
    "categoria_caso",
    "fiscalia_especializada",
    "area_especializacion",
    "casos_ingresados",
    "casos_atendidos",
    "casos_pendientes",
    "tasa_atencion",
    "fecha_descarga",
    "fecha_corte",
)


def vista_desde_casos(df: DataFrame) -> DataFrame:
    """Wide view straight from a flat clean table, with no joins.

    Same columns as the star-schema view.  Columns whose source is missing from
    ``df`` are left out, so a caller can read only what a query needs.
    """
    c = F.col
    sin_sentinela = F.when(c("especializada") != SENTINELA, c("especializada"))
    fuentes = {
        "anio": ("anio", c("anio")),
        "periodo": ("periodo", c("periodo")),
        "distrito_fiscal": ("distrito_fiscal", c("distrito_fiscal")),
        "departamento": ("dpto_pjfs", c("dpto_pjfs")),
        "provincia": ("prov_pjfs", c("prov_pjfs")),
        "distrito": ("dist_pjfs", c("dist_pjfs")),
        "ubigeo_pjfs": ("ubigeo_pjfs", c("ubigeo_pjfs")),
        "region_geografica": ("dpto_pjfs", clases.region_geografica(c("dpto_pjfs"))),
        "tipo_fiscalia": ("tipo_fiscalia", c("tipo_fiscalia")),
        "nivel_jerarquico": ("tipo_fiscalia", clases.nivel_jerarquico(c("tipo_fiscalia"))),
        "materia": ("materia", c("materia")),
        "especialidad": ("especialidad", c("especialidad")),
        "tipo_caso": ("tipo_caso", c("tipo_caso")),
        "categoria_caso": ("tipo_caso", clases.categoria_caso(c("tipo_caso"))),
        "fiscalia_especializada": ("especializada", sin_sentinela),
        "area_especializacion": ("especializada", clases.area_especializacion(sin_sentinela)),
        "casos_ingresados": ("ingresado", c("ingresado")),
        "casos_atendidos": ("atendido", c("atendido")),
        "casos_pendientes": ("atendido", c("ingresado") - c("atendido")),
        "tasa_atencion": ("atendido", tasa_almacen(c("ingresado"), c("atendido"))),
        "fecha_descarga": ("fecha_descarga", c("fecha_descarga").cast("date")),
        "fecha_corte": ("fecha_corte", c("fecha_corte").cast("date")),
    }
    if "region_geografica" in df.columns:
        fuentes["region_geografica"] = ("region_geografica", c("region_geografica"))
    presentes = set(df.columns)
    return df.select(
        *[expr.alias(nombre) for nombre, (src, expr) in fuentes.items() if src in presentes]
    )
