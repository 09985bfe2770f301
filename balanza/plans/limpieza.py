"""Cleaning plan: raw yearly files -> clean tables and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from balanza.functions.texto import FORMATOS_FECHA
from balanza.operators import limpieza as lim
from balanza.sesion import cortar
from balanza.sinks import salidas
from balanza.sources.crudo import ORIGEN, ROTA, contar_rotas, leer_crudos


def reportes(crudo: DataFrame, limpio: DataFrame, formatos: Sequence[str] = FORMATOS_FECHA) -> dict[str, DataFrame]:
    """All report tables of the cleaning job, before and after."""
    tipado = lim.convertir_tipos(lim.quitar_duplicados(lim.limpiar_nulos(crudo)), formatos)
    salida = {
        "reporte": lim.reporte_limpieza(crudo, formatos),
        "cambios_texto": lim.cambios_texto(tipado),
        "outliers": lim.outliers_limpieza(limpio),
    }
    medidas = lim.medidas_a_numero(crudo).withColumn("anio", lim.anio_de_fila(crudo["anio"]))
    for momento, df in {"inicial": medidas, "final": limpio}.items():
        salida[f"calidad_{momento}"] = lim.perfil_calidad(crudo if momento == "inicial" else df)
        salida[f"categoricas_{momento}"] = lim.perfil_categorico(df)
        salida[f"top_valores_{momento}"] = lim.top_valores(df)
        salida[f"numericas_{momento}"] = lim.perfil_numerico(df)
        salida[f"fechas_{momento}"] = lim.perfil_fechas(df)
    return salida


def ejecutar_limpieza(
    spark: SparkSession,
    rutas: Mapping[int, str],
    carpeta: str,
    carpeta_reportes: str,
    formatos: Sequence[str] = FORMATOS_FECHA,
    csv: bool = False,
) -> DataFrame:
    """Clean all years in one job, write the tables and the reports, return the clean table."""
    # The text is parsed once; everything below reads the written rows.
    leido = cortar(leer_crudos(spark, rutas, con_origen=True))
    crudo = leido.drop(ORIGEN, ROTA)
    ruta = salidas.escribir_consolidado(lim.limpiar(crudo, formatos), carpeta)
    # From here on the written table is read, not the cleaning repeated.
    limpio = spark.read.parquet(ruta)
    if csv:
        salidas.escribir_csv_anuales(limpio, f"{carpeta}/csv")
    informes = reportes(crudo, limpio, formatos) | {"filas_rotas": contar_rotas(leido)}
    for nombre, df in informes.items():
        salidas.escribir_json(df, f"{carpeta_reportes}/{nombre}")
    return limpio
