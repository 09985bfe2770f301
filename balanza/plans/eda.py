"""Exploratory plan: statistics, patterns, outliers, chart data and findings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from balanza.functions.tasas import derivar_metricas
from balanza.operators import atipicos, bosque, descriptiva, graficos, grupos, hallazgos, patrones
from balanza.sesion import construir
from balanza.sinks import salidas
from balanza.sources.crudo import leer_limpio, tipar_limpio


def estadisticas(
    plana: DataFrame, df: DataFrame, pares: DataFrame, cubo: DataFrame
) -> dict[str, Callable[[], DataFrame]]:
    """``plana`` is the table before the derived columns of ``df``; sections of sums alone read ``cubo``."""
    de = descriptiva
    pearson, spearman = de.correlacion_pearson(pares), de.correlacion_spearman(pares)
    return {
        "resumen_inicial": lambda: de.resumen_inicial(df),
        "resumen_general": lambda: de.resumen_general(plana),
        "variables_numericas": lambda: de.perfil_numerico(df),
        "normalidad": lambda: de.normalidad(df),
        "variables_categoricas": lambda: de.perfil_categorico(df),
        "metricas_eficiencia": lambda: de.metricas_eficiencia(pares),
        "metricas_volumen": lambda: de.metricas_volumen(df),
        "metricas_temporales": lambda: de.metricas_temporales(cubo),
        "matriz_pearson": lambda: pearson,
        "matriz_spearman": lambda: spearman,
        "correlaciones_fuertes_pearson": lambda: de.correlaciones_fuertes(pearson),
        "correlaciones_fuertes_spearman": lambda: de.correlaciones_fuertes(spearman),
    }


def patrones_y_sesgos(df: DataFrame, pares: DataFrame, cubo: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    pa = patrones
    return {
        "concentracion_departamental": lambda: pa.concentracion_departamental(cubo),
        "disparidad_departamental": lambda: pa.disparidad_departamental(df),
        "estadisticas_anuales": lambda: pa.estadisticas_anuales(df),
        "anios_atipicos": lambda: pa.anios_atipicos(cubo),
        "sesgo_temporal": lambda: pa.sesgo_temporal(cubo),
        "dominancia_materia": lambda: pa.dominancia_materia(df),
        "eficiencia_tipo_fiscalia": lambda: pa.eficiencia_tipo_fiscalia(df),
        "efecto_especializacion": lambda: pa.efecto_especializacion(df),
        "anomalias": lambda: pa.anomalias(pares),
    }


def outliers(df: DataFrame, pares: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    return {
        "outliers_iqr": lambda: atipicos.outliers_iqr(df),
        "outliers_mad": lambda: atipicos.outliers_mad(df),
        "outliers_contextuales": lambda: atipicos.outliers_contextuales(pares),
        "casos_contextuales": lambda: atipicos.casos_contextuales(df, pares),
    }


def agrupaciones(pares: DataFrame, reinicios: int) -> dict[str, DataFrame]:
    """Natural groups, when there are rows enough."""
    perfil = grupos.clusters_perfil(pares, reinicios)
    if perfil is None:
        return {}
    return {"agrupaciones": perfil, "hallazgos_agrupaciones": hallazgos.hallazgos_grupos(perfil)}


def multivariados(df: DataFrame, marcados: DataFrame | None) -> dict[str, DataFrame]:
    """Multivariate outliers, when there are rows enough."""
    if marcados is None:
        return {}
    return {
        "outliers_multivariados": bosque.outliers_multivariados(marcados),
        "casos_multivariados": bosque.casos_multivariados(df, marcados),
        "dispersion_multivariada": bosque.dispersion_multivariada(marcados),
    }


def datos_graficos(df: DataFrame, pares: DataFrame, cubo: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    gr = graficos
    return {
        "histograma": lambda: gr.histograma(pares),
        "marcadores": lambda: gr.marcadores(pares),
        "kde": lambda: gr.kde(pares),
        "boxplot": lambda: gr.boxplot(pares),
        "boxplot_p99": lambda: gr.boxplot_p99(pares),
        "forma_distribucion": lambda: gr.forma(pares),
        "mapa_pearson": lambda: descriptiva.triangulo_inferior(descriptiva.correlacion_pearson(pares)),
        "mapa_spearman": lambda: descriptiva.triangulo_inferior(descriptiva.correlacion_spearman(pares)),
        "participacion_materia": lambda: gr.participacion(df, "materia"),
        "participacion_tipo_fiscalia": lambda: gr.participacion(df, "tipo_fiscalia"),
        "top_distritos": lambda: gr.top_distritos(cubo),
        "tasa_departamento": lambda: gr.tasa_departamento(cubo),
        "participacion_departamentos": lambda: gr.participacion_departamentos(cubo),
        "dispersion_distrito": lambda: gr.dispersion_distrito(cubo),
        "regresion_distrito": lambda: gr.regresion_distrito(cubo),
        "resumen_geografico": lambda: gr.resumen_geografico(cubo),
        "evolucion_anual": lambda: descriptiva.evolucion_anual(cubo),
        "pivot_anio_materia": lambda: gr.pivot_anio_materia(cubo),
        "variacion_anual": lambda: gr.variacion_anual(cubo),
        "resumen_periodo": lambda: gr.resumen_periodo(cubo),
        "categorias_eficiencia": lambda: gr.categorias_eficiencia(pares),
        "eficiencia_materia": lambda: gr.eficiencia_materia(df),
        "barras_tipo_fiscalia": lambda: gr.barras_tipo_fiscalia(df),
        "regresion_registros": lambda: gr.regresion_registros(pares),
        "recta_registros": lambda: gr.recta_registros(pares),
        "dispersion_registros": lambda: gr.dispersion_registros(pares),
        "outliers_resumen": lambda: atipicos.resumen_univariado(pares),
    }


def ejecutar_eda(df: DataFrame, reinicios: int = grupos.REINICIOS) -> dict[str, DataFrame]:
    """Every section of the analysis over one clean table."""
    base = derivar_metricas(tipar_limpio(df))
    pares, cubo = descriptiva.pares_medidas(base), descriptiva.cubo_casos(base)
    salida = construir(
        {
            **estadisticas(df, base, pares, cubo),
            **patrones_y_sesgos(base, pares, cubo),
            **outliers(base, pares),
            **datos_graficos(base, pares, cubo),
        }
    )
    # The forest is grown once.
    marcados = bosque.marcar_multivariados(pares)
    salida |= agrupaciones(pares, reinicios) | multivariados(base, marcados)
    metricas = hallazgos.metricas(pares, cubo, marcados)
    salida["hallazgos"] = hallazgos.evaluar(metricas)
    return salida


def ejecutar_analisis(
    spark: SparkSession,
    ruta: str,
    carpeta: str = "resultados_eda",
    ahora: dt.datetime | None = None,
    reinicios: int = grupos.REINICIOS,
) -> str:
    """Read a clean table, run the analysis, write the result tree; return its folder.

    The input is kept on executor disks meanwhile; a lost block is read again.
    """
    df = leer_limpio(spark, ruta).persist(StorageLevel.DISK_ONLY)
    try:
        return salidas.escribir_resultados(ejecutar_eda(df, reinicios), carpeta, ahora)
    finally:
        df.unpersist()
