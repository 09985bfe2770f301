"""Outliers of one variable and outliers in the context of the case load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from balanza.esquema import ROLES
from balanza.functions.clases import etiqueta_iqr, etiqueta_z
from balanza.operators.frecuencias import (
    acumular,
    cuantil_agregado,
    tabla_larga,
    unir_por_grupo,
)
from balanza.operators.limpieza import limites_iqr
from balanza.operators.patrones import marca_sobre_atencion
from balanza.sesion import cortar

# Fixed values of the outlier rules.
MINIMO_VALORES = 10
ESCALA_MAD = 0.6745
LIMITE_MAD = 3.5
EXCESO_CONTEXTUAL = 2
PERCENTIL_EXTREMO = 0.99
K_EXTREMOS = 5

_G = ["variable"]


def _resumir(marcada: DataFrame, fuera: Column, k: int = K_EXTREMOS) -> DataFrame:
    """Count, share and the k largest values (with repeats) of the flagged rows."""
    v, n = F.col("valor"), F.col("n")
    total = marcada.groupBy(*_G).agg(
        F.sum(n).alias("total_valores"),
        F.coalesce(F.sum(F.when(fuera, n)), F.lit(0)).alias("conteo"),
    )
    # At most k distinct values per variable pass the window.
    puesto = F.row_number().over(Window.partitionBy(*_G).orderBy(F.desc("valor")))
    altos = marcada.filter(fuera).withColumn("_p", puesto).filter(F.col("_p") <= k)
    texto = F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    lista = F.array_sort(
        F.collect_list(F.struct("_p", texto.alias("t"), F.least(n, F.lit(k)).cast("int").alias("n")))
    )
    repetidos = F.flatten(F.transform(lista, lambda x: F.array_repeat(x["t"], x["n"])))
    altos = altos.groupBy(*_G).agg(
        F.array_join(F.slice(repetidos, 1, k), ", ").alias("valores_extremos")
    )
    return (
        total.join(altos, "variable", "left")
        .filter(F.col("total_valores") >= MINIMO_VALORES)
        .withColumns(
            {
                "porcentaje": F.col("conteo") / F.col("total_valores") * 100,
                "valores_extremos": F.coalesce("valores_extremos", F.lit("")),
            }
        )
    )


def outliers_iqr(
    df: DataFrame, variables: Sequence[str] = ROLES.numericas, peso: str | None = None
) -> DataFrame:
    """Values outside the quartile fences, per variable."""
    freq = cortar(tabla_larga(df, variables, peso=peso))
    con = unir_por_grupo(
        freq.filter(F.col("valor").isNotNull()),
        limites_iqr(freq, _G),
        _G,
        ["limite_inferior", "limite_superior"],
    )
    fuera = (F.col("valor") < F.col("limite_inferior")) | (
        F.col("valor") > F.col("limite_superior")
    )
    r = _resumir(con, fuera)
    es_metrica = F.col("variable").isin(*ROLES.metricas)
    return r.withColumn(
        "interpretacion",
        F.when(es_metrica, etiqueta_iqr(F.col("porcentaje"))).otherwise(F.lit("detectados")),
    )


def outliers_mad(
    df: DataFrame, variables: Sequence[str] = ROLES.numericas, peso: str | None = None
) -> DataFrame:
    """Modified z-score on the median absolute deviation; skipped where that is 0."""
    freq = cortar(tabla_larga(df, variables, peso=peso).filter(F.col("valor").isNotNull()))
    med = acumular(freq, _G).groupBy(*_G).agg(cuantil_agregado(0.5).alias("mediana"))
    con = cortar(unir_por_grupo(freq, med, _G, ["mediana"]))
    desvio = F.abs(F.col("valor") - F.col("mediana"))
    dev = con.groupBy(*_G, desvio.alias("valor")).agg(F.sum("n").alias("n"))
    mad = acumular(dev, _G).groupBy(*_G).agg(cuantil_agregado(0.5).alias("mad"))
    con = unir_por_grupo(con, mad, _G, ["mad"]).filter(F.col("mad") > 0)
    z = F.lit(ESCALA_MAD) * (F.col("valor") - F.col("mediana")) / F.col("mad")
    r = _resumir(con, F.abs(z) > LIMITE_MAD)
    return r.withColumn("interpretacion", etiqueta_z(F.col("porcentaje")))


def resumen_univariado(
    pares: DataFrame, variables: Sequence[str] = ROLES.metricas
) -> DataFrame:
    """Both methods side by side for the main measures."""
    iqr = outliers_iqr(pares, variables, "n").withColumn("metodo", F.lit("IQR"))
    mad = outliers_mad(pares, variables, "n").withColumn("metodo", F.lit("Z_Score_Modificado"))
    return iqr.unionByName(mad).select(
        "variable", "metodo", "conteo", "porcentaje", "interpretacion"
    )


def umbrales(pares: DataFrame) -> DataFrame:
    """Median and 99th percentile of the filed cases, in one row."""
    freq = pares.groupBy("ingresado").agg(F.sum("n").alias("n"))
    return acumular(freq, valor="ingresado").agg(
        F.struct(
            cuantil_agregado(0.5, "ingresado").alias("mediana"),
            cuantil_agregado(PERCENTIL_EXTREMO, "ingresado").alias("p99"),
        ).alias("u")
    )


def _marcas(pares: DataFrame) -> tuple[dict[str, Column], Column]:
    u = cortar(umbrales(pares)).scalar()
    p99, mediana = u.getField("p99"), u.getField("mediana")
    return {
        "sobre_atencion_extrema": marca_sobre_atencion(EXCESO_CONTEXTUAL),
        "volumen_extremo": F.col("ingresado") > p99,
        "sin_atencion_alto_volumen": (F.col("atendido") == 0) & (F.col("ingresado") > mediana),
    }, p99


def outliers_contextuales(pares: DataFrame) -> DataFrame:
    """Number of contextual outliers of each kind, with the threshold used."""
    marcas, p99 = _marcas(pares)
    conteos = [
        F.coalesce(F.sum(F.when(m, F.col("n"))), F.lit(0)).alias(k) for k, m in marcas.items()
    ]
    filas = [
        F.struct(
            F.lit(k).alias("tipo"),
            F.col(k).alias("conteo"),
            (p99 if k == "volumen_extremo" else F.lit(None).cast("double")).alias("umbral"),
        )
        for k in marcas
    ]
    return pares.agg(*conteos).select(F.inline(F.array(*filas)))


def casos_contextuales(
    df: DataFrame, pares: DataFrame, k: int = K_EXTREMOS
) -> DataFrame:
    """The k most extreme rows of each kind.

    One pass: the rank limit drops all but k rows per kind in each task, before the
    shuffle.
    """
    marcas, _ = _marcas(pares)
    tipos = F.array_compact(F.array(*[F.when(m, F.lit(t)) for t, m in marcas.items()]))
    filas = df.select(
        F.explode(tipos).alias("tipo"),
        "distrito_fiscal",
        "materia",
        "especializada",
        "ingresado",
        "atendido",
        "tasa_atencion",
    )
    medida = F.when(
        F.col("tipo") == "sobre_atencion_extrema", F.col("tasa_atencion")
    ).otherwise(F.col("ingresado").cast("double"))
    orden = Window.partitionBy("tipo").orderBy(
        F.desc_nulls_last("_m"),
        "distrito_fiscal",
        "materia",
        "especializada",
        "ingresado",
        "atendido",
    )
    return (
        filas.withColumn("_m", medida)
        .withColumn("puesto", F.row_number().over(orden))
        .filter(F.col("puesto") <= k)
        .drop("_m")
    )
