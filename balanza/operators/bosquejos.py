"""Sketches of each year's rows, stored once and merged for any span of years.

HyperLogLog sketches estimate distinct values, KLL sketches quantiles.  They are opt-in:
all other operators give exact results.  A sketch has a bounded size, whatever the
number of rows, and a merged one is as good as one over all the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.esquema import ROLES

# Sizes of the sketches: 2 ** LG_K registers (standard error 0.8 %), K items a level (rank error some 0.6 %).
LG_K, K = 14, 800
ERROR_DISTINTOS = 1.04 / 2 ** (LG_K / 2)
ERROR_RANGO = 2.296 / K**0.9021
DISTINTOS, CUANTILES = "distintos", "cuantiles"
PROBABILIDADES = {"q05": 0.05, "q25": 0.25, "mediana": 0.5, "q75": 0.75, "q95": 0.95}


def bosquejar(
    df: DataFrame,
    distintas: Sequence[str] = ROLES.categoricas,
    medidas: Sequence[str] = ROLES.metricas,
    clave: str = "anio",
) -> DataFrame:
    """(clave, variable, clase, filas, bosquejo) of each year, from one pass over the rows; ``filas`` counts values."""

    def celda(variable: str, clase: str) -> Column:
        bosquejo = F.col(f"{clase}_{variable}")
        return F.struct(
            F.lit(variable).alias("variable"), F.lit(clase).alias("clase"), F.col(f"n_{variable}").alias("filas"), bosquejo.alias("bosquejo")
        )

    # A sketch cannot take what is no value, so each has its own count.
    conteos = [F.count(c).alias(f"n_{c}") for c in dict.fromkeys((*distintas, *medidas))]
    hll = [F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"{DISTINTOS}_{c}") for c in distintas]
    kll = [F.kll_sketch_agg_bigint(F.col(c).cast("long"), K).alias(f"{CUANTILES}_{c}") for c in medidas]
    anual = df.groupBy(clave).agg(*conteos, *hll, *kll)
    celdas = [celda(c, DISTINTOS) for c in distintas] + [celda(c, CUANTILES) for c in medidas]
    return anual.select(clave, F.inline(F.array(*celdas))).filter(F.col("filas") > 0)


def guardar_bosquejos(bosquejos: DataFrame, ruta: str, clave: str = "anio") -> None:
    """Write the sketches of the years in ``bosquejos`` and leave other years as they are."""
    escritor = bosquejos.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    escritor.partitionBy(clave).parquet(ruta)


def unir_bosquejos(bosquejos: DataFrame, desde: int | None = None, hasta: int | None = None, clave: str = "anio") -> DataFrame:
    """(variable, clase, filas, bosquejo) over a span of years, both ends included."""
    if desde is not None:
        bosquejos = bosquejos.filter(F.col(clave) >= desde)
    if hasta is not None:
        bosquejos = bosquejos.filter(F.col(clave) <= hasta)

    def de(clase: str) -> Column:
        return F.when(F.col("clase") == clase, F.col("bosquejo"))

    unidos = bosquejos.groupBy("variable", "clase").agg(
        F.sum("filas").alias("filas"),
        F.hll_union_agg(de(DISTINTOS)).alias("_hll"),
        F.kll_merge_agg_bigint(de(CUANTILES)).alias("_kll"),
    )
    return unidos.select("variable", "clase", "filas", F.when(F.col("clase") == DISTINTOS, F.col("_hll")).otherwise(F.col("_kll")).alias("bosquejo"))


def distintos_estimados(unidos: DataFrame) -> DataFrame:
    """(variable, filas, distintos)."""
    return unidos.filter(F.col("clase") == DISTINTOS).select(
        "variable", "filas", F.hll_sketch_estimate("bosquejo").alias("distintos")
    )


def cuantiles_estimados(unidos: DataFrame, probabilidades: dict[str, float] | None = None) -> DataFrame:
    """(variable, filas, q05, q25, ...) of the measures."""
    ps = PROBABILIDADES if probabilidades is None else probabilidades
    return unidos.filter(F.col("clase") == CUANTILES).select(
        "variable", "filas", *[F.kll_sketch_get_quantile_bigint("bosquejo", F.lit(float(p))).alias(n) for n, p in ps.items()]
    )


def contraste(df: DataFrame, bosquejos: DataFrame, desde: int, hasta: int, clave: str = "anio") -> DataFrame:
    """The sketches of a span against its rows: exact distinct counts, and whether every estimate lies within its bounds.

    Distinct counts may be four standard errors off, quantiles three rank errors.
    """
    unidos = unir_bosquejos(bosquejos, desde, hasta, clave)
    filas = df.filter(F.col(clave).between(desde, hasta))
    partes = []
    for f in distintos_estimados(unidos).collect():
        exactos = F.countDistinct(f["variable"])
        dentro = F.abs(exactos - f["distintos"]) <= F.greatest(4 * ERROR_DISTINTOS * exactos, F.lit(1.0))
        partes.append(
            filas.agg(
                F.lit(f["variable"]).alias("variable"), F.lit(DISTINTOS).alias("clase"), F.lit(f["filas"]).cast("long").alias("filas"),
                exactos.alias("exactos"), dentro.alias("dentro"),
            )
        )
    for f in cuantiles_estimados(unidos).collect():
        v, margen = F.col(f["variable"]), 3 * ERROR_RANGO
        total = F.count(v)
        dentro = F.lit(True)
        for nombre, p in PROBABILIDADES.items():
            menores, hasta_aqui = F.count_if(v < f[nombre]) / total, F.count_if(v <= f[nombre]) / total
            dentro = dentro & (menores - margen <= p) & (hasta_aqui + margen >= p)
        partes.append(
            filas.agg(
                F.lit(f["variable"]).alias("variable"), F.lit(CUANTILES).alias("clase"), F.lit(f["filas"]).cast("long").alias("filas"),
                F.countDistinct(f["variable"]).alias("exactos"), dentro.alias("dentro"),
            )
        )
    salida = partes[0]
    for p in partes[1:]:
        salida = salida.unionByName(p)
    return salida.withColumns({"desde": F.lit(desde), "hasta": F.lit(hasta)})
