"""Writers: clean tables, star schema, reports and result trees."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.sources.crudo import CONSOLIDADO

HECHOS = "fact_casos_fiscales"


def escribir_consolidado(df: DataFrame, carpeta: str) -> str:
    """Clean table of all years as parquet, one folder per year.

    The rebalance hint evens out the files: a big year is split over many tasks and
    small ones do not leave a file per task.
    """
    ruta = f"{carpeta}/{CONSOLIDADO}"
    equilibrado = df.hint("rebalance", "anio")
    equilibrado.write.mode("overwrite").partitionBy("anio").parquet(ruta)
    return ruta


def escribir_csv_anuales(df: DataFrame, ruta: str) -> None:
    """Clean CSV files, one folder per year (``anio=YYYY``)."""
    (
        df.hint("rebalance", "anio")
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .partitionBy("anio")
        .csv(ruta)
    )


def escribir_json(df: DataFrame, ruta: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(ruta)


def escribir_estrella(dims: Mapping[str, DataFrame], hechos: DataFrame, base: str) -> None:
    """Dimension tables and the fact, partitioned by its time key."""
    ahora = F.current_timestamp().alias("created_at")
    for nombre, d in dims.items():
        d.select("*", ahora).write.mode("overwrite").parquet(f"{base}/{nombre}")
    (
        hechos.select("*", ahora)
        .hint("rebalance", "id_tiempo")
        .write.mode("overwrite")
        .partitionBy("id_tiempo")
        .parquet(f"{base}/{HECHOS}")
    )


def agregar_estrella(
    dims: Mapping[str, DataFrame],
    previas: Mapping[str, DataFrame],
    claves: Mapping[str, str],
    hechos: DataFrame,
    base: str,
) -> None:
    """Add the dimension rows that ``previas`` lacks and replace the years that ``hechos`` has.

    Dimension rows come first, and by key, so a load that broke off can be run again:
    its new keys are found then and not given twice.  Only the folders of the years in
    ``hechos`` are written anew; all other files stay.
    """
    ahora = F.current_timestamp().alias("created_at")
    for nombre, d in dims.items():
        clave = claves[nombre]
        ultima = previas[nombre].agg(F.max(clave)).first()[0] or 0
        nuevas = d.drop("created_at").filter(F.col(clave) > ultima)
        if not nuevas.isEmpty():
            nuevas.select("*", ahora).write.mode("append").parquet(f"{base}/{nombre}")
    (
        hechos.select("*", ahora)
        .hint("rebalance", "id_tiempo")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("id_tiempo")
        .parquet(f"{base}/{HECHOS}")
    )


def leer_estrella(
    spark: SparkSession, base: str, nombres: list[str]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Star schema as written; record ids are now fixed."""
    return (
        {n: spark.read.parquet(f"{base}/{n}") for n in nombres},
        spark.read.parquet(f"{base}/{HECHOS}"),
    )


# Columns that name a row of a result rather than measure something.
CLAVES_RESULTADO = (
    "variable",
    "variable1",
    "variable2",
    "var1",
    "var2",
    "anio",
    "barra",
    "punto",
    "celda_x",
    "celda_y",
    "dpto_pjfs",
    "distrito_fiscal",
    "materia",
    "tipo_fiscalia",
    "tipo",
    "puesto",
    "metodo",
    "categoria",
    "cluster",
    "regla",
)


def como_metricas(nombre: str, df: DataFrame) -> DataFrame:
    """Any small result in one long shape: section, variable, metric, number or text.

    Several key columns are joined by ``_``.
    """
    numericos = ("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")
    claves = [c for c in df.columns if c in CLAVES_RESULTADO]

    def celda(c: str, tipo: str) -> Column:
        es_num = tipo.startswith(numericos)
        texto = F.col(f"`{c}`").cast("string")
        return F.struct(
            F.lit(c).alias("metrica"),
            (F.col(f"`{c}`") if es_num else F.lit(None)).cast("double").alias("valor_num"),
            (F.lit(None) if es_num else texto).cast("string").alias("valor_txt"),
        )

    celdas = [celda(c, t) for c, t in df.dtypes if c not in claves or len(claves) == len(df.columns)]
    nombres = [F.col(c).cast("string") for c in claves]
    variable = F.concat_ws("_", *nombres) if claves else F.lit(None).cast("string")
    return df.select(
        F.lit(nombre).alias("seccion"), variable.alias("variable"), F.inline(F.array(*celdas))
    )


def escribir_resultados(
    resultados: Mapping[str, DataFrame],
    carpeta: str,
    ahora: dt.datetime | None = None,
    hilos: int = 8,
) -> str:
    """Result tree as JSON lines in a time-stamped folder, one sub-folder per section."""
    sello = (ahora or dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    ruta = f"{carpeta}/resultados_eda_{sello}"

    def escribir(par: tuple[str, DataFrame]) -> None:
        nombre, df = par
        largo = como_metricas(nombre, df).drop("seccion")
        escribir_json(largo, f"{ruta}/seccion={nombre}")

    with ThreadPoolExecutor(hilos) as grupo:
        list(grupo.map(escribir, resultados.items()))
    return ruta
