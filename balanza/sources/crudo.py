"""Reading raw yearly files and clean tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.esquema import ANIO_DESCARGA, COLUMNAS_PLANAS
from balanza.functions.texto import FALTANTES, a_entero, a_fecha, a_numero, faltante_a_nulo
from balanza.sources.registros import leer_registros

_LOG = logging.getLogger(__name__)

# Names under which clean tables are kept in a folder.
CONSOLIDADO = "casos_fiscales_consolidado"
PATRON_LIMPIO = "*limpio.csv"


# Quotes are doubled inside quoted cells, and a quoted cell may hold line breaks.
_CELDAS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rota"}
_CABECERA = {**_CELDAS, "header": True, "encoding": "UTF-8", "multiLine": True}


def leer_csv(
    spark: SparkSession, ruta: str, faltantes=FALTANTES, con_rotas: bool = False
) -> DataFrame:
    """One CSV file: text columns named by its own header; missing-cell tokens become null.

    Types are never inferred.  Rows with too many or too few cells keep the cells that
    have a name; with ``con_rotas`` the text of such a row is given in ``_rota``.  A file
    is cut into records by many tasks, also where cells hold line breaks.
    """
    # A line break inside a header cell can hide that lines end in two characters.
    columnas = [c.removesuffix("\r") for c in spark.read.options(**_CABECERA).csv(ruta).columns]
    esquema = ", ".join(f"`{c}` STRING" for c in (*columnas, "_rota"))
    celdas = F.from_csv("texto", esquema, _CELDAS)
    df = leer_registros(spark, ruta).select(celdas.alias("c")).select("c.*")
    extra = ["_rota"] if con_rotas else []
    return df.select(
        *[faltante_a_nulo(F.col(f"`{c}`"), faltantes).alias(c) for c in columnas], *extra
    )


def _abribles(spark: SparkSession, rutas: Mapping[int, str]) -> dict[int, DataFrame]:
    partes = {}
    for anio, ruta in rutas.items():
        try:
            partes[anio] = leer_csv(spark, ruta, con_rotas=True)
        except AnalysisException as e:
            _LOG.error("year %s skipped: %s", anio, e.getCondition() or e)
    if not partes:
        raise FileNotFoundError("no yearly file could be read")
    return partes


def _juntar(partes: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), partes)


# Columns that tell where a raw row comes from and whether its number of cells was wrong.
ORIGEN, ROTA = "_anio_archivo", "_fila_rota"


def leer_crudos(spark: SparkSession, rutas: Mapping[int, str], con_origen: bool = False) -> DataFrame:
    """All yearly files as one table, columns aligned by name.

    A year whose file cannot be opened is logged and left out; with no year left the
    read fails.  With ``con_origen`` the year of the file and a mark of broken rows come
    along, so that ``contar_rotas`` needs no second reading.
    """
    partes = [
        df.withColumns({ORIGEN: F.lit(anio), ROTA: F.col("_rota").isNotNull()})
        for anio, df in _abribles(spark, rutas).items()
    ]
    df = _juntar(partes)
    extra = [ORIGEN, ROTA] if con_origen else []
    return df.select(*[c for c in COLUMNAS_PLANAS if c in df.columns], *extra)


def contar_rotas(crudo: DataFrame) -> DataFrame:
    """For each yearly file its rows and how many have too many or too few cells."""
    return crudo.groupBy(F.col(ORIGEN).alias("anio")).agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(ROTA).alias("filas_rotas")
    )


def filas_rotas(spark: SparkSession, rutas: Mapping[int, str]) -> DataFrame:
    return contar_rotas(leer_crudos(spark, rutas, con_origen=True))


def tipar_limpio(df: DataFrame) -> DataFrame:
    """Give a clean table read as text its types; typed columns pass unchanged."""
    tipos = dict(df.dtypes)
    cambios = {}
    for c in ("anio", "ingresado", "atendido", "ubigeo_pjfs", ANIO_DESCARGA):
        if tipos.get(c) == "string":
            n = a_numero(F.col(c))
            cambios[c] = n.try_cast("int") if c == ANIO_DESCARGA else a_entero(n)
    formatos = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "dd/MM/yyyy")
    for c in ("fecha_descarga", "fecha_corte"):
        if tipos.get(c) == "string":
            cambios[c] = a_fecha(F.col(c), formatos).cast("timestamp_ntz")
    return df.withColumns(cambios)


def leer_limpio(spark: SparkSession, ruta: str) -> DataFrame:
    """One clean table: a parquet folder, or CSV when the name says so."""
    if ruta.rstrip("/").endswith((".csv", ".csv.gz")):
        return tipar_limpio(leer_csv(spark, ruta))
    return spark.read.parquet(ruta)


def cargar_limpios(spark: SparkSession, carpeta: str) -> tuple[DataFrame, list[str]]:
    """The consolidated table of a folder, else its yearly clean files; with the files used."""

    def anuales() -> DataFrame:
        # Each file by its own header: the columns need not stand in the same order.
        archivos = sorted(spark.read.text(f"{carpeta}/{PATRON_LIMPIO}").inputFiles())
        return tipar_limpio(_juntar([leer_csv(spark, a) for a in archivos]))

    intentos = (
        lambda: spark.read.parquet(f"{carpeta}/{CONSOLIDADO}"),
        lambda: tipar_limpio(leer_csv(spark, f"{carpeta}/{CONSOLIDADO}.csv")),
        anuales,
    )
    for leer in intentos:
        try:
            df = leer()
        except AnalysisException:
            continue
        return df, sorted(df.inputFiles())
    raise FileNotFoundError(f"no clean table in {carpeta}")
