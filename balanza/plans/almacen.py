"""Warehouse plan: dimension analyses, star schema on disk, published views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.operators import bi, calidad, dimensiones, estrella
from balanza.sesion import cortar_varios
from balanza.sinks import salidas
from balanza.sources import referencia


def analizar_dimensiones(df: DataFrame) -> dict[str, DataFrame]:
    """The eight dimension analyses and their class counts, from one pass over the rows."""
    dim = dimensiones
    g = dim.compactar(df)
    tipos_caso = dim.dim_tipos_caso(g["tipo_caso"])
    fiscalias = dim.dim_fiscalias_especializadas(g["especializada"])
    especialidades = dim.dim_especialidades(g["especialidad"])
    ubicaciones = dim.dim_ubicaciones(g["lugar"]).drop("registros")
    distritos = dim.dim_distritos(g["lugar"])
    return {
        "tipos_caso": tipos_caso,
        "tipos_caso_por_categoria": dim.conteo_por_clase(tipos_caso, "categoria"),
        "tipos_caso_frecuentes": dim.mas_frecuentes(tipos_caso, "tipo_caso"),
        "fiscalias_especializadas": fiscalias,
        "fiscalias_por_area": dim.conteo_por_clase(fiscalias, "area_especializacion"),
        "materias": dim.dim_materias(g["especialidad"]),
        "especialidades": especialidades,
        "especialidades_por_materia": dim.conteo_por_clase(especialidades, "materia_asociada"),
        "ubicaciones": ubicaciones,
        "ubicaciones_por_region": dim.conteo_por_clase(ubicaciones, "region_geografica"),
        "distritos_fiscales": distritos,
        "distritos_por_departamento": dim.distritos_por_departamento(distritos),
        "tipos_fiscalia": dim.dim_tipos_fiscalia(g["tipo_fiscalia"]),
        "tiempo": dim.dim_tiempo(g["tiempo"]),
    }


def guardar_dimensiones(analisis: dict[str, DataFrame], carpeta: str) -> None:
    for nombre, df in analisis.items():
        salidas.escribir_json(df, f"{carpeta}/{nombre}")


def cargar_almacen(
    df: DataFrame,
    base: str,
    region: Column | None = None,
    sentinela_a_nulo: bool = True,
    publicadas: bool = False,
) -> DataFrame:
    """Build and write the star schema of a clean table; return the wide view over it.

    With ``publicadas`` the dimension tables begin with the published rows.
    """
    previas = referencia.dimensiones_publicadas(df.sparkSession) if publicadas else None
    dims = estrella.construir_dimensiones(df, region, previas=previas)
    hechos = estrella.construir_hechos(df, dims, sentinela_a_nulo)
    salidas.escribir_estrella(dims, hechos, base)
    return abrir_almacen(df.sparkSession, base)


def agregar_anios(
    df: DataFrame,
    base: str,
    region: Column | None = None,
    sentinela_a_nulo: bool = True,
) -> DataFrame:
    """Load the years of ``df`` into a written star schema; return the wide view over it.

    Keys given before stay; values not met before get the keys after them.  The facts of
    the years in ``df`` are replaced, all others stay, so loading a year twice is the
    same as loading it once.
    """
    spark = df.sparkSession
    claves = {t: id_col for t, (id_col, _) in estrella.CLAVES.items()}
    previas, _ = salidas.leer_estrella(spark, base, list(claves))
    previas = cortar_varios({t: d.drop("created_at") for t, d in previas.items()})
    dims = estrella.construir_dimensiones(df, region, previas=previas)
    hechos = estrella.construir_hechos(df, dims, sentinela_a_nulo)
    salidas.agregar_estrella(dims, previas, claves, hechos, base)
    return abrir_almacen(spark, base)


def abrir_almacen(spark: SparkSession, base: str) -> DataFrame:
    """Wide view over a written star schema."""
    dims, hechos = salidas.leer_estrella(spark, base, list(estrella.CLAVES))
    return estrella.vista_casos_completo(dims, hechos)


def revisar_almacen(spark: SparkSession, base: str) -> DataFrame:
    """Constraint violations of a written star schema."""
    return calidad.violaciones(*salidas.leer_estrella(spark, base, list(estrella.CLAVES)))


# Names under which the views are published.
VISTA = "v_casos_fiscales_completo"
VISTAS_BI = {
    "v_resumen_ejecutivo": bi.resumen_ejecutivo,
    "v_performance_distrito": partial(bi.performance_distrito, vivo=True),
    "v_analisis_materia": partial(bi.analisis_materia, vivo=True),
    "v_top_performers": partial(bi.top_performers, vivo=True),
    "v_evolucion_temporal": bi.evolucion_temporal,
    "v_fiscalias_especializadas": partial(bi.fiscalias_especializadas, vivo=True),
    "v_metricas_regionales": bi.metricas_regionales,
}

# Rates have four digits, so the inner window ranks a bounded number of values.
_FUNCION = f"""
CREATE OR REPLACE TEMPORARY FUNCTION calcular_percentil_eficiencia(
  p_anio INT DEFAULT NULL, p_materia STRING DEFAULT NULL)
RETURNS TABLE(distrito_fiscal STRING, tasa_atencion DECIMAL(5,4), percentil INT)
RETURN
  WITH sumas AS (
    SELECT distrito_fiscal, CAST(SUM(casos_ingresados) AS DECIMAL(38,0)) AS ing,
      CAST(SUM(casos_atendidos) AS DECIMAL(38,0)) AS ate
    FROM {VISTA}
    WHERE (p_anio IS NULL OR anio = p_anio) AND (p_materia IS NULL OR materia = p_materia)
    GROUP BY distrito_fiscal
    HAVING SUM(casos_ingresados) > 0),
  datos AS (
    SELECT distrito_fiscal,
      CAST((20000 * ate + ing) div (2 * ing) / 10000.0D AS DECIMAL(5,4)) AS tasa FROM sumas),
  tasas AS (SELECT tasa, COUNT(*) AS n FROM datos GROUP BY tasa),
  orden AS (
    SELECT tasa, SUM(n) OVER (ORDER BY tasa) - n AS previos, SUM(n) OVER () AS total FROM tasas)
  SELECT d.distrito_fiscal, d.tasa,
    CAST(rint(100 * CASE WHEN total > 1 THEN previos / (total - 1) ELSE 0 END) AS INT)
  FROM datos d JOIN orden o ON d.tasa = o.tasa
"""


# Views whose ranks or shares need whole groups: with a folder they are tables, and the year each row belongs to.
TABLAS_BI = {
    "v_performance_distrito": (bi.performance_distrito, "anio"),
    "v_analisis_materia": (bi.analisis_materia, "anio"),
    "v_fiscalias_especializadas": (bi.fiscalias_especializadas, "anio"),
    "v_top_performers": (bi.top_performers, None),
}


def _escribir_tablas(vista: DataFrame, base: str, anios: Sequence[int] | None) -> None:
    """Ranks and shares of the given years (of all without ``anios``), by range partitions; a table over all years is written whole."""
    propias = vista if anios is None else vista.filter(F.col("anio").isin(*anios))
    for nombre, (f, clave) in TABLAS_BI.items():
        df = f(propias if clave else vista)
        escritor = df.write.mode("overwrite")
        if clave:
            escritor = escritor.partitionBy(clave)
            if anios is not None:
                escritor = escritor.option("partitionOverwriteMode", "dynamic")
        escritor.parquet(f"{base}/vistas/{nombre}")


def publicar_vistas(vista: DataFrame, base: str | None = None) -> None:
    """Register the wide view, the seven report views and the percentile table function.

    Without ``base`` all are pure plans over the written tables; ranks and shares are
    then plain windows, one task for a group of the aggregate.  With the folder of the
    star schema, the views that need whole groups are tables below it, ranked by range
    partitions.  After the tables were written again, ``refrescar_vistas`` makes the
    views follow.
    """
    spark = vista.sparkSession
    vista.createOrReplaceTempView(VISTA)
    if base is not None:
        _escribir_tablas(vista, base, None)
    for nombre, f in VISTAS_BI.items():
        if base is not None and nombre in TABLAS_BI:
            orden = f(vista).columns
            spark.read.parquet(f"{base}/vistas/{nombre}").select(*orden).createOrReplaceTempView(nombre)
        else:
            f(vista).createOrReplaceTempView(nombre)
    spark.sql(_FUNCION)


def refrescar_vistas(spark: SparkSession, base: str | None = None, anios: Sequence[int] | None = None) -> None:
    """Let the published views see tables that were written after they were published.

    With ``base`` the tables of ``publicar_vistas`` are renewed, for ``anios`` only where
    a row belongs to one year.
    """
    spark.catalog.refreshTable(VISTA)
    if base is not None:
        _escribir_tablas(abrir_almacen(spark, base), base, anios)
    for nombre in VISTAS_BI:
        spark.catalog.refreshTable(nombre)
