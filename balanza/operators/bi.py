"""Business questions over the wide view.

Each function takes the wide view (or just the columns it needs) and returns one
aggregate.  Rounded ratios use exact integer arithmetic on the aggregated rows.
The number of places may grow with the data, so ranks over places come from range
partitions: see ``rangos_densos``.  With ``vivo`` a function returns a pure plan, which
a view needs to follow its tables; ranks and group totals are then plain windows over
the aggregate, with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from balanza.functions.clases import clase_eficiencia, clase_volumen, clase_volumen_total
from balanza.functions.redondeo import porcentaje, promedio, razon, variacion
from balanza.operators.frecuencias import acumular, rangos_densos, tabla, unir_por_grupo
from balanza.sesion import cortar

# Fixed values of the reports.
VOLUMEN_MINIMO = 500
NO_ESPECIALIZADA = "NO ESPECIALIZADA"
AREA_GENERAL = "GENERAL"

_ING, _AT, _PEN, _TASA = (
    "casos_ingresados",
    "casos_atendidos",
    "casos_pendientes",
    "tasa_atencion",
)


def _suma(c: str) -> Column:
    return F.sum(F.col(c).cast("long"))


def _tasa_e4(c: str = _TASA) -> Column:
    """The four-digit rate as an integer number of ten-thousandths."""
    return (F.col(c) * 10000).cast("long")


def _cuenta_si(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _dividir(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _con_total(base: DataFrame, claves: list[str], vivo: bool) -> DataFrame:
    """Attach the filed cases of the whole group; only a view gathers a group's aggregates in one task."""
    if vivo:
        total = F.sum("casos_ingresados").over(Window.partitionBy(*claves))
        return base.withColumn("_total", total)
    base = cortar(base)
    totales = base.groupBy(*claves).agg(F.sum("casos_ingresados").alias("_total"))
    return unir_por_grupo(base, totales, claves, ["_total"])


def _por_distrito(vista: DataFrame) -> DataFrame:
    """The rows, those of a district side by side: a task then counts the values of its own districts only.

    Without this every task that a lookup leaves rows in any order holds the groups of all
    districts, nearly one for each of its rows.  The hint lets Spark split a large district.
    """
    return vista.hint("rebalance", "distrito_fiscal")


def resumen_ejecutivo(vista: DataFrame) -> DataFrame:
    """Yearly summary."""
    efic, vol = clase_eficiencia(F.col(_TASA)), clase_volumen(F.col(_ING))
    return (
        vista.groupBy("anio")
        .agg(
            F.count(F.lit(1)).alias("total_registros"),
            _suma(_ING).alias("total_ingresados"),
            _suma(_AT).alias("total_atendidos"),
            _suma(_PEN).alias("total_pendientes"),
            promedio(F.sum(_tasa_e4()), F.count(_TASA) * 10000, 4).alias("tasa_atencion_promedio"),
            F.round(F.stddev_samp(F.col(_TASA).cast("double")), 4).alias(
                "desviacion_tasa_atencion"
            ),
            F.countDistinct("distrito_fiscal").alias("distritos_activos"),
            F.countDistinct("materia").alias("materias_activas"),
            _cuenta_si(efic == "Excelente").alias("registros_excelentes"),
            _cuenta_si(efic == "Deficiente").alias("registros_deficientes"),
            _cuenta_si(vol == "Muy Alto").alias("registros_volumen_muy_alto"),
            _cuenta_si(vol == "Alto").alias("registros_volumen_alto"),
        )
        .orderBy("anio")
    )


def performance_distrito(vista: DataFrame, vivo: bool = False) -> DataFrame:
    """District by year, with two dense ranks inside the year."""
    base = _por_distrito(vista).groupBy("distrito_fiscal", "departamento", "region_geografica", "anio").agg(
        _suma(_ING).alias("total_ingresados"),
        _suma(_AT).alias("total_atendidos"),
        _suma(_PEN).alias("total_pendientes"),
        F.count(F.lit(1)).alias("registros_distrito"),
        F.countDistinct("materia").alias("materias_manejadas"),
        F.countDistinct("tipo_fiscalia").alias("tipos_fiscalia_activos"),
    )
    base = base.withColumn("_razon", _dividir("total_atendidos", "total_ingresados"))
    r = rangos_densos(
        base,
        {"ranking_volumen": ("total_ingresados", True), "ranking_eficiencia": ("_razon", True)},
        ["anio"],
        vivo,
    )
    return r.select(
        "distrito_fiscal",
        "departamento",
        "region_geografica",
        "anio",
        "total_ingresados",
        "total_atendidos",
        "total_pendientes",
        razon(F.col("total_atendidos"), F.col("total_ingresados")).alias("tasa_atencion_distrito"),
        "registros_distrito",
        "materias_manejadas",
        "tipos_fiscalia_activos",
        "ranking_volumen",
        "ranking_eficiencia",
    ).orderBy(F.desc("anio"), F.desc("tasa_atencion_distrito"), "distrito_fiscal")


def analisis_materia(vista: DataFrame, vivo: bool = False) -> DataFrame:
    """Subject and speciality by year, with the share of the year."""
    base = vista.groupBy("materia", "especialidad", "anio").agg(
        _suma(_ING).alias("casos_ingresados"),
        _suma(_AT).alias("casos_atendidos"),
        _suma(_PEN).alias("casos_pendientes"),
        promedio(_suma(_ING), F.count(_ING), 2).alias("promedio_ingresados_por_registro"),
        F.round(F.stddev_samp(_ING), 2).alias("desviacion_ingresados"),
        F.max(_ING).alias("max_ingresados_por_registro"),
        F.min(_ING).alias("min_ingresados_por_registro"),
        F.count(F.lit(1)).alias("registros"),
        F.countDistinct("distrito_fiscal").alias("distritos_con_materia"),
    )
    return (
        _con_total(base, ["anio"], vivo)
        .withColumns(
            {
                "tasa_atencion": razon(F.col("casos_atendidos"), F.col("casos_ingresados")),
                "porcentaje_casos_del_año": porcentaje(F.col("casos_ingresados"), F.col("_total")),
            }
        )
        .drop("_total")
    ).orderBy(F.desc("anio"), F.desc("casos_ingresados"), "especialidad")


def top_performers(
    vista: DataFrame, minimo: int = VOLUMEN_MINIMO, vivo: bool = False
) -> DataFrame:
    """Districts over all years with enough volume, ranked three ways."""
    base = (
        _por_distrito(vista)
        .groupBy("distrito_fiscal", "departamento", "region_geografica")
        .agg(
            _suma(_ING).alias("total_ingresados"),
            _suma(_AT).alias("total_atendidos"),
            _suma(_PEN).alias("total_pendientes"),
            F.countDistinct("anio").alias("años_activos"),
            F.round(F.stddev_samp(F.col(_TASA).cast("double")), 4).alias("consistencia_tasa"),
            F.countDistinct("materia").alias("materias_manejadas"),
            F.countDistinct("especialidad").alias("especialidades_manejadas"),
            F.count(F.lit(1)).alias("total_registros"),
        )
        .filter(F.col("total_ingresados") >= minimo)
        .withColumn("tasa_atencion", razon(F.col("total_atendidos"), F.col("total_ingresados")))
    )
    r = rangos_densos(
        base,
        {
            "ranking_eficiencia": ("tasa_atencion", True),
            "ranking_volumen": ("total_ingresados", True),
            "ranking_consistencia": ("consistencia_tasa", False),
        },
        vivo=vivo,
    )
    return r.withColumns(
        {
            "clasificacion_eficiencia": clase_eficiencia(F.col("tasa_atencion")),
            "clasificacion_volumen": clase_volumen_total(F.col("total_ingresados")),
        }
    ).orderBy(F.desc("tasa_atencion"), "distrito_fiscal")


def evolucion_temporal(vista: DataFrame) -> DataFrame:
    """Year by subject and department against the previous year on record."""
    base = _por_distrito(vista).groupBy("anio", "materia", "departamento").agg(
        _suma(_ING).alias("ingresados"),
        _suma(_AT).alias("atendidos"),
        _suma(_PEN).alias("pendientes"),
        F.countDistinct("distrito_fiscal").alias("distritos_reportando"),
        F.count(F.lit(1)).alias("registros"),
    )
    previo = F.lag("ingresados").over(Window.partitionBy("materia", "departamento").orderBy("anio"))
    return (
        base.withColumn("ingresados_año_anterior", previo)
        .withColumns(
            {
                "tasa_atencion": razon(F.col("atendidos"), F.col("ingresados")),
                "variacion_porcentual_ingresados": variacion(
                    F.col("ingresados"), F.col("ingresados_año_anterior")
                ),
            }
        )
        .orderBy("anio", "materia", "departamento")
    )


def fiscalias_especializadas(vista: DataFrame, vivo: bool = False) -> DataFrame:
    """Specialised offices and areas by year and subject, with the share of the subject."""
    base = _por_distrito(vista).groupBy(
        F.coalesce("fiscalia_especializada", F.lit(NO_ESPECIALIZADA)).alias(
            "tipo_fiscalia_especializada"
        ),
        F.coalesce("area_especializacion", F.lit(AREA_GENERAL)).alias("area"),
        "anio",
        "materia",
    ).agg(
        _suma(_ING).alias("casos_ingresados"),
        _suma(_AT).alias("casos_atendidos"),
        F.count(F.lit(1)).alias("registros"),
        F.countDistinct("distrito_fiscal").alias("distritos"),
    )
    return (
        _con_total(base, ["anio", "materia"], vivo)
        .withColumns(
            {
                "porcentaje_casos_materia": porcentaje(F.col("casos_ingresados"), F.col("_total")),
                "tasa_atencion": razon(F.col("casos_atendidos"), F.col("casos_ingresados")),
            }
        )
        .drop("_total")
    ).orderBy(F.desc("anio"), F.desc("casos_ingresados"), "tipo_fiscalia_especializada")


def metricas_regionales(vista: DataFrame) -> DataFrame:
    """Region and department by year."""
    especializado = F.count("fiscalia_especializada")
    filas = F.count(F.lit(1))
    return (
        vista.filter(F.col("region_geografica").isNotNull())
        .groupBy("region_geografica", "departamento", "anio")
        .agg(
            _suma(_ING).alias("total_ingresados"),
            _suma(_AT).alias("total_atendidos"),
            F.countDistinct("distrito_fiscal").alias("distritos_region"),
            filas.alias("registros_region"),
            promedio(_suma(_ING), F.count(_ING), 2).alias("promedio_ingresados_por_registro"),
            promedio(F.sum(_tasa_e4()), F.count(_TASA) * 10000, 4).alias("tasa_atencion_promedio"),
            F.countDistinct("materia").alias("materias_activas"),
            especializado.alias("registros_especializados"),
            (filas - especializado).alias("registros_generales"),
            porcentaje(especializado, filas).alias("porcentaje_especializacion"),
        )
        .orderBy(F.desc("anio"), F.desc("total_ingresados"), "departamento")
    )


def calcular_percentil_eficiencia(
    vista: DataFrame, p_anio: int | None = None, p_materia: str | None = None
) -> DataFrame:
    """Percentile (0-100) of each district by rate; both filters are optional."""
    df = vista
    if p_anio is not None:
        df = df.filter(F.col("anio") == p_anio)
    if p_materia is not None:
        df = df.filter(F.col("materia") == p_materia)
    datos = cortar(
        df.groupBy("distrito_fiscal")
        .agg(_suma(_ING).alias("_ing"), _suma(_AT).alias("_at"))
        .filter(F.col("_ing") > 0)
        .select("distrito_fiscal", razon(F.col("_at"), F.col("_ing")).alias("tasa_atencion"))
    )
    acc = acumular(tabla(datos, ["tasa_atencion"]), valor="tasa_atencion")
    # percent_rank = rows below / (rows - 1); 0 for a single row.
    rango = F.when(F.col("total") > 1, F.col("previos") / (F.col("total") - 1)).otherwise(0.0)
    pos = acc.select("tasa_atencion", F.rint(rango * 100).cast("int").alias("percentil"))
    return (
        datos.join(pos, "tasa_atencion")
        .select("distrito_fiscal", "tasa_atencion", "percentil")
        .orderBy(F.desc("tasa_atencion"), "distrito_fiscal")
    )
