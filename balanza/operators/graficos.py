"""Aggregates behind the standard charts (drawing is left to the caller)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from balanza.functions.clases import banda, clase_eficiencia_fila
from balanza.operators.descriptiva import evolucion_anual, pct, suma
from balanza.operators.frecuencias import (
    acumular,
    asimetria,
    cuantil_agregado,
    curtosis_exceso,
    momentos,
    std_muestral,
    tabla_larga,
    unir_por_grupo,
)
from balanza.operators.limpieza import limites_iqr
from balanza.sesion import cortar

# Fixed values of the charts.
BARRAS = 50
PUNTOS = 100
TASA_MAXIMA = 3
SOBRE_EFICIENCIA = 1.2
VARIABLES = ("ingresado", "atendido", "tasa_atencion")

_G = ["variable"]


def frecuencias_graficas(pares: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """Frequency table of the charted variables; rates above 3 are left out."""
    freq = tabla_larga(pares, variables, peso="n").filter(F.col("valor").isNotNull())
    recorte = (F.col("variable") != "tasa_atencion") | (F.col("valor") <= TASA_MAXIMA)
    return cortar(freq.filter(recorte))


def histograma(pares: DataFrame, barras: int = BARRAS) -> DataFrame:
    """Equal-width bars per variable, empty ones included, with densities."""
    freq = frecuencias_graficas(pares)
    lim = cortar(
        freq.groupBy(*_G).agg(
            F.min("valor").alias("lo"), F.max("valor").alias("hi"), F.sum("n").alias("total")
        )
    )
    ancho = F.col("hi") - F.col("lo")
    # The last bar is closed on the right.
    barra = F.least(
        F.floor(F.when(ancho > 0, (F.col("valor") - F.col("lo")) * barras / ancho).otherwise(0.0)),
        F.lit(barras - 1),
    ).cast("int")
    conteo = (
        unir_por_grupo(freq, lim, _G, ["lo", "hi"])
        .groupBy(*_G, barra.alias("barra"))
        .agg(F.sum("n").alias("frecuencia"))
    )
    marco = lim.select("*", F.explode(F.sequence(F.lit(0), F.lit(barras - 1))).alias("barra"))
    paso = ancho / barras
    return marco.join(conteo, ["variable", "barra"], "left").select(
        "variable",
        "barra",
        (F.col("lo") + F.col("barra") * paso).alias("desde"),
        (F.col("lo") + (F.col("barra") + 1) * paso).alias("hasta"),
        F.coalesce("frecuencia", F.lit(0)).alias("frecuencia"),
        F.when(paso > 0, F.coalesce("frecuencia", F.lit(0)) / (F.col("total") * paso)).alias(
            "densidad"
        ),
    )


def marcadores(pares: DataFrame) -> DataFrame:
    """Mean and median lines drawn over the histograms."""
    freq = frecuencias_graficas(pares)
    q = acumular(freq, _G).groupBy(*_G).agg(cuantil_agregado(0.5).alias("mediana"))
    m = freq.groupBy(*_G).agg((F.sum(F.col("valor") * F.col("n")) / F.sum("n")).alias("media"))
    return m.join(q, "variable")


def kde(pares: DataFrame, puntos: int = PUNTOS) -> DataFrame:
    """Gaussian density on an even grid, bandwidth by Scott's rule.

    Each distinct value meets the fixed number of grid points once; partial sums are
    combined before the shuffle.
    """
    freq = frecuencias_graficas(pares)
    m = momentos(freq, _G).filter(F.col("conteo") > 1)
    h = std_muestral() * F.pow(F.col("conteo").cast("double"), F.lit(-0.2))
    m = m.withColumn("h", h).filter(F.col("h") > 0)
    con = unir_por_grupo(freq, m, _G, ["minimo", "maximo", "h", "conteo"])
    x = F.col("minimo") + F.col("punto") * (F.col("maximo") - F.col("minimo")) / (puntos - 1)
    u = (F.col("x") - F.col("valor")) / F.col("h")
    return (
        con.select("*", F.explode(F.sequence(F.lit(0), F.lit(puntos - 1))).alias("punto"))
        .withColumn("x", x)
        .groupBy(*_G, "punto", "x", "h", "conteo")
        .agg(F.sum(F.col("n") * F.exp(F.lit(-0.5) * u * u)).alias("s"))
        .select(
            "variable",
            "punto",
            "x",
            (F.col("s") / (F.col("conteo") * F.col("h") * math.sqrt(2 * math.pi))).alias(
                "densidad"
            ),
        )
    )


def _cajas(freq: DataFrame, claves: Sequence[str]) -> DataFrame:
    """Box-plot summary per group of a frequency table."""
    lim = cortar(limites_iqr(freq, claves))
    v, n = F.col("valor"), F.col("n")
    lo, hi = F.col("limite_inferior"), F.col("limite_superior")
    dentro = (v >= lo) & (v <= hi)
    atipicos = F.coalesce(F.sum(F.when(~dentro, n)), F.lit(0))
    cols = ["q1", "mediana", "q3", "limite_inferior", "limite_superior"]
    return (
        unir_por_grupo(freq, lim, claves, cols)
        .groupBy(*claves, "q1", "mediana", "q3")
        .agg(
            F.min(F.when(dentro, v)).alias("bigote_inferior"),
            F.max(F.when(dentro, v)).alias("bigote_superior"),
            atipicos.alias("outliers"),
            pct(atipicos, F.sum(n)).alias("outliers_pct"),
        )
    )


def boxplot(pares: DataFrame) -> DataFrame:
    return _cajas(frecuencias_graficas(pares), _G)


def boxplot_p99(pares: DataFrame) -> DataFrame:
    """Boxes of both measures without the values above their 99th percentile."""
    freq = frecuencias_graficas(pares, ("ingresado", "atendido"))
    p = acumular(freq, _G).groupBy(*_G).agg(cuantil_agregado(0.99).alias("p99"))
    con = unir_por_grupo(freq, p, _G, ["p99"]).filter(F.col("valor") <= F.col("p99"))
    return _cajas(cortar(con.drop("p99")), _G)


def boxplot_anual(df: DataFrame) -> DataFrame:
    """Boxes of both measures per year, as the cleaning report draws them."""
    return _cajas(cortar(tabla_larga(df, ("ingresado", "atendido"), ["anio"])), ["anio", "variable"])


def forma(pares: DataFrame) -> DataFrame:
    """Skewness and kurtosis of the charted variables and the share of rates over 1.2."""
    freq = cortar(tabla_larga(pares, VARIABLES, peso="n").filter(F.col("valor").isNotNull()))
    m = momentos(freq, _G)
    sobre = freq.groupBy(*_G).agg(
        F.coalesce(F.sum(F.when(F.col("valor") > SOBRE_EFICIENCIA, F.col("n"))), F.lit(0)).alias("k")
    )
    es_tasa = F.col("variable") == "tasa_atencion"
    return m.join(sobre, "variable").select(
        "variable",
        asimetria().alias("asimetria"),
        curtosis_exceso().alias("curtosis"),
        F.when(es_tasa, F.col("k")).alias("sobre_eficientes"),
        F.when(es_tasa, pct(F.col("k"), F.col("conteo"))).alias("sobre_eficientes_pct"),
    )


def participacion(df: DataFrame, columna: str) -> DataFrame:
    """Rows and share of rows per value (null is not a value)."""
    g = cortar(df.groupBy(columna).agg(F.count(F.lit(1)).alias("registros")))
    g = g.filter(F.col(columna).isNotNull())
    total = g.agg(F.sum("registros")).scalar()
    return g.withColumn("porcentaje", F.col("registros") / total * 100)


def top_distritos(df: DataFrame, k: int = 15) -> DataFrame:
    return (
        df.filter(F.col("distrito_fiscal").isNotNull())
        .groupBy("distrito_fiscal")
        .agg(suma("ingresado").alias("ingresado"))
        .orderBy(F.desc("ingresado"), "distrito_fiscal")
        .limit(k)
    )


def tasa_departamento(df: DataFrame) -> DataFrame:
    """Ratio of sums per department, ascending, with its band."""
    tasa = F.try_divide(F.col("atendido"), F.col("ingresado"))
    return (
        df.filter(F.col("dpto_pjfs").isNotNull())
        .groupBy("dpto_pjfs")
        .agg(suma("ingresado").alias("ingresado"), suma("atendido").alias("atendido"))
        .withColumn("tasa_atencion", tasa)
        .withColumn("banda", banda(F.col("tasa_atencion"), 0.95))
        .orderBy("tasa_atencion", "dpto_pjfs")
    )


def participacion_departamentos(df: DataFrame, k: int = 10) -> DataFrame:
    """The k largest departments and their shares of the k shown."""
    m = cortar(
        df.filter(F.col("dpto_pjfs").isNotNull())
        .groupBy("dpto_pjfs")
        .agg(suma("ingresado").alias("ingresado"))
        .orderBy(F.desc("ingresado"), "dpto_pjfs")
        .limit(k)
    )
    return m.withColumn("porcentaje", pct(F.col("ingresado"), m.agg(F.sum("ingresado")).scalar()))


def dispersion_distrito(df: DataFrame) -> DataFrame:
    """Points of the volume/rate chart, one per district."""
    tasa = F.try_divide(F.col("atendido"), F.col("ingresado"))
    return (
        df.filter(F.col("distrito_fiscal").isNotNull())
        .groupBy("distrito_fiscal")
        .agg(suma("ingresado").alias("ingresado"), suma("atendido").alias("atendido"))
        .withColumn("tasa_atencion", tasa)
    )


def regresion_distrito(df: DataFrame) -> DataFrame:
    """Line of the district's rate on its volume."""
    p = dispersion_distrito(df)
    y, x = F.col("tasa_atencion"), F.col("ingresado").cast("double")
    return p.agg(
        F.regr_slope(y, x).alias("pendiente"),
        F.regr_intercept(y, x).alias("intercepto"),
        F.corr(y, x).alias("r"),
        F.regr_r2(y, x).alias("r_cuadrado"),
        F.regr_count(y, x).alias("puntos"),
    )


def resumen_geografico(df: DataFrame) -> DataFrame:
    """Share of the five largest districts, gap between departments, volume/rate r."""
    # One pass: both groupings below only need sums of these sums.
    base = cortar(
        df.groupBy("distrito_fiscal", "dpto_pjfs").agg(
            suma("ingresado").alias("ingresado"), suma("atendido").alias("atendido")
        )
    )
    p = cortar(dispersion_distrito(base))
    cinco = p.orderBy(F.desc("ingresado"), "distrito_fiscal").limit(5).agg(F.sum("ingresado"))
    dep = cortar(tasa_departamento(base))
    pos = F.struct("tasa_atencion", "dpto_pjfs")
    extremos = dep.filter(F.col("tasa_atencion").isNotNull()).agg(
        F.struct(
            F.max_by("dpto_pjfs", pos).alias("mas"),
            F.max("tasa_atencion").alias("alta"),
            F.min_by("dpto_pjfs", pos).alias("menos"),
            F.min("tasa_atencion").alias("baja"),
        ).alias("e")
    )
    e = extremos.scalar()
    return p.agg(
        F.sum("ingresado").alias("_t"),
        F.corr(F.col("ingresado").cast("double"), "tasa_atencion").alias("r_volumen_tasa"),
    ).select(
        pct(cinco.scalar(), F.col("_t")).alias("concentracion_top_5"),
        e.getField("mas").alias("departamento_mas_eficiente"),
        e.getField("menos").alias("departamento_menos_eficiente"),
        (e.getField("alta") - e.getField("baja")).alias("brecha_eficiencia"),
        "r_volumen_tasa",
    )


def pivot_anio_materia(df: DataFrame, materias: Sequence[str] | None = None) -> DataFrame:
    """Filed cases by year (rows) and subject (columns), zeros filled in.

    The rows are summed by year and subject in one pass and the sums are cut.  Without
    ``materias`` Spark looks the subjects up among these; it refuses more of them than
    ``spark.sql.pivotMaxValues``.
    """
    sumas = cortar(df.groupBy("anio", "materia").agg(suma("ingresado").alias("_s")))
    g = sumas.groupBy("anio").pivot("materia", list(materias) if materias else None)
    return g.agg(F.sum("_s")).na.fill(0)


def variacion_anual(df: DataFrame) -> DataFrame:
    """Percent change of both measures against the previous year on record."""
    anual = df.groupBy("anio").agg(
        suma("ingresado").alias("ingresado"), suma("atendido").alias("atendido")
    )
    # One row per year.
    w = Window.orderBy("anio")

    def cambio(c: str) -> Column:
        previo = F.lag(c).over(w)
        return F.try_divide(F.col(c) - previo, previo) * 100

    return (
        anual.select(
            "anio",
            cambio("ingresado").alias("ingresado_pct"),
            cambio("atendido").alias("atendido_pct"),
            F.row_number().over(w).alias("_i"),
        )
        .filter(F.col("_i") > 1)
        .drop("_i")
    )


def resumen_periodo(df: DataFrame) -> DataFrame:
    """Growth, change of rate and sample coefficient of variation over the period."""
    return evolucion_anual(df).agg(
        (
            F.try_divide(
                F.max_by("ingresado", "anio") - F.min_by("ingresado", "anio"),
                F.min_by("ingresado", "anio"),
            )
            * 100
        ).alias("crecimiento_total"),
        (F.max_by("tasa_global", "anio") - F.min_by("tasa_global", "anio")).alias(
            "cambio_eficiencia"
        ),
        (F.stddev_samp("ingresado") / F.avg("ingresado")).alias("cv_temporal"),
    )


def categorias_eficiencia(pares: DataFrame) -> DataFrame:
    """Rows per efficiency bin; a rate of 0 belongs to no bin."""
    clase = clase_eficiencia_fila(F.col("tasa_atencion"))
    g = cortar(
        pares.withColumn("categoria", clase)
        .filter(F.col("categoria").isNotNull())
        .groupBy("categoria")
        .agg(F.sum("n").alias("registros"))
    )
    return g.withColumn("porcentaje", pct(F.col("registros"), g.agg(F.sum("registros")).scalar()))


def eficiencia_materia(df: DataFrame) -> DataFrame:
    """Efficiency by subject with its band and marks on the best and the worst."""
    g = cortar(
        df.filter(F.col("materia").isNotNull())
        .groupBy("materia")
        .agg(
            suma("ingresado").alias("ing_total"),
            suma("atendido").alias("at_total"),
            F.avg("tasa_atencion").alias("ef_media"),
            F.stddev_samp("tasa_atencion").alias("ef_std"),
            F.count("tasa_atencion").alias("registros"),
        )
        .withColumn("ef_calculada", F.try_divide(F.col("at_total"), F.col("ing_total")))
    )
    c = F.col("ef_calculada")
    e = (
        g.filter(c.isNotNull())
        .agg(
            F.struct(
                F.min_by("materia", F.struct(-c, "materia")).alias("mas"),
                F.min_by("materia", F.struct(c, "materia")).alias("menos"),
            ).alias("e")
        )
        .scalar()
    )
    return g.withColumns(
        {
            "banda": banda(c, 1.0),
            "es_maxima": F.col("materia") == e.getField("mas"),
            "es_minima": F.col("materia") == e.getField("menos"),
        }
    ).orderBy("ef_calculada", "materia")


def barras_tipo_fiscalia(df: DataFrame) -> DataFrame:
    """Ratio of sums by office type with the spread of the row rates."""
    return (
        df.filter(F.col("tipo_fiscalia").isNotNull())
        .groupBy("tipo_fiscalia")
        .agg(
            F.try_divide(suma("atendido"), suma("ingresado")).alias("tasa_atencion"),
            F.stddev_samp("tasa_atencion").alias("error_std"),
        )
    )


def regresion_registros(pares: DataFrame) -> DataFrame:
    """Line of the row rate on the row volume, over all rows."""
    validos = pares.filter(F.col("tasa_atencion").isNotNull())
    n = F.col("n").cast("double")
    c = validos.agg(
        F.struct(
            (F.sum(F.col("ingresado") * n) / F.sum(n)).alias("x"),
            (F.sum(F.col("tasa_atencion") * n) / F.sum(n)).alias("y"),
        ).alias("c")
    ).scalar()
    x = F.col("ingresado") - c.getField("x")
    y = F.col("tasa_atencion") - c.getField("y")
    s = validos.agg(
        F.sum("n").alias("puntos"),
        F.max(c.getField("x")).alias("mx"),
        F.max(c.getField("y")).alias("my"),
        F.sum(n * x * x).alias("xx"),
        F.sum(n * y * y).alias("yy"),
        F.sum(n * x * y).alias("xy"),
        F.max("ingresado").alias("x_max"),
    )
    pendiente = F.when(F.col("xx") > 0, F.col("xy") / F.col("xx"))
    r = F.when(
        (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    )
    return s.select(
        "puntos",
        pendiente.alias("pendiente"),
        (F.col("my") - pendiente * F.col("mx")).alias("intercepto"),
        r.alias("r"),
        (r * r).alias("r_cuadrado"),
        F.col("x_max").cast("double").alias("x_max"),
    )


def recta_registros(pares: DataFrame, puntos: int = PUNTOS) -> DataFrame:
    """The fitted line on an even grid from 0 to the largest volume."""
    r = regresion_registros(pares)
    return r.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(puntos - 1))).alias("punto")
    ).select(
        "punto",
        (F.col("punto") * F.col("x_max") / (puntos - 1)).alias("x"),
        (
            F.col("pendiente") * (F.col("punto") * F.col("x_max") / (puntos - 1))
            + F.col("intercepto")
        ).alias("y"),
    )


def rejilla(pares: DataFrame, x: str, y: str, celdas: int, *claves: str) -> DataFrame:
    """Rows counted on a grid of ``celdas`` by ``celdas`` cells between the extremes of both columns."""
    lim = cortar(
        pares.agg(
            F.struct(
                F.min(x).cast("double").alias("x0"),
                F.max(x).cast("double").alias("x1"),
                F.min(y).cast("double").alias("y0"),
                F.max(y).cast("double").alias("y1"),
            ).alias("l")
        )
    ).scalar()

    def celda(c: str, lo: str, hi: str) -> Column:
        a, b = lim.getField(lo), lim.getField(hi)
        pos = F.when(b > a, (F.col(c) - a) * celdas / (b - a)).otherwise(0.0)
        return F.least(F.floor(pos), F.lit(celdas - 1)).cast("int")

    return pares.groupBy(*claves, celda(x, "x0", "x1").alias("celda_x"), celda(y, "y0", "y1").alias("celda_y")).agg(
        F.sum("n").alias("registros")
    )


def dispersion_registros(pares: DataFrame, celdas: int = BARRAS) -> DataFrame:
    """Volume/rate scatter as counts on a grid of cells."""
    return rejilla(pares.filter(F.col("tasa_atencion").isNotNull()), "ingresado", "tasa_atencion", celdas)
