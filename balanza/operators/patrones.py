"""Patterns and biases: concentration, disparities, atypical years, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.functions.redondeo import tres_decimales
from balanza.operators.descriptiva import pct, serie_anual_larga, suma, tendencia
from balanza.operators.frecuencias import acumular, cuantil_agregado, gini_agregado, tabla
from balanza.sesion import cortar

# Fixed values of the rules.
FRACCION_BAJO_VOLUMEN = 0.1
DESVIACIONES_ANIO = 2
UMBRAL_DOMINANCIA = 40
EXCESO_ANOMALO = 1.5


def lista_mayores(df: DataFrame, clave: str, valor: str, k: int) -> DataFrame:
    """One row with the k largest values as text ``key: value; ...`` and their sum."""
    mayores = df.orderBy(F.desc(valor), clave).limit(k)
    # k rows at most are collected into the list.
    orden = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col(valor)).alias("o"),
                F.col(clave).alias("c"),
                F.concat_ws(": ", clave, F.col(valor).cast("string")).alias("t"),
            )
        )
    )
    return mayores.agg(
        F.array_join(F.transform(orden, lambda x: x["t"]), "; ").alias("lista"),
        F.sum(valor).alias("suma"),
    )


def concentracion_departamental(df: DataFrame, k: int = 3) -> DataFrame:
    """Largest departments, their share, Gini and the count of very small ones."""
    dep = cortar(
        df.filter(F.col("dpto_pjfs").isNotNull())
        .groupBy("dpto_pjfs")
        .agg(suma("ingresado").alias("total"))
    )
    mayores = cortar(lista_mayores(dep, "dpto_pjfs", "total", k))
    freq = tabla(dep.withColumnRenamed("total", "valor"), ["valor"])
    medidas = cortar(
        acumular(freq).agg(gini_agregado().alias("g"), cuantil_agregado(0.5).alias("m"))
    )
    limite = medidas.select("m").scalar() * FRACCION_BAJO_VOLUMEN
    return dep.agg(
        F.sum("total").alias("_t"), F.count_if(F.col("total") < limite).alias("_bajos")
    ).select(
        mayores.select("lista").scalar().alias("top_3_departamentos"),
        pct(mayores.select("suma").scalar(), F.col("_t")).alias("concentracion_top_3"),
        medidas.select("g").scalar().alias("coeficiente_gini"),
        F.col("_bajos").alias("departamentos_bajo_volumen"),
    )


def _extremos(df: DataFrame, clave: str, orden: str, valor: str) -> tuple[Column, ...]:
    """(name, value) of the first and last row by ``orden`` descending, then name."""
    # The first row has the smallest (missing, -order, name), the last row the largest.
    pos = F.struct(F.col(orden).isNull(), -F.col(orden), F.col(clave))
    return (
        F.min_by(clave, pos),
        F.min_by(valor, pos),
        F.max_by(clave, pos),
        F.max_by(valor, pos),
    )


def disparidad_departamental(df: DataFrame) -> DataFrame:
    """Departments ordered by mean row rate; the reported rates are ratios of sums."""
    dep = (
        df.filter(F.col("dpto_pjfs").isNotNull())
        .groupBy("dpto_pjfs")
        .agg(
            F.avg("tasa_atencion").alias("_media"),
            F.try_divide(suma("atendido"), suma("ingresado")).alias("_tasa"),
        )
    )
    return comparar_extremos(dep)


def comparar_extremos(dep: DataFrame) -> DataFrame:
    """First and last department of (dpto_pjfs, _media, _tasa) by the mean, with their rates and the gap."""
    mas, alta, menos, baja = _extremos(dep, "dpto_pjfs", "_media", "_tasa")
    return dep.agg(
        mas.alias("departamento_mas_eficiente"),
        alta.alias("tasa_mas_alta"),
        menos.alias("departamento_menos_eficiente"),
        baja.alias("tasa_mas_baja"),
        (alta - baja).alias("brecha_eficiencia"),
    )


def anios_atipicos(df: DataFrame) -> DataFrame:
    """Every year with its deviation in population standard deviations and a flag."""
    anual = cortar(df.groupBy("anio").agg(suma("ingresado").alias("casos")))
    s = anual.agg(
        F.struct(F.avg("casos").alias("m"), F.stddev_pop("casos").alias("s")).alias("e")
    ).scalar()
    m, std = s.getField("m"), s.getField("s")
    z = F.when(std > 0, (F.col("casos") - m) / std)
    return anual.select(
        "anio",
        "casos",
        z.alias("desviacion_estandar"),
        F.when(F.col("casos") > m, "Alto").otherwise("Bajo").alias("tipo"),
        (F.abs(F.col("casos") - m) > DESVIACIONES_ANIO * std).alias("es_atipico"),
    )


def sesgo_temporal(df: DataFrame) -> DataFrame:
    """Population coefficient of variation of the yearly totals and their trend."""
    serie = serie_anual_larga(df, ["ingresado"])
    cv = serie.groupBy("variable").agg(
        (F.stddev_pop("valor") / F.avg("valor")).alias("coeficiente_variacion_temporal"),
        F.count_distinct("anio").alias("anios"),
    )
    t = tendencia(serie, ["variable"], "posicion", "valor").drop("intercepto", "puntos")
    return t.join(cv, "variable").filter(F.col("anios") > 1).drop("anios")


def estadisticas_anuales(df: DataFrame) -> DataFrame:
    """Sum, mean and standard deviation of both measures and mean rate, per year."""
    partes = []
    for c in ("ingresado", "atendido"):
        partes += [
            suma(c).alias(f"{c}_sum"),
            tres_decimales(F.avg(c)).alias(f"{c}_mean"),
            tres_decimales(F.stddev_samp(c)).alias(f"{c}_std"),
        ]
    return df.groupBy("anio").agg(
        *partes, tres_decimales(F.avg("tasa_atencion")).alias("tasa_atencion_mean")
    )


def _por_materia(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("materia").isNotNull())
        .groupBy("materia")
        .agg(
            suma("ingresado").alias("casos_totales"),
            F.count("ingresado").alias("registros"),
            suma("atendido").alias("atendidos"),
            tres_decimales(F.avg("tasa_atencion")).alias("eficiencia_promedio"),
        )
    )


def dominancia_materia(df: DataFrame) -> DataFrame:
    """Subject with the largest share, and the efficiency gap between subjects."""
    m = _por_materia(df)
    mas, alta, menos, baja = _extremos(m, "materia", "eficiencia_promedio", "eficiencia_promedio")
    lider = F.struct(-F.col("casos_totales"), F.col("materia"))
    g = m.agg(
        F.min_by("materia", lider).alias("materia_dominante"),
        pct(F.max("casos_totales"), F.sum("casos_totales")).alias("participacion"),
        mas.alias("materia_mas_eficiente"),
        alta.alias("eficiencia_maxima"),
        menos.alias("materia_menos_eficiente"),
        baja.alias("eficiencia_minima"),
        (alta - baja).alias("brecha_eficiencia"),
    )
    return g.withColumn("es_dominante", F.col("participacion") > UMBRAL_DOMINANCIA)


def eficiencia_tipo_fiscalia(df: DataFrame) -> DataFrame:
    """Sums, mean, spread and ratio of sums by office type, three decimals."""
    return (
        df.filter(F.col("tipo_fiscalia").isNotNull())
        .groupBy("tipo_fiscalia")
        .agg(
            suma("ingresado").alias("ing_total"),
            suma("atendido").alias("at_total"),
            tres_decimales(F.avg("tasa_atencion")).alias("ef_promedio"),
            tres_decimales(F.stddev_samp("tasa_atencion")).alias("ef_std"),
            F.count("tasa_atencion").alias("registros"),
            tres_decimales(F.try_divide(suma("atendido"), suma("ingresado"))).alias("ef_calculada"),
        )
    )


def efecto_especializacion(df: DataFrame) -> DataFrame:
    """Mean rate with and without a speciality."""
    t, con = F.col("tasa_atencion"), F.col("tiene_especializacion")
    g = df.agg(
        F.avg(F.when(con == 1, t)).alias("eficiencia_con_especializacion"),
        F.avg(F.when(con == 0, t)).alias("eficiencia_sin_especializacion"),
    )
    a, b = F.col("eficiencia_con_especializacion"), F.col("eficiencia_sin_especializacion")
    return g.select(
        "*", (a - b).alias("diferencia"), (a > b).alias("especializacion_mejora_eficiencia")
    )


def marca_sobre_atencion(factor: float) -> Column:
    return F.col("atendido") > F.col("ingresado") * factor


def marca_sin_atencion() -> Column:
    return (F.col("ingresado") > 0) & (F.col("atendido") == 0)


def filas_anomalas(df: DataFrame) -> DataFrame:
    """The anomalous rows themselves, with both marks."""
    sobre, sin = marca_sobre_atencion(EXCESO_ANOMALO), marca_sin_atencion()
    return df.withColumns(
        {"sobre_atencion_extrema": sobre, "sin_atencion_con_casos": sin}
    ).filter(sobre | sin)


def anomalias(pares: DataFrame) -> DataFrame:
    """Number and share of anomalous rows, by kind."""
    n = F.col("n")

    def contar(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    sobre, sin = marca_sobre_atencion(EXCESO_ANOMALO), marca_sin_atencion()
    return pares.agg(
        contar(sobre | sin).alias("total_anomalias"),
        pct(contar(sobre | sin), F.sum(n)).alias("porcentaje_dataset"),
        contar(sobre).alias("sobre_atencion_extrema"),
        contar(sin).alias("sin_atencion_con_casos"),
    )
