"""Findings: a table of threshold rules evaluated on the metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.operators import atipicos, bosque, descriptiva, graficos, patrones
from balanza.operators.descriptiva import pct
from balanza.sesion import construir, cortar


@dataclass(frozen=True)
class Regla:
    """``metrica`` is compared with ``umbral``: '>', '<' or 'abs>'."""

    seccion: str
    regla: str
    metrica: str
    operador: str
    umbral: float
    si: str
    no: str = ""


def _por_medida(m: str) -> list[Regla]:
    num, gra, out = f"numerica.{m}", f"forma.{m}", "outliers"
    return [
        Regla("estadisticas", f"asimetria_{m}", f"{num}.skewness", "abs>", 1, "distribución muy asimétrica, hay casos extremos"),
        Regla("estadisticas", f"variabilidad_{m}", f"{num}.coefficient_variation", ">", 1, "gran heterogeneidad entre registros"),
        Regla("estadisticas", f"concentracion_{m}", f"{num}.concentracion_top10", ">", 50, "los diez mayores concentran la mayor parte"),
        Regla("estadisticas", f"ceros_{m}", f"{num}.zeros_percentage", ">", 5, "demasiados registros en cero"),
        Regla(out, f"iqr_moderado_{m}", f"iqr.{m}.porcentaje", ">", 5, "presencia moderada de extremos", "pocos extremos"),
        Regla(out, f"iqr_alto_{m}", f"iqr.{m}.porcentaje", ">", 10, "presencia alta de extremos"),
        Regla(out, f"mad_moderado_{m}", f"mad.{m}.porcentaje", ">", 5, "algunos valores extremos", "pocos valores extremos"),
        Regla(out, f"mad_alto_{m}", f"mad.{m}.porcentaje", ">", 15, "muchos valores extremos"),
        *_formas(m, gra),
    ]


def _formas(m: str, gra: str) -> list[Regla]:
    return [
        Regla("graficos", f"cola_derecha_{m}", f"{gra}.asimetria", ">", 0.5, "cola a la derecha"),
        Regla("graficos", f"cola_izquierda_{m}", f"{gra}.asimetria", "<", -0.5, "cola a la izquierda"),
        Regla("graficos", f"leptocurtica_{m}", f"{gra}.curtosis", ">", 3, "más apuntada que la normal"),
        Regla("graficos", f"platicurtica_{m}", f"{gra}.curtosis", "<", -3, "más plana que la normal"),
    ]


# Thresholds that the findings must agree with.
REGLAS: tuple[Regla, ...] = (
    Regla("estadisticas", "periodo", "resumen.anios", ">", 0, "años abarcados"),
    Regla("estadisticas", "registros", "resumen.total_registros", ">", 0, "registros analizados"),
    Regla("estadisticas", "tasa_global", "resumen.tasa_atencion_global", ">", 0.8, "eficiencia global alta", "eficiencia global baja"),
    *_por_medida("ingresado"),
    *_por_medida("atendido"),
    *_formas("tasa_atencion", "forma.tasa_atencion"),
    Regla("estadisticas", "eficiencia_perfecta", "eficiencia.casos_eficiencia_perfecta_pct", ">", 20, "posible sobre-registro o traslado de casos"),
    Regla("estadisticas", "eficiencia_baja", "eficiencia.casos_baja_eficiencia_pct", ">", 30, "posibles problemas de capacidad"),
    Regla("estadisticas", "tendencia_ingresados", "temporal.ingresado.p_valor", "<", 0.05, "tendencia significativa"),
    Regla("patrones", "gini_departamental", "geografia.coeficiente_gini", ">", 0.5, "Alta", "Moderada"),
    Regla("patrones", "concentracion_departamental", "geografia.concentracion_top_3", ">", 0, "parte de los tres mayores departamentos"),
    Regla("patrones", "brecha_departamental", "disparidad.brecha_eficiencia", ">", 0, "brecha de eficiencia entre departamentos"),
    Regla("patrones", "materia_dominante", "materia.participacion", ">", 40, "hay una materia dominante", "sin materia dominante"),
    Regla("patrones", "efecto_especializacion", "especializacion.diferencia", ">", 0, "la especialización mejora la eficiencia", "la especialización no mejora la eficiencia"),
    Regla("patrones", "anomalias", "anomalias.total_anomalias", ">", 0, "hay registros anómalos"),
    Regla("outliers", "sobre_atencion_extrema", "contextual.sobre_atencion_extrema.conteo", ">", 0, "posibles errores o casos de otro período"),
    Regla("outliers", "volumen_extremo", "contextual.volumen_extremo.conteo", ">", 0, "carga de trabajo excepcional"),
    Regla("outliers", "sin_atencion_alto_volumen", "contextual.sin_atencion_alto_volumen.conteo", ">", 0, "posibles problemas operativos"),
    Regla("outliers", "multivariados", "multivariado.total_outliers", ">", 0, "combinaciones atípicas de volumen y eficiencia"),
    Regla("outliers", "multivariados_pct", "multivariado.porcentaje", ">", 0, "parte de los registros"),
    Regla("graficos", "materia_mas_registros", "registros_materia.participacion", ">", 0, "materia con más registros"),
    Regla("graficos", "concentracion_diez_distritos", "volumen.concentracion_top_10", ">", 0, "parte de los diez mayores distritos"),
    Regla("graficos", "materia_mas_eficiente", "materias.ef_maxima", ">", 0, "materia más eficiente"),
    Regla("graficos", "materia_menos_eficiente", "materias.ef_minima", ">", 0, "materia menos eficiente"),
    Regla("graficos", "tasa_media", "marcadores.tasa_atencion.media", ">", 1, "por encima de la eficiencia perfecta", "por debajo de la eficiencia perfecta"),
    Regla("graficos", "correlacion_muy_fuerte", "correlacion.ingresado.atendido", ">", 0.8, "la atención crece con el ingreso"),
    Regla("graficos", "correlacion_fuerte", "correlacion.ingresado.atendido", ">", 0.6, "buena capacidad de respuesta", "capacidad de respuesta variable"),
    Regla("graficos", "saturacion", "correlacion.tasa_atencion.ingresado", "<", -0.3, "a mayor volumen, menor eficiencia"),
    Regla("graficos", "economias_escala", "correlacion.tasa_atencion.ingresado", ">", 0.3, "a mayor volumen, mayor eficiencia"),
    Regla("graficos", "concentracion_geografica", "lugar.concentracion_top_5", ">", 50, "alta concentración geográfica"),
    Regla("graficos", "volumen_eficiencia_distrito", "lugar.r_volumen_tasa", "abs>", 0.3, "el volumen se asocia con la eficiencia"),
    Regla("graficos", "crecimiento", "periodo.crecimiento_total", "abs>", 20, "fuerte cambio de la carga"),
    Regla("graficos", "cambio_eficiencia", "periodo.cambio_eficiencia", "abs>", 0.1, "cambio notable de la eficiencia"),
    Regla("graficos", "variabilidad_temporal", "periodo.cv_temporal", ">", 0.15, "alta variabilidad entre años"),
    Regla("graficos", "regresion_registros", "registros.r", "abs>", 0.2, "relación entre volumen y eficiencia", "sin relación clara"),
)


def largo(
    df: DataFrame,
    prefijo: str,
    columnas: Sequence[str],
    clave: str | None = None,
    detalles: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Metrics in long form: ``prefijo[.clave].columna``, its value and, where given, a name that goes with it."""
    raiz = F.lit(prefijo) if clave is None else F.concat_ws(".", F.lit(prefijo), F.col(clave))
    sin = F.lit(None)
    celdas = [
        F.struct(
            F.concat_ws(".", raiz, F.lit(c)).alias("metrica"),
            F.col(c).cast("double").alias("valor"),
            (detalles or {}).get(c, sin).cast("string").alias("detalle"),
        )
        for c in columnas
    ]
    return df.select(F.inline(F.array(*celdas)))


def _resumen(pares: DataFrame, cubo: DataFrame) -> DataFrame:
    anios = cubo.agg((F.max("anio") - F.min("anio") + 1).alias("anios")).scalar()
    return pares.agg(
        F.try_divide(F.sum(F.col("atendido") * F.col("n")), F.sum(F.col("ingresado") * F.col("n"))).alias("tasa_atencion_global"),
        F.sum("n").alias("total_registros"),
    ).withColumn("anios", anios)


def _disparidad(cubo: DataFrame) -> DataFrame:
    dep = cubo.filter(F.col("dpto_pjfs").isNotNull()).groupBy("dpto_pjfs")
    return patrones.comparar_extremos(
        dep.agg(
            (F.sum("suma_tasa") / F.sum("n_tasa")).alias("_media"),
            F.try_divide(F.sum("atendido"), F.sum("ingresado")).alias("_tasa"),
        )
    )


def _por_materia(cubo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subject with most rows and its share of them, and the best and worst ratio of sums."""
    g = cubo.filter(F.col("materia").isNotNull()).groupBy("materia").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("atendido"), F.sum("ingresado")).alias("ef")
    )
    mayor = g.agg(
        pct(F.max("n"), F.sum("n")).alias("participacion"), F.min_by("materia", F.struct(-F.col("n"), "materia")).alias("nombre")
    )
    con = g.filter(F.col("ef").isNotNull())
    extremos = con.agg(
        F.max("ef").alias("ef_maxima"),
        F.min_by("materia", F.struct(-F.col("ef"), "materia")).alias("mas"),
        F.min("ef").alias("ef_minima"),
        F.min_by("materia", F.struct("ef", "materia")).alias("menos"),
    )
    return mayor, extremos


def _mayores_distritos(cubo: DataFrame, k: int = 10) -> DataFrame:
    g = cubo.groupBy("distrito_fiscal").agg(F.sum("ingresado").alias("_t"))
    mayores = g.filter(F.col("distrito_fiscal").isNotNull()).orderBy(F.desc("_t"), "distrito_fiscal").limit(k)
    return g.agg(pct(mayores.agg(F.sum("_t")).scalar(), F.sum("_t")).alias("concentracion_top_10"))


def _cuota_mayor(cubo: DataFrame, clave: str) -> DataFrame:
    g = cubo.filter(F.col(clave).isNotNull()).groupBy(clave).agg(F.sum("ingresado").alias("_t"))
    return g.agg(pct(F.max("_t"), F.sum("_t")).alias("participacion"))


def _efecto(cubo: DataFrame) -> DataFrame:
    def media(v: int) -> Column:
        con = F.col("tiene_especializacion") == v
        return F.sum(F.when(con, F.col("suma_tasa"))) / F.sum(F.when(con, F.col("n_tasa")))

    return cubo.agg((media(1) - media(0)).alias("diferencia"))


def metricas(pares: DataFrame, cubo: DataFrame, marcados: DataFrame | None = None) -> DataFrame:
    """All metrics the rules look at, from the two pre-aggregates and the marked pairs, if there are any."""
    de, pa, at, gr = descriptiva, patrones, atipicos, graficos
    medidas = ("ingresado", "atendido")
    pearson = de.correlacion_pearson(pares).select(
        F.concat_ws(".", "var1", "var2").alias("par"), "r"
    )
    mayor, extremos = _por_materia(cubo)
    lugares = F.concat_ws(" / ", "departamento_mas_eficiente", "departamento_menos_eficiente")
    partes = {
        "resumen": lambda: largo(_resumen(pares, cubo), "resumen", ["tasa_atencion_global", "anios", "total_registros"]),
        "disparidad": lambda: largo(_disparidad(cubo), "disparidad", ["brecha_eficiencia"], detalles={"brecha_eficiencia": lugares}),
        "registros_materia": lambda: largo(
            mayor, "registros_materia", ["participacion"], detalles={"participacion": F.col("nombre")}
        ),
        "materias": lambda: largo(
            extremos, "materias", ["ef_maxima", "ef_minima"], detalles={"ef_maxima": F.col("mas"), "ef_minima": F.col("menos")}
        ),
        "volumen": lambda: largo(_mayores_distritos(cubo), "volumen", ["concentracion_top_10"]),
        "numerica": lambda: largo(
            de.perfil_numerico(pares, medidas, peso="n"),
            "numerica",
            ["skewness", "coefficient_variation", "concentracion_top10", "zeros_percentage"],
            "variable",
        ),
        "eficiencia": lambda: largo(
            de.metricas_eficiencia(pares),
            "eficiencia",
            ["casos_eficiencia_perfecta_pct", "casos_baja_eficiencia_pct"],
        ),
        "temporal": lambda: largo(de.metricas_temporales(cubo), "temporal", ["p_valor"], "variable"),
        "geografia": lambda: largo(
            pa.concentracion_departamental(cubo),
            "geografia",
            ["coeficiente_gini", "concentracion_top_3"],
        ),
        "materia": lambda: largo(_cuota_mayor(cubo, "materia"), "materia", ["participacion"]),
        "especializacion": lambda: largo(_efecto(cubo), "especializacion", ["diferencia"]),
        "anomalias": lambda: largo(pa.anomalias(pares), "anomalias", ["total_anomalias"]),
        "iqr": lambda: largo(at.outliers_iqr(pares, medidas, "n"), "iqr", ["porcentaje"], "variable"),
        "mad": lambda: largo(at.outliers_mad(pares, medidas, "n"), "mad", ["porcentaje"], "variable"),
        "contextual": lambda: largo(at.outliers_contextuales(pares), "contextual", ["conteo"], "tipo"),
        "marcadores": lambda: largo(gr.marcadores(pares), "marcadores", ["media"], "variable"),
        "forma": lambda: largo(gr.forma(pares), "forma", ["asimetria", "curtosis"], "variable"),
        "correlacion": lambda: pearson.select(
            F.concat_ws(".", F.lit("correlacion"), "par").alias("metrica"),
            F.col("r").alias("valor"),
            F.lit(None).cast("string").alias("detalle"),
        ),
        "lugar": lambda: largo(
            gr.resumen_geografico(cubo), "lugar", ["concentracion_top_5", "r_volumen_tasa"]
        ),
        "periodo": lambda: largo(
            gr.resumen_periodo(cubo),
            "periodo",
            ["crecimiento_total", "cambio_eficiencia", "cv_temporal"],
        ),
        "registros": lambda: largo(gr.regresion_registros(pares), "registros", ["r"]),
    }
    if marcados is not None:
        partes["multivariado"] = lambda: largo(
            bosque.outliers_multivariados(marcados), "multivariado", ["total_outliers", "porcentaje"]
        )
    # Each part is cut, so that the rules read some twenty small tables.
    cortadas = construir({k: (lambda f=f: cortar(f())) for k, f in partes.items()})
    return reduce(DataFrame.unionByName, cortadas.values())


def tabla_reglas(spark: SparkSession, reglas: Sequence[Regla] = REGLAS) -> DataFrame:
    filas = [(r.seccion, r.regla, r.metrica, r.operador, float(r.umbral), r.si, r.no) for r in reglas]
    return spark.createDataFrame(
        filas,
        "seccion string, regla string, metrica string, operador string, umbral double, "
        "si string, no string",
    )


def evaluar(metricas_: DataFrame, reglas: Sequence[Regla] = REGLAS) -> DataFrame:
    """One row per rule: value, threshold, outcome and text; no value, no row.  ``metricas_`` may lack ``detalle``."""
    if "detalle" not in metricas_.columns:
        metricas_ = metricas_.withColumn("detalle", F.lit(None).cast("string"))
    v, u, op = F.col("valor"), F.col("umbral"), F.col("operador")
    cumple = (
        F.when(op == ">", v > u).when(op == "<", v < u).when(op == "abs>", F.abs(v) > u)
    )
    texto = F.format_string(
        "%s: %s (%s)", F.col("metrica"), F.when(F.col("cumple"), F.col("si")).otherwise(F.col("no")),
        F.format_number("valor", 3),
    )
    texto = F.concat(texto, F.coalesce(F.concat(F.lit(", "), F.col("detalle")), F.lit("")))
    con_texto = F.when(F.col("cumple"), F.col("si") != "").otherwise(F.col("no") != "")
    return (
        tabla_reglas(metricas_.sparkSession, reglas)
        .join(metricas_.filter(F.col("valor").isNotNull()), "metrica")
        .withColumn("cumple", cumple)
        .select(
            "seccion",
            "regla",
            "metrica",
            "operador",
            "umbral",
            "valor",
            "cumple",
            F.when(con_texto, texto).alias("texto"),
        )
        .orderBy("seccion", "regla")
    )


def hallazgos(df: DataFrame) -> DataFrame:
    """All findings of a flat table: two passes over the rows, then small jobs."""
    pares = descriptiva.pares_medidas(df)
    return evaluar(metricas(pares, descriptiva.cubo_casos(df), bosque.marcar_multivariados(pares)))


def correlaciones_principales(matriz: DataFrame, k: int = 3) -> DataFrame:
    """Findings on the k strongest pairs."""
    return descriptiva.correlaciones_fuertes(matriz).limit(k)


def hallazgos_grupos(perfil: DataFrame) -> DataFrame:
    """Findings on the natural groups: their number, quality and make-up."""
    return perfil.select(
        F.lit("patrones").alias("seccion"),
        F.format_string("grupo_%d", F.col("cluster")).alias("regla"),
        "numero_clusters_optimo",
        "silhouette_score",
        F.format_string(
            "%s, %s (%s %%)",
            F.col("caracteristica_volumen"),
            F.col("caracteristica_eficiencia"),
            F.format_number("porcentaje", 1),
        ).alias("texto"),
    )
