"""Descriptive statistics of the clean table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from balanza.esquema import ROLES, SENTINELA
from balanza.functions.clases import (
    clase_volumen_fila,
    direccion_tendencia,
    fuerza_correlacion,
    nivel_concentracion,
    signo_correlacion,
)
from balanza.functions.estadistica import (
    jarque_bera,
    normal_acumulada,
    p_jarque_bera,
    p_lilliefors,
    p_valor_pendiente,
)
from balanza.functions.tasas import derivar_metricas, tasa_nula
from balanza.operators.frecuencias import (
    acumular,
    asimetria,
    cuantil_agregado,
    curtosis_exceso,
    gini_agregado,
    iguales,
    momentos,
    std_muestral,
    tabla,
    tabla_larga,
    unir_por_grupo,
)
from balanza.sesion import cortar

# Fixed values of the reports.
NIVEL_SIGNIFICANCIA = 0.05
UMBRAL_CORRELACION = 0.5
BAJA_EFICIENCIA = 0.5
ALTO_VOLUMEN, BAJO_VOLUMEN = 1000, 10


def suma(c: str) -> Column:
    return F.sum(F.col(c).cast("long"))


def pct(parte: Column, total: Column) -> Column:
    return F.when(total != 0, parte / total * 100)


def pares_medidas(df: DataFrame) -> DataFrame:
    """Distinct (filed, attended) pairs with their row count and both derived metrics.

    Rate and pending cases follow from the pair, so everything that looks only at the
    measures can work on this table instead of the rows.
    """
    ing, at = F.col("ingresado"), F.col("atendido")
    p = tabla(df, ["ingresado", "atendido"])
    return cortar(
        p.withColumns({"tasa_atencion": tasa_nula(ing, at), "casos_pendientes": ing - at})
    )


def cubo_casos(df: DataFrame) -> DataFrame:
    """Sums by year, district, department, subject and speciality.

    A pre-aggregate in place of the rows for everything that only needs sums by some
    of these keys; ``suma_tasa / n_tasa`` gives the mean row rate.
    """
    t = tasa_nula(F.col("ingresado"), F.col("atendido"))
    esp = ~F.col("especializada").eqNullSafe(F.lit(SENTINELA))
    return cortar(
        df.groupBy(
            "anio",
            "distrito_fiscal",
            "dpto_pjfs",
            "materia",
            esp.cast("int").alias("tiene_especializacion"),
        ).agg(
            suma("ingresado").alias("ingresado"),
            suma("atendido").alias("atendido"),
            F.sum(t).alias("suma_tasa"),
            F.count(t).alias("n_tasa"),
            F.count(F.lit(1)).alias("n"),
        )
    )


# ------------------------------------------------------------------------ summaries


def resumen_inicial(df: DataFrame) -> DataFrame:
    """Period, sizes, totals and the special cases, in one row."""
    ing, at, n = F.col("ingresado"), F.col("atendido"), F.count(F.lit(1))
    casos = {
        "sin_ingreso": ing == 0,
        "sin_atencion": at == 0,
        "sobreatendidos": at > ing,
    }
    especiales = []
    for nombre, cond in casos.items():
        k = F.count_if(cond)
        especiales += [k.alias(nombre), pct(k, n).alias(f"{nombre}_pct")]
    return df.agg(
        F.min("anio").alias("anio_min"),
        F.max("anio").alias("anio_max"),
        n.alias("total_registros"),
        F.countDistinct("distrito_fiscal").alias("distritos"),
        F.countDistinct("materia").alias("materias"),
        suma("ingresado").alias("total_ingresados"),
        suma("atendido").alias("total_atendidos"),
        pct(suma("atendido"), suma("ingresado")).alias("tasa_global_pct"),
        *especiales,
    )


def resumen_general(df: DataFrame) -> DataFrame:
    """One-row summary; completeness counts every column, derived ones too."""
    derivada = derivar_metricas(df)
    columnas = derivada.columns
    nulos = sum((F.col(f"`{c}`").isNull().cast("long") for c in columnas), F.lit(0).cast("long"))
    celdas = F.count(F.lit(1)) * len(columnas)
    return derivada.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.min("anio").alias("periodo_inicio"),
        F.max("anio").alias("periodo_fin"),
        F.countDistinct("distrito_fiscal").alias("total_distritos"),
        F.countDistinct("dpto_pjfs").alias("total_departamentos"),
        suma("ingresado").alias("casos_totales_ingresados"),
        suma("atendido").alias("casos_totales_atendidos"),
        F.try_divide(suma("atendido"), suma("ingresado")).alias("tasa_atencion_global"),
        ((1 - F.sum(nulos) / celdas) * 100).alias("completitud_datos"),
    )


# ------------------------------------------------------------------------- profiles


def perfil_numerico(
    df: DataFrame,
    variables: Sequence[str] = ROLES.numericas,
    metricas: Sequence[str] = ROLES.metricas,
    k_top: int = 10,
    peso: str | None = None,
) -> DataFrame:
    """Centre, spread, shape, special values and normality of each numeric column."""
    freq = cortar(tabla_larga(df, variables, peso=peso))
    g = ["variable"]
    acc = cortar(acumular(freq, g))
    v, n = F.col("valor"), F.col("n")
    q = acc.groupBy(*g).agg(
        *[
            cuantil_agregado(p).alias(a)
            for a, p in {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}.items()
        ],
        F.min_by("valor", F.struct(-n, v)).alias("mode"),
    )
    q = cortar(q)
    # Rows above a value: total - previos - n; the k largest rows are read off it.
    arriba = F.col("total") - F.col("previos") - n
    toma = F.greatest(F.least(F.lit(k_top) - arriba, n), F.lit(0))
    extremos = (
        unir_por_grupo(acc, q, g, ["q05", "q95"])
        .groupBy(*g)
        .agg(
            F.coalesce(F.sum(F.when(v > F.col("q95"), n)), F.lit(0)).alias("_altos"),
            F.coalesce(F.sum(F.when(v < F.col("q05"), n)), F.lit(0)).alias("_bajos"),
            F.sum(toma * v).alias("_top"),
        )
    )
    faltan = freq.groupBy(*g).agg(
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("missing_count"),
        F.sum(n).alias("_filas"),
    )
    m = momentos(freq, g)
    t = m.join(q, g).join(extremos, g).join(faltan, g)
    t = t.withColumns({"_std": std_muestral(), "_s": asimetria(), "_k": curtosis_exceso()})
    c = F.col
    es_metrica = c("variable").isin(*metricas)
    p = p_jarque_bera(jarque_bera(c("conteo"), c("_s"), c("_k")))
    p = F.when(c("conteo") >= 3, p)
    return t.select(
        "variable",
        c("conteo").alias("count"),
        c("media").alias("mean"),
        "median",
        "mode",
        c("_std").alias("std"),
        c("minimo").alias("min"),
        c("maximo").alias("max"),
        "q25",
        "q75",
        (c("maximo") - c("minimo")).alias("range"),
        (c("q75") - c("q25")).alias("iqr"),
        F.when(c("media") != 0, c("_std") / c("media")).otherwise(0.0).alias(
            "coefficient_variation"
        ),
        c("_s").alias("skewness"),
        c("_k").alias("kurtosis"),
        c("ceros").alias("zeros_count"),
        (c("ceros") / c("conteo") * 100).alias("zeros_percentage"),
        c("negativos").alias("negative_count"),
        "missing_count",
        (c("missing_count") / c("_filas") * 100).alias("missing_percentage"),
        p.alias("normalidad_p"),
        (p > NIVEL_SIGNIFICANCIA).alias("es_normal"),
        F.when(es_metrica, c("_altos")).alias("casos_extremos_altos"),
        F.when(es_metrica, c("_bajos")).alias("casos_extremos_bajos"),
        F.when(es_metrica, pct(c("_top"), c("suma"))).alias("concentracion_top10"),
    )


def normalidad(df: DataFrame, variables: Sequence[str] = ROLES.numericas) -> DataFrame:
    """Two tests of normality on all rows: Jarque-Bera on the moments, Lilliefors on the whole distribution.

    ``ks`` is the largest distance between the distribution of the rows, before and at
    each distinct value, and the normal one with their mean and sample deviation.
    """
    g = ["variable"]
    freq = cortar(tabla_larga(df, variables))
    m = momentos(freq, g).withColumns({"skewness": asimetria(), "kurtosis": curtosis_exceso(), "_std": std_muestral()})
    m = cortar(m.filter(F.col("conteo") >= 3))
    con = unir_por_grupo(acumular(freq, g), m.select("variable", "media", "_std"), g, ["media", "_std"])
    teorica = normal_acumulada((F.col("valor") - F.col("media")) / F.col("_std"))
    antes, hasta = F.col("previos") / F.col("total"), (F.col("previos") + F.col("n")) / F.col("total")
    lejos = F.greatest(F.abs(antes - teorica), F.abs(hasta - teorica))
    ks = con.groupBy(*g).agg(F.max(F.when(F.col("_std") > 0, lejos)).alias("ks"))
    jb = jarque_bera(F.col("conteo"), F.col("skewness"), F.col("kurtosis"))
    return (
        m.select("variable", "conteo", "skewness", "kurtosis", jb.alias("jb"))
        .withColumn("p_valor", p_jarque_bera(F.col("jb")))
        .withColumn("es_normal", F.col("p_valor") > NIVEL_SIGNIFICANCIA)
        .join(ks, g, "left")
        .withColumn("ks_p", p_lilliefors(F.col("ks"), F.col("conteo")))
        .withColumn("es_normal_ks", F.col("ks_p") > NIVEL_SIGNIFICANCIA)
    )


def perfil_categorico(
    df: DataFrame, variables: Sequence[str] = ROLES.categoricas
) -> DataFrame:
    """Distinct values, mode, entropy, Gini and concentration of each text column."""
    freq = cortar(tabla_larga(df, [c for c in variables if c in df.columns], tipo="string"))
    g, n, con = ["variable"], F.col("n"), F.col("valor").isNotNull()
    validos = freq.filter(con)
    base = freq.groupBy(*g).agg(
        F.count("valor").alias("unique_values"),
        F.coalesce(F.sum(F.when(~con, n)), F.lit(0)).alias("missing_count"),
        F.sum(n).alias("_filas"),
        F.coalesce(F.sum(F.when(con, n)), F.lit(0)).alias("_validos"),
        F.sum(F.when(con, n * F.log(n))).alias("_nln"),
    )
    # Three rows per column survive the window; the limit is applied before the shuffle.
    puesto = F.row_number().over(Window.partitionBy(*g).orderBy(F.desc("n"), "valor"))
    tres = validos.withColumn("_p", puesto).filter(F.col("_p") <= 3)
    texto = F.concat_ws(": ", "valor", n.cast("string"))
    tres = tres.groupBy(*g).agg(
        F.min_by("valor", "_p").alias("mode"),
        F.max("n").alias("mode_frequency"),
        F.sum("n").alias("_tres"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_p", texto.alias("t")))), lambda x: x["t"]),
            "; ",
        ).alias("top_3_values"),
    )
    # Gini of the counts: frequency of each count, then its position.
    de_conteos = validos.groupBy(*g, F.col("n").alias("valor")).agg(
        F.count(F.lit(1)).alias("n")
    )
    gini = acumular(de_conteos, g).groupBy(*g).agg(gini_agregado().alias("gini_concentration"))
    c = F.col
    entropia = F.log(c("_validos")) - c("_nln") / c("_validos")
    return (
        base.join(tres, g)
        .join(gini, g)
        .select(
            "variable",
            "unique_values",
            "missing_count",
            (c("missing_count") / c("_filas") * 100).alias("missing_percentage"),
            "mode",
            "mode_frequency",
            (c("mode_frequency") / c("_filas") * 100).alias("mode_percentage"),
            F.when(c("unique_values") > 1, entropia).otherwise(0.0).alias("entropy"),
            "gini_concentration",
            "top_3_values",
            (c("_tres") / c("_filas") * 100).alias("top_3_percentage"),
            nivel_concentracion(c("_tres") / c("_validos") * 100).alias(
                "interpretacion_concentracion"
            ),
        )
    )


# ----------------------------------------------------------------- business metrics


def metricas_eficiencia(pares: DataFrame) -> DataFrame:
    """Mean and median rate, perfect and low rows (over rows with a rate)."""
    validos = pares.filter(F.col("tasa_atencion").isNotNull())
    t, n = F.col("tasa_atencion"), F.col("n")
    freq = validos.groupBy("tasa_atencion").agg(F.sum("n").alias("n"))
    mediana = acumular(freq, valor="tasa_atencion").agg(
        cuantil_agregado(0.5, "tasa_atencion").alias("m")
    )
    perfecta = F.coalesce(F.sum(F.when(t >= 1.0, n)), F.lit(0))
    baja = F.coalesce(F.sum(F.when(t < BAJA_EFICIENCIA, n)), F.lit(0))
    return validos.agg(
        (F.sum(t * n) / F.sum(n)).alias("tasa_atencion_promedio"),
        perfecta.alias("casos_eficiencia_perfecta"),
        pct(perfecta, F.sum(n)).alias("casos_eficiencia_perfecta_pct"),
        baja.alias("casos_baja_eficiencia"),
        pct(baja, F.sum(n)).alias("casos_baja_eficiencia_pct"),
    ).withColumn("tasa_atencion_mediana", mediana.scalar())


def metricas_volumen(df: DataFrame, k: int = 10) -> DataFrame:
    """Rows per volume bin and share of the k largest districts."""
    ing = F.col("ingresado")
    clase = clase_volumen_fila(ing)
    nombres = {
        "muy_bajo": "Muy Bajo",
        "bajo": "Bajo",
        "medio": "Medio",
        "alto": "Alto",
        "muy_alto": "Muy Alto",
    }
    # One pass gives the districts' totals; the global figures are sums of those.
    por_distrito = cortar(
        df.groupBy("distrito_fiscal").agg(
            suma("ingresado").alias("_total"),
            *[F.count_if(clase == v).alias(c) for c, v in nombres.items()],
            F.count_if(ing > ALTO_VOLUMEN).alias("casos_alto_volumen"),
            F.count_if(ing <= BAJO_VOLUMEN).alias("casos_bajo_volumen"),
        )
    )
    mayores = (
        por_distrito.filter(F.col("distrito_fiscal").isNotNull())
        .orderBy(F.desc("_total"), "distrito_fiscal")
        .limit(k)
        .agg(F.sum("_total"))
    )
    return por_distrito.agg(
        *[F.sum(c).alias(c) for c in (*nombres, "casos_alto_volumen", "casos_bajo_volumen")],
        F.sum("_total").alias("_total"),
    ).select(
        *nombres,
        "casos_alto_volumen",
        "casos_bajo_volumen",
        pct(mayores.scalar(), F.col("_total")).alias("concentracion_top_10_distritos"),
    )


def evolucion_anual(df: DataFrame) -> DataFrame:
    """Yearly totals and the global rate of the year."""
    return df.groupBy("anio").agg(
        suma("ingresado").alias("ingresado"),
        suma("atendido").alias("atendido"),
        F.try_divide(suma("atendido"), suma("ingresado")).alias("tasa_global"),
    )


def tendencia(serie: DataFrame, claves: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group, with its significance."""
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    g = serie.groupBy(*claves).agg(
        F.regr_slope(yy, xx).alias("pendiente"),
        F.regr_intercept(yy, xx).alias("intercepto"),
        F.regr_r2(yy, xx).alias("r_cuadrado"),
        F.regr_count(yy, xx).alias("puntos"),
    )
    p = p_valor_pendiente(F.col("r_cuadrado"), F.col("puntos"))
    return (
        g.withColumn("p_valor", p)
        .withColumn("es_significativa", F.col("p_valor") < NIVEL_SIGNIFICANCIA)
        .withColumn("direccion", direccion_tendencia(F.col("pendiente")))
    )


def serie_anual_larga(df: DataFrame, metricas: Sequence[str] = ROLES.metricas) -> DataFrame:
    """(variable, anio, posicion, valor): yearly totals in long form, positions from 0.

    Windows here run over years only, a handful of rows per measure.
    """
    anual = cortar(df.groupBy("anio").agg(*[suma(c).alias(c) for c in metricas]))
    largo = anual.select(
        "anio",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("variable"), F.col(c).alias("valor"))
                    for c in metricas
                ]
            )
        ),
    )
    pos = F.row_number().over(Window.partitionBy("variable").orderBy("anio")) - 1
    return largo.withColumn("posicion", pos)


def metricas_temporales(df: DataFrame) -> DataFrame:
    """Trend, variability and total growth of the yearly totals of both measures."""
    serie = serie_anual_larga(df)
    t = tendencia(serie, ["variable"], "posicion", "valor")
    extra = serie.groupBy("variable").agg(
        F.stddev_samp("valor").alias("variabilidad_anual"),
        F.min_by("valor", "anio").alias("_primero"),
        F.max_by("valor", "anio").alias("_ultimo"),
    )
    crecimiento = F.try_divide(F.col("_ultimo") - F.col("_primero"), F.col("_primero")) * 100
    return (
        t.join(extra, "variable")
        .filter(F.col("puntos") > 1)
        .withColumn("crecimiento_total", crecimiento)
        .drop("_primero", "_ultimo", "intercepto", "puntos")
    )


# --------------------------------------------------------------------- correlations


def _matriz(
    datos: DataFrame, variables: Sequence[str], peso: str, centro: dict[str, Column]
) -> DataFrame:
    """Long correlation matrix of weighted rows, pairwise complete.

    Values are shifted by a centre close to their mean before the sums are taken, so
    that the textbook formula does not cancel.
    """
    x = {v: F.col(v).cast("double") - centro[v] for v in variables}
    celdas = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), x[a].alias("x"), x[b].alias("y")
        )
        for i, a in enumerate(variables)
        for b in variables[i:]
    ]
    largo = datos.select(F.col(peso).cast("double").alias("n"), F.inline(F.array(*celdas)))
    c = F.col
    s = (
        # A pair without complete rows keeps its place in the matrix, with a null r.
        largo.withColumn("n", F.when(c("x").isNotNull() & c("y").isNotNull(), c("n")))
        .groupBy("a", "b")
        .agg(
            F.sum("n").alias("sn"),
            F.sum(c("n") * c("x")).alias("sx"),
            F.sum(c("n") * c("y")).alias("sy"),
            F.sum(c("n") * c("x") * c("x")).alias("sxx"),
            F.sum(c("n") * c("y") * c("y")).alias("syy"),
            F.sum(c("n") * c("x") * c("y")).alias("sxy"),
        )
    )
    vx = c("sxx") - c("sx") * c("sx") / c("sn")
    vy = c("syy") - c("sy") * c("sy") / c("sn")
    cov = c("sxy") - c("sx") * c("sy") / c("sn")
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))

    def fila(p: str, q: str) -> Column:
        return F.struct(c(p).alias("var1"), c(q).alias("var2"))

    # Both triangles; the diagonal once.
    lados = F.when(c("a") == c("b"), F.array(fila("a", "b"))).otherwise(
        F.array(fila("a", "b"), fila("b", "a"))
    )
    return s.select(r.alias("r"), F.inline(lados)).select("var1", "var2", "r")


def correlacion_pearson(
    pares: DataFrame, variables: Sequence[str] = ROLES.correlacion
) -> DataFrame:
    """Pearson matrix in long form (var1, var2, r)."""
    n = F.col("n")
    medias = pares.agg(
        F.struct(
            *[
                (F.sum(F.col(v) * n) / F.sum(F.when(F.col(v).isNotNull(), n))).alias(v)
                for v in variables
            ]
        ).alias("m")
    )
    m = medias.scalar()
    return _matriz(pares, variables, "n", {v: m.getField(v) for v in variables})


def correlacion_spearman(
    pares: DataFrame, variables: Sequence[str] = ROLES.correlacion, con_nulos: str = "tasa_atencion"
) -> DataFrame:
    """Spearman matrix in long form: average ranks, pairwise complete.

    Only ``con_nulos`` may be null, so there are two populations: all rows, and the
    rows where it has a value.  Each gets its own ranks.
    """
    id_par = ["_ing", "_at"]
    otras = [v for v in variables if v != con_nulos]
    celdas = [("todas", v) for v in otras] + [("validas", v) for v in variables]
    valor = {
        (p, v): F.when(
            F.lit(True) if p == "todas" else F.col(con_nulos).isNotNull(), F.col(v).cast("double")
        )
        for p, v in celdas
    }
    largo = pares.select(
        F.col("ingresado").alias("_ing"),
        F.col("atendido").alias("_at"),
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("poblacion"),
                        F.lit(v).alias("variable"),
                        valor[p, v].alias("valor"),
                    )
                    for p, v in celdas
                ]
            )
        ),
    ).filter(F.col("valor").isNotNull())
    grupo = ["poblacion", "variable"]
    freq = largo.groupBy(*grupo, "valor").agg(F.sum("n").alias("n"))
    rangos = acumular(freq, grupo).select(
        *grupo,
        "valor",
        (F.col("previos") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2).alias("rango"),
    )
    cond = reduce(Column.__and__, iguales([*grupo, "valor"]))
    con = largo.alias("a").join(rangos.alias("b"), cond).select("a.*", "b.rango")
    ancho = cortar(
        con.groupBy(*id_par, "n", "poblacion").agg(
            *[F.max(F.when(F.col("variable") == v, F.col("rango"))).alias(v) for v in variables]
        )
    )
    cero = {v: F.lit(0.0) for v in variables}
    de_todas = _matriz(ancho.filter("poblacion = 'todas'"), otras, "n", cero)
    de_validas = _matriz(ancho.filter("poblacion = 'validas'"), variables, "n", cero)
    con_tasa = (F.col("var1") == con_nulos) | (F.col("var2") == con_nulos)
    return de_todas.unionByName(de_validas.filter(con_tasa))


def correlaciones_fuertes(
    matriz: DataFrame,
    umbral: float = UMBRAL_CORRELACION,
    variables: Sequence[str] = ROLES.correlacion,
) -> DataFrame:
    """Pairs of the upper triangle with |r| at or above the limit, strongest first."""
    lista = F.array(*[F.lit(v) for v in variables])
    r = F.col("r")
    return (
        matriz.filter(F.array_position(lista, F.col("var1")) < F.array_position(lista, F.col("var2")))
        .filter(F.abs(r) >= umbral)
        .select(
            F.col("var1").alias("variable1"),
            F.col("var2").alias("variable2"),
            r.alias("correlacion"),
            fuerza_correlacion(r).alias("fuerza"),
            signo_correlacion(r).alias("direccion"),
        )
        .orderBy(F.desc(F.abs("correlacion")), "variable1", "variable2")
    )


def triangulo_inferior(
    matriz: DataFrame, variables: Sequence[str] = ROLES.correlacion
) -> DataFrame:
    """Cells of the correlation heat map (below the diagonal)."""
    lista = F.array(*[F.lit(v) for v in variables])
    return matriz.filter(
        F.array_position(lista, F.col("var1")) > F.array_position(lista, F.col("var2"))
    )


