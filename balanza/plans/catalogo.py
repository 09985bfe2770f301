"""Named queries over the demonstration tables: name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.esquema import ROLES
from balanza.functions.tasas import derivar_metricas
from balanza.operators import (
    atipicos,
    bi,
    bosque,
    bosquejos,
    calidad,
    descriptiva,
    dimensiones,
    estrella,
    graficos,
    grupos,
    hallazgos,
    limpieza,
    patrones,
)
from balanza.operators.vista import vista_desde_casos
from balanza.plans import almacen
from balanza.sesion import carpeta_nueva, cortar, cortar_varios
from balanza.sinks import salidas
from balanza.sources.demo import TODAS, casos, casos_publicados, casos_sucios

Consulta = Callable[[SparkSession, str], DataFrame]

_LUGAR = ("distrito_fiscal", "dpto_pjfs", "region_geografica")
_MEDIDAS = ("ingresado", "atendido")


def _vista(spark: SparkSession, d: str, *columnas: str) -> DataFrame:
    return vista_desde_casos(casos(spark, d, (*columnas, *_MEDIDAS)))


def _consultas_informes() -> dict[str, Consulta]:
    return {
        "resumen_ejecutivo": lambda s, d: bi.resumen_ejecutivo(
            _vista(s, d, "anio", "distrito_fiscal", "materia")
        ),
        "performance_distrito": lambda s, d: bi.performance_distrito(
            _vista(s, d, "anio", *_LUGAR, "materia", "tipo_fiscalia")
        ),
        "analisis_materia": lambda s, d: bi.analisis_materia(
            _vista(s, d, "anio", "distrito_fiscal", "materia", "especialidad")
        ),
        "top_performers": lambda s, d: bi.top_performers(
            _vista(s, d, "anio", *_LUGAR, "materia", "especialidad")
        ),
        "evolucion_temporal": lambda s, d: bi.evolucion_temporal(
            _vista(s, d, "anio", "distrito_fiscal", "dpto_pjfs", "materia")
        ),
        "fiscalias_especializadas": lambda s, d: bi.fiscalias_especializadas(
            _vista(s, d, "anio", "distrito_fiscal", "materia", "especializada")
        ),
        "metricas_regionales": lambda s, d: bi.metricas_regionales(
            _vista(s, d, "anio", *_LUGAR, "materia", "especializada")
        ),
        "percentil_eficiencia": lambda s, d: bi.calcular_percentil_eficiencia(
            _vista(s, d, "distrito_fiscal")
        ),
        "percentil_eficiencia_filtrado": lambda s, d: bi.calcular_percentil_eficiencia(
            _vista(s, d, "anio", "distrito_fiscal", "materia"), 1998, "PROMO"
        ),
    }


def _estrella(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    # Read twice, for the dimensions and for the facts: the lookups of the source run once.
    df = cortar(casos(spark, d))
    dims = estrella.construir_dimensiones(df, region=F.col("region_geografica"))
    return dims, estrella.construir_hechos(df, dims)


def _control_hechos(spark: SparkSession, d: str) -> DataFrame:
    """Control on a variant with a second spelling for each location and with rates of 12."""
    df = casos(spark, d, (*TODAS, "clave_orden"))
    k, ing = F.col("clave_orden"), F.col("ingresado")
    df = df.withColumns(
        {
            "prov_pjfs": F.when(k % 3 == 0, F.concat("prov_pjfs", F.lit(" B"))).otherwise(F.col("prov_pjfs")),
            "atendido": F.when(k % 97 == 0, ing * 12).otherwise(F.col("atendido")),
        }
    )
    dims = estrella.construir_dimensiones(df, region=F.col("region_geografica"))
    return estrella.control_hechos(df, dims, estrella.construir_hechos(df, dims))


def _con_nuevos(df: DataFrame) -> DataFrame:
    """A third of the orders after 1997 with values that sort before all earlier ones, and other spellings of places."""
    nuevo = (F.col("anio") > 1997) & (F.col("clave_orden") % 3 == 0)
    columnas = ("distrito_fiscal", "tipo_fiscalia", "materia", "especialidad", "tipo_caso", "especializada", "prov_pjfs")
    return df.withColumns({c: F.when(nuevo, F.concat(F.lit("AA "), c)).otherwise(F.col(c)) for c in columnas})


def _dos_cargas(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """The rows, the dimension tables of a load up to 1997, and all tables after the rest was added twice."""
    base = carpeta_nueva(spark, "almacen")
    # Six passes read these rows; the lookups of the source run once.
    df, region = cortar(_con_nuevos(casos(spark, d, (*TODAS, "clave_orden")))), F.col("region_geografica")
    almacen.cargar_almacen(df.filter("anio <= 1997"), base, region)
    tablas = list(estrella.CLAVES)
    antes = cortar_varios(salidas.leer_estrella(spark, base, tablas)[0])
    for _ in range(2):
        almacen.agregar_anios(df.filter("anio > 1997"), base, region)
    return df, antes, *salidas.leer_estrella(spark, base, tablas)


def _almacen_incremental(spark: SparkSession, d: str) -> DataFrame:
    df, _, dims, hechos = _dos_cargas(spark, d)
    ids = hechos.join(dims["dim_tiempo"].select("id_tiempo", "anio"), "id_tiempo")
    ids = ids.groupBy("anio").agg(F.countDistinct("id_caso").alias("casos_distintos"))
    return estrella.control_hechos(df, dims, hechos).join(ids, "anio")


def _claves_duraderas(spark: SparkSession, d: str) -> DataFrame:
    _, antes, dims, _ = _dos_cargas(spark, d)
    return estrella.comparar_claves(antes, dims)


def _hechos_a_revisar(hechos: DataFrame) -> DataFrame:
    """What the rules read of the fact, so that its lookups run once."""
    return cortar(hechos.select(*calidad.COLUMNAS_HECHOS))


def _violaciones(spark: SparkSession, d: str) -> DataFrame:
    dims, hechos = _estrella(spark, d)
    return calidad.violaciones(dims, _hechos_a_revisar(hechos))


def _sembradas(spark: SparkSession, d: str) -> DataFrame:
    """Constraint check of tables that break every kind of rule."""
    df = casos_publicados(spark, d, (*TODAS, "clave_orden"))
    k = F.col("clave_orden")

    def si(cond: Column, valor: Column, c: str) -> Column:
        return F.when(cond, valor).otherwise(F.col(c))

    nulo = F.lit(None)
    df = df.withColumns(
        {
            "materia": si(k % 97 == 0, nulo, "materia"),
            "especialidad": si(k % 89 == 0, nulo, "especialidad"),
            "tipo_caso": si(k % 101 == 0, F.concat(F.lit("INCIDENTE "), F.repeat(F.lit("Z"), 60)), "tipo_caso"),
            "prov_pjfs": si(k % 3 == 0, F.concat("prov_pjfs", F.lit(" B")), "prov_pjfs"),
            "ingresado": si(k % 307 == 0, F.lit(-5), "ingresado"),
            "fecha_corte": si(k % 113 == 0, nulo, "fecha_corte"),
        }
    )
    df = cortar(df)
    dims = estrella.construir_dimensiones(df, region=F.col("region_geografica"))
    hechos = _hechos_a_revisar(estrella.construir_hechos(df, dims))
    dims["dim_tipos_caso"] = dims["dim_tipos_caso"].filter("tipo_caso <> 'CONSULTAS'")
    dims["dim_materias"] = dims["dim_materias"].filter("materia <> 'PROMO'")
    dims["dim_tiempo"] = dims["dim_tiempo"].withColumn("periodo", F.when(F.col("anio") > 1996, F.col("periodo")))
    return calidad.violaciones(dims, hechos)


def _bosquejos(spark: SparkSession, d: str) -> DataFrame:
    """Sketches stored year by year, merged for two spans and held against the rows."""
    columnas = ("distrito_fiscal", "materia", "especialidad", "tipo_caso")
    df = cortar(casos(spark, d, ("anio", *columnas, *_MEDIDAS)))
    ruta = carpeta_nueva(spark, "bosquejos")
    for parte in (F.col("anio") <= 1997, F.col("anio") > 1997):
        bosquejos.guardar_bosquejos(bosquejos.bosquejar(df.filter(parte), columnas, _MEDIDAS), ruta)
    guardados = spark.read.parquet(ruta)
    return bosquejos.contraste(df, guardados, 1995, 2001).unionByName(bosquejos.contraste(df, guardados, 1997, 1998))


def _vista_completa(spark: SparkSession, d: str) -> DataFrame:
    v = estrella.vista_casos_completo(*_estrella(spark, d))
    return v.drop("id_caso").withColumn("tasa_atencion", F.col("tasa_atencion").cast("double"))


def _consultas_dimension() -> dict[str, Consulta]:
    dim = dimensiones
    simples = {
        "dim_tipos_caso": (dim.dim_tipos_caso, ("tipo_caso",)),
        "dim_fiscalias_especializadas": (dim.dim_fiscalias_especializadas, ("especializada",)),
        "dim_materias": (dim.dim_materias, ("materia",)),
        "dim_especialidades": (dim.dim_especialidades, ("especialidad", "materia")),
        "dim_ubicaciones": (
            lambda df: dim.dim_ubicaciones(df).drop("registros"),
            ("ubigeo_pjfs", "dpto_pjfs", "prov_pjfs", "dist_pjfs"),
        ),
        "dim_distritos": (dim.dim_distritos, ("distrito_fiscal", "ubigeo_pjfs", "dpto_pjfs")),
        "dim_tipos_fiscalia": (dim.dim_tipos_fiscalia, ("tipo_fiscalia",)),
        "dim_tiempo": (dim.dim_tiempo, ("anio", "periodo")),
        "especializacion": (dim.especializacion, ("especializada",)),
    }
    salida: dict[str, Consulta] = {
        nombre: (lambda s, d, f=f, cols=cols: f(casos(s, d, cols)))
        for nombre, (f, cols) in simples.items()
    }
    salida["distritos_por_departamento"] = lambda s, d: dim.distritos_por_departamento(
        dim.dim_distritos(casos(s, d, ("distrito_fiscal", "ubigeo_pjfs", "dpto_pjfs")))
    )
    salida["tipos_caso_por_categoria"] = lambda s, d: dim.conteo_por_clase(
        dim.dim_tipos_caso(casos(s, d, ("tipo_caso",))), "categoria"
    )
    salida["especialidades_por_materia"] = lambda s, d: dim.conteo_por_clase(
        dim.dim_especialidades(casos(s, d, ("especialidad", "materia"))), "materia_asociada"
    )
    salida["rango_anios"] = lambda s, d: dim.rango_anios(casos(s, d, ("anio",)))
    salida["tipos_caso_frecuentes"] = lambda s, d: dim.mas_frecuentes(
        dim.dim_tipos_caso(casos(s, d, ("tipo_caso",))), "tipo_caso"
    )
    salida["fiscalias_por_area"] = lambda s, d: dim.conteo_por_clase(
        dim.dim_fiscalias_especializadas(casos(s, d, ("especializada",))), "area_especializacion"
    )
    salida["ubicaciones_por_region"] = lambda s, d: dim.conteo_por_clase(
        dim.dim_ubicaciones(casos(s, d, ("ubigeo_pjfs", "dpto_pjfs", "prov_pjfs", "dist_pjfs"))),
        "region_geografica",
    )
    salida["control_hechos"] = _control_hechos
    salida["almacen_incremental"] = _almacen_incremental
    salida["claves_duraderas"] = _claves_duraderas
    salida["vista_completa"] = _vista_completa
    salida["bosquejos_por_periodo"] = _bosquejos
    salida["dq_sembradas"] = _sembradas
    salida["dq_violaciones"] = _violaciones
    return salida


def _seis(df: DataFrame, *columnas: str) -> DataFrame:
    """Six decimals on floating-point columns, the precision results are compared at."""
    return df.withColumns({c: F.round(c, 6) for c in columnas})


def _consultas_limpieza() -> dict[str, Consulta]:
    lim = limpieza

    def limpia(s: SparkSession, d: str) -> DataFrame:
        return lim.limpiar(casos_sucios(s, d))

    return {
        "limpieza": limpia,
        "perfil_calidad": lambda s, d: lim.perfil_calidad(casos_sucios(s, d)),
        "perfil_categorico": lambda s, d: lim.perfil_categorico(limpia(s, d)),
        "top_valores": lambda s, d: lim.top_valores(limpia(s, d)),
        "perfil_numerico": lambda s, d: _seis(lim.perfil_numerico(limpia(s, d)), "media", "std"),
        "perfil_fechas": lambda s, d: lim.perfil_fechas(casos_sucios(s, d)),
        "cambios_texto": lambda s, d: lim.cambios_texto(
            lim.convertir_tipos(lim.quitar_duplicados(lim.limpiar_nulos(casos_sucios(s, d))))
        ),
        "reporte_limpieza": lambda s, d: lim.reporte_limpieza(casos_sucios(s, d)),
        "outliers_limpieza": lambda s, d: lim.outliers_limpieza(limpia(s, d)),
        "dispersion_zscore": lambda s, d: lim.dispersion_zscore(limpia(s, d)),
    }


def _pares(spark: SparkSession, d: str) -> DataFrame:
    return descriptiva.pares_medidas(casos(spark, d, _MEDIDAS))


def _consultas_descriptivas() -> dict[str, Consulta]:
    de = descriptiva
    matrices = {"pearson": de.correlacion_pearson, "spearman": de.correlacion_spearman}

    def fuertes(s: SparkSession, d: str) -> DataFrame:
        p = _pares(s, d)
        partes = [
            de.correlaciones_fuertes(_seis(m(p), "r")).withColumn("metodo", F.lit(n))
            for n, m in matrices.items()
        ]
        return partes[0].unionByName(partes[1])

    return {
        "resumen_inicial": lambda s, d: _seis(
            de.resumen_inicial(casos(s, d, ("anio", "distrito_fiscal", "materia", *_MEDIDAS))),
            "tasa_global_pct",
            "sin_ingreso_pct",
            "sin_atencion_pct",
            "sobreatendidos_pct",
        ),
        "resumen_general": lambda s, d: _seis(
            de.resumen_general(casos(s, d)), "tasa_atencion_global", "completitud_datos"
        ),
        "perfil_eda_numerico": lambda s, d: _seis(
            de.perfil_numerico(casos(s, d, ("anio", *_MEDIDAS))),
            "mean",
            "std",
            "coefficient_variation",
            "skewness",
            "kurtosis",
            "zeros_percentage",
            "missing_percentage",
            "normalidad_p",
            "concentracion_top10",
        ),
        "normalidad": lambda s, d: _seis(
            de.normalidad(casos(s, d, ("anio", *_MEDIDAS))).withColumn("jb", F.round("jb", 4)),
            "skewness",
            "kurtosis",
            "p_valor",
            "ks",
            "ks_p",
        ),
        "perfil_eda_categorico": lambda s, d: _seis(
            de.perfil_categorico(casos(s, d, ROLES.categoricas)),
            "missing_percentage",
            "mode_percentage",
            "entropy",
            "gini_concentration",
            "top_3_percentage",
        ),
        "metricas_eficiencia": lambda s, d: _seis(
            de.metricas_eficiencia(_pares(s, d)),
            "tasa_atencion_promedio",
            "tasa_atencion_mediana",
            "casos_eficiencia_perfecta_pct",
            "casos_baja_eficiencia_pct",
        ),
        "metricas_volumen": lambda s, d: _seis(
            de.metricas_volumen(casos(s, d, ("distrito_fiscal", "ingresado"))),
            "concentracion_top_10_distritos",
        ),
        "metricas_temporales": lambda s, d: _seis(
            de.metricas_temporales(casos(s, d, ("anio", *_MEDIDAS))).withColumns(
                {c: F.round(c, 4) for c in ("pendiente", "variabilidad_anual")}
            ),
            "r_cuadrado",
            "p_valor",
            "crecimiento_total",
        ),
        "correlacion_pearson": lambda s, d: _seis(de.correlacion_pearson(_pares(s, d)), "r"),
        "correlacion_spearman": lambda s, d: _seis(de.correlacion_spearman(_pares(s, d)), "r"),
        "correlaciones_fuertes": fuertes,
        "correlaciones_principales": lambda s, d: hallazgos.correlaciones_principales(
            _seis(de.correlacion_pearson(_pares(s, d)), "r")
        ),
        "mapa_correlacion": lambda s, d: _seis(
            de.triangulo_inferior(de.correlacion_pearson(_pares(s, d))), "r"
        ),
        "mapa_correlacion_spearman": lambda s, d: _seis(
            de.triangulo_inferior(de.correlacion_spearman(_pares(s, d))), "r"
        ),
    }


def _derivada(spark: SparkSession, d: str, *columnas: str) -> DataFrame:
    return derivar_metricas(casos(spark, d, (*columnas, *_MEDIDAS)))


def _redondear(df: DataFrame, decimales: int = 6) -> DataFrame:
    """Round every floating-point column."""
    return df.withColumns(
        {c: F.round(c, decimales) for c, t in df.dtypes if t in ("double", "float")}
    )


def _consultas_patrones() -> dict[str, Consulta]:
    pa = patrones
    por_filas = {
        "concentracion_departamental": (pa.concentracion_departamental, ("dpto_pjfs",)),
        "disparidad_departamental": (pa.disparidad_departamental, ("dpto_pjfs",)),
        "anios_atipicos": (pa.anios_atipicos, ("anio",)),
        "estadisticas_anuales": (pa.estadisticas_anuales, ("anio",)),
        "dominancia_materia": (pa.dominancia_materia, ("materia",)),
        "eficiencia_tipo_fiscalia": (pa.eficiencia_tipo_fiscalia, ("tipo_fiscalia",)),
        "efecto_especializacion": (pa.efecto_especializacion, ("especializada",)),
    }
    salida: dict[str, Consulta] = {
        nombre: (lambda s, d, f=f, cols=cols: _redondear(f(_derivada(s, d, *cols))))
        for nombre, (f, cols) in por_filas.items()
    }
    salida["sesgo_temporal"] = lambda s, d: _redondear(
        pa.sesgo_temporal(_derivada(s, d, "anio")).withColumn("pendiente", F.round("pendiente", 4))
    )
    salida["anomalias"] = lambda s, d: _redondear(pa.anomalias(_pares(s, d)))
    salida["filas_anomalas"] = lambda s, d: pa.filas_anomalas(
        casos(s, d, ("anio", "distrito_fiscal", "materia", *_MEDIDAS))
    )
    return salida


def _consultas_atipicos() -> dict[str, Consulta]:
    at = atipicos
    numericas = ("anio", *_MEDIDAS)
    return {
        "outliers_iqr": lambda s, d: _redondear(at.outliers_iqr(casos(s, d, numericas))),
        "outliers_mad": lambda s, d: _redondear(at.outliers_mad(casos(s, d, numericas))),
        "outliers_resumen": lambda s, d: _redondear(at.resumen_univariado(_pares(s, d))),
        "outliers_contextuales": lambda s, d: _redondear(at.outliers_contextuales(_pares(s, d))),
        "casos_contextuales": lambda s, d: _redondear(
            at.casos_contextuales(
                _derivada(s, d, "distrito_fiscal", "materia", "especializada"), _pares(s, d)
            )
        ),
    }


def _consultas_graficas() -> dict[str, Consulta]:
    gr = graficos
    sobre_pares = {
        "histograma": gr.histograma,
        "marcadores_histograma": gr.marcadores,
        "boxplot": gr.boxplot,
        "boxplot_p99": gr.boxplot_p99,
        "forma_distribucion": gr.forma,
        "categorias_eficiencia": gr.categorias_eficiencia,
        "recta_registros": gr.recta_registros,
        "dispersion_registros": gr.dispersion_registros,
    }
    sobre_filas = {
        "boxplot_anual": (gr.boxplot_anual, ("anio",)),
        "participacion_materia": (lambda df: gr.participacion(df, "materia"), ("materia",)),
        "participacion_tipo_fiscalia": (
            lambda df: gr.participacion(df, "tipo_fiscalia"),
            ("tipo_fiscalia",),
        ),
        "top_distritos": (gr.top_distritos, ("distrito_fiscal",)),
        "tasa_departamento": (gr.tasa_departamento, ("dpto_pjfs",)),
        "participacion_departamentos": (gr.participacion_departamentos, ("dpto_pjfs",)),
        "dispersion_distrito": (gr.dispersion_distrito, ("distrito_fiscal",)),
        "resumen_geografico": (gr.resumen_geografico, ("distrito_fiscal", "dpto_pjfs")),
        "evolucion_anual": (descriptiva.evolucion_anual, ("anio",)),
        "pivot_anio_materia": (gr.pivot_anio_materia, ("anio", "materia")),
        "variacion_anual": (gr.variacion_anual, ("anio",)),
        "resumen_periodo": (gr.resumen_periodo, ("anio",)),
        "eficiencia_materia": (gr.eficiencia_materia, ("materia",)),
        "barras_tipo_fiscalia": (gr.barras_tipo_fiscalia, ("tipo_fiscalia",)),
    }
    salida: dict[str, Consulta] = {
        nombre: (lambda s, d, f=f: _redondear(f(_pares(s, d)))) for nombre, f in sobre_pares.items()
    }
    salida |= {
        nombre: (lambda s, d, f=f, cols=cols: _redondear(f(_derivada(s, d, *cols))))
        for nombre, (f, cols) in sobre_filas.items()
    }
    salida["kde"] = lambda s, d: _seis(
        gr.kde(_pares(s, d)).withColumn("densidad", F.round("densidad", 9)), "x"
    )
    salida["regresion_distrito"] = lambda s, d: _seis(
        gr.regresion_distrito(casos(s, d, ("distrito_fiscal", *_MEDIDAS))).withColumn(
            "pendiente", F.round("pendiente", 12)
        ),
        "intercepto",
        "r",
        "r_cuadrado",
    )
    salida["regresion_registros"] = lambda s, d: _seis(
        gr.regresion_registros(_pares(s, d)).withColumn("pendiente", F.round("pendiente", 9)),
        "intercepto",
        "r",
        "r_cuadrado",
    )
    return salida


def _consultas_modelos() -> dict[str, Consulta]:
    """Seeded models and the findings."""

    def marcados(s: SparkSession, d: str) -> DataFrame:
        return bosque.marcar_multivariados(_pares(s, d))

    return {
        "clusters_perfil": lambda s, d: _redondear(grupos.clusters_perfil(_pares(s, d))),
        "outliers_multivariados": lambda s, d: _redondear(bosque.outliers_multivariados(marcados(s, d))),
        "casos_multivariados": lambda s, d: bosque.casos_multivariados(
            casos(s, d, ("distrito_fiscal", "materia", *_MEDIDAS)), marcados(s, d)
        ),
        "dispersion_multivariada": lambda s, d: _redondear(bosque.dispersion_multivariada(marcados(s, d))),
        "hallazgos": lambda s, d: _redondear(
            hallazgos.hallazgos(
                casos(
                    s,
                    d,
                    (
                        "anio",
                        "distrito_fiscal",
                        "dpto_pjfs",
                        "materia",
                        "especializada",
                        *_MEDIDAS,
                    ),
                )
            )
        ),
    }


def _consultas_publicadas() -> dict[str, Consulta]:
    """Rules on names and extreme measures, over rows that reach every branch."""
    dim, at, pa = dimensiones, atipicos, patrones

    def pares(s: SparkSession, d: str) -> DataFrame:
        return descriptiva.pares_medidas(casos_publicados(s, d, _MEDIDAS))

    def fuente(f: Callable[[DataFrame], DataFrame], *columnas: str) -> Consulta:
        return lambda s, d: f(casos_publicados(s, d, columnas))

    lugar = ("ubigeo_pjfs", "dpto_pjfs", "prov_pjfs", "dist_pjfs")
    base = {
        "dim_tipos_caso": fuente(dim.dim_tipos_caso, "tipo_caso"),
        "tipos_caso_por_categoria": fuente(lambda df: dim.conteo_por_clase(dim.dim_tipos_caso(df), "categoria"), "tipo_caso"),
        "dim_fiscalias_especializadas": fuente(dim.dim_fiscalias_especializadas, "especializada"),
        "fiscalias_por_area": fuente(
            lambda df: dim.conteo_por_clase(dim.dim_fiscalias_especializadas(df), "area_especializacion"), "especializada"
        ),
        "dim_ubicaciones": fuente(lambda df: dim.dim_ubicaciones(df).drop("registros"), *lugar),
        "ubicaciones_por_region": fuente(lambda df: dim.conteo_por_clase(dim.dim_ubicaciones(df), "region_geografica"), *lugar),
        "dim_tipos_fiscalia": fuente(dim.dim_tipos_fiscalia, "tipo_fiscalia"),
        "filas_anomalas": fuente(pa.filas_anomalas, "anio", "distrito_fiscal", "materia", *_MEDIDAS),
        "anomalias": lambda s, d: _redondear(pa.anomalias(pares(s, d))),
        "outliers_contextuales": lambda s, d: _redondear(at.outliers_contextuales(pares(s, d))),
        "casos_contextuales": lambda s, d: _redondear(
            at.casos_contextuales(
                derivar_metricas(casos_publicados(s, d, ("distrito_fiscal", "materia", "especializada", *_MEDIDAS))), pares(s, d)
            )
        ),
    }
    return {f"{nombre}_publicados": f for nombre, f in base.items()}


def consultas() -> dict[str, Consulta]:
    return {
        **_consultas_publicadas(),
        **_consultas_informes(),
        **_consultas_dimension(),
        **_consultas_limpieza(),
        **_consultas_descriptivas(),
        **_consultas_patrones(),
        **_consultas_atipicos(),
        **_consultas_graficas(),
        **_consultas_modelos(),
    }
