"""Statistics, patterns, models and the whole exploratory run on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from balanza.functions.tasas import derivar_metricas
from balanza.operators import atipicos, bosque, descriptiva, graficos, grupos, hallazgos, patrones
from balanza.plans import eda
from balanza.sources.demo import casos
from tests.conftest import DATOS


@pytest.fixture(scope="module")
def pares(spark):
    return descriptiva.pares_medidas(casos(spark, DATOS, ("ingresado", "atendido")))


def test_modo_con_empate_es_el_menor(spark):
    df = spark.createDataFrame([(x,) for x in (3, 1, 1, 3, 2)], "anio int")
    assert descriptiva.perfil_numerico(df, ["anio"]).first()["mode"] == 1
    t = spark.createDataFrame([(x,) for x in "baab"], "materia string")
    r = descriptiva.perfil_categorico(t, ["materia"]).first()
    assert (r["mode"], r["top_3_values"]) == ("a", "a: 2; b: 2")


def test_spearman_con_empates(spark):
    df = spark.createDataFrame(
        list(zip([1, 2, 2, 3, 9], [5, 4, 7, 1, 2])), "ingresado int, atendido int"
    )
    p = descriptiva.pares_medidas(df)
    r = {(x["var1"], x["var2"]): x["r"] for x in descriptiva.correlacion_spearman(p).collect()}
    assert r["ingresado", "atendido"] == pytest.approx(-0.7181848464596079)
    assert len(r) == 16


def test_identidades(spark, pares):
    e = descriptiva.perfil_categorico(casos(spark, DATOS, ("materia", "tipo_caso")), ["materia", "tipo_caso"])
    import math

    for r in e.collect():
        assert 0 <= r["gini_concentration"] < 1
        assert r["entropy"] <= math.log(r["unique_values"]) + 1e-9
    h = graficos.histograma(pares).groupBy("variable").agg(F.sum("frecuencia").alias("n"))
    total = pares.agg(F.sum("n")).first()[0]
    assert {r["variable"]: r["n"] for r in h.collect()}["ingresado"] == total
    c = graficos.categorias_eficiencia(pares).agg(F.sum("porcentaje")).first()[0]
    assert c == pytest.approx(100)


def test_tasa_cero_no_tiene_categoria(spark):
    df = spark.createDataFrame([(4, 0), (4, 4), (0, 0)], "ingresado int, atendido int")
    r = graficos.categorias_eficiencia(descriptiva.pares_medidas(df)).collect()
    assert [(x["categoria"], x["registros"]) for x in r] == [("Buena (0.8-1.0)", 1)]


def test_mad_cero_se_omite(spark):
    df = spark.createDataFrame([(1,)] * 12 + [(9,)], "ingresado int")
    assert atipicos.outliers_mad(df, ["ingresado"]).count() == 0
    r = atipicos.outliers_iqr(df, ["ingresado"]).first()
    assert (r["conteo"], r["valores_extremos"]) == (1, "9")


def test_pocos_valores_no_se_analizan(spark):
    df = spark.createDataFrame([(1,)] * 9, "ingresado int")
    assert atipicos.outliers_iqr(df, ["ingresado"]).count() == 0


def test_cinco_anios_nunca_atipicos(spark):
    df = spark.createDataFrame([(2019 + i, 10**i) for i in range(5)], "anio int, ingresado int")
    assert not any(r["es_atipico"] for r in patrones.anios_atipicos(df).collect())


def test_anomalias_sembradas(spark):
    df = spark.createDataFrame([(10, 16), (10, 15), (5, 0), (0, 0), (0, 1)], "ingresado int, atendido int")
    r = patrones.anomalias(descriptiva.pares_medidas(df)).first()
    assert (r["total_anomalias"], r["sobre_atencion_extrema"], r["sin_atencion_con_casos"]) == (3, 2, 1)
    assert patrones.filas_anomalas(df).count() == 3


def test_volumen_muy_bajo_incluye_cero(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("b", 11)], "distrito_fiscal string, ingresado int")
    r = descriptiva.metricas_volumen(df).first()
    assert (r["muy_bajo"], r["casos_bajo_volumen"], r["bajo"]) == (1, 2, 1)


def test_bosque_encuentra_lo_sembrado(spark):
    filas = [(100 + i % 37, 90 + i % 29) for i in range(2000)] + [(90_000, 10), (80_000, 79_000)]
    df = spark.createDataFrame(filas, "ingresado int, atendido int")
    p = descriptiva.pares_medidas(df)
    m = bosque.marcar_multivariados(p)
    malos = {(r["ingresado"], r["atendido"]) for r in m.filter("es_outlier").collect()}
    assert {(90_000, 10), (80_000, 79_000)} <= malos
    r = bosque.outliers_multivariados(m).first()
    assert 0 < r["porcentaje"] <= 5
    otra = bosque.marcar_multivariados(p)
    assert sorted(x["puntaje"] for x in m.collect()) == sorted(x["puntaje"] for x in otra.collect())
    con_nombres = df.withColumns({"distrito_fiscal": F.lit("d"), "materia": F.lit("m")})
    assert bosque.casos_multivariados(con_nombres, m).first()["ingresado"] == 90_000


def test_bosque_muestra_filas_sin_repetir(spark, pares):
    validos = pares.filter("tasa_atencion is not null")
    n = validos.agg(F.sum("n")).first()[0]
    m = bosque.muestras(validos, n, 5, 256, 1)
    assert {r["count"] for r in m.groupBy("arbol").count().collect()} == {256}
    # drawing every row gives back the table itself
    todo = bosque.muestras(validos, n, 1, n, 1).groupBy("ingresado", "atendido").count()
    falta = todo.join(
        validos.select(F.col("ingresado").cast("double"), F.col("atendido").cast("double"), "n"),
        ["ingresado", "atendido"],
    ).filter("count != n")
    assert falta.count() == 0 and todo.count() == validos.count()


def test_pocas_filas_sin_modelo(spark):
    p = descriptiva.pares_medidas(spark.createDataFrame([(1, 1)], "ingresado int, atendido int"))
    assert bosque.marcar_multivariados(p) is None
    assert grupos.clusters_perfil(p) is None


def test_grupos_separados(spark):
    filas = [(10 + i % 5, 9 + i % 5) for i in range(200)] + [(9000 + i, 100 + i) for i in range(100)]
    df = spark.createDataFrame(filas, "ingresado int, atendido int")
    r = grupos.clusters_perfil(descriptiva.pares_medidas(df), reinicios=2).collect()
    assert len(r) == r[0]["numero_clusters_optimo"] == 2
    assert sorted(x["tamano"] for x in r) == [100, 200]
    assert r[0]["silhouette_score"] > 0.9
    alto = max(r, key=lambda x: x["ingresado_media"])
    assert alto["caracteristica_eficiencia"] == "Baja eficiencia"


def test_reglas(spark):
    m = spark.createDataFrame(
        [("resumen.tasa_atencion_global", 0.5), ("numerica.ingresado.skewness", -2.0)],
        "metrica string, valor double",
    )
    r = {x["regla"]: x for x in hallazgos.evaluar(m).collect()}
    assert r["tasa_global"]["cumple"] is False and "baja" in r["tasa_global"]["texto"]
    assert r["asimetria_ingresado"]["cumple"] is True
    assert len(r) == 2


def test_columnas_derivadas(spark):
    df = spark.createDataFrame([(0, 0, "NO_TIPO_ESPECIALIZADA"), (4, 4, "TURISMO")], "ingresado int, atendido int, especializada string")
    a, b = derivar_metricas(df).collect()
    assert (a["tasa_atencion"], a["eficiencia_perfecta"], a["tiene_especializacion"]) == (None, 1, 0)
    assert (a["especializada_limpia"], a["casos_sin_ingreso"]) == ("Sin Especialización", 1)
    assert (b["tasa_atencion"], b["volumen_ingresado"], b["especializada_limpia"]) == (1.0, "Muy Bajo", "TURISMO")


def test_analisis_completo_en_disco(spark, tmp_path):
    limpio = f"{tmp_path}/limpio"
    casos(spark, DATOS).drop("region_geografica").write.parquet(limpio)
    ruta = eda.ejecutar_analisis(spark, limpio, str(tmp_path), dt.datetime(2025, 1, 2, 3, 4, 5), reinicios=1)
    assert ruta.endswith("resultados_eda_20250102_030405")
    r = spark.read.json(ruta)
    secciones = {x[0] for x in r.select("seccion").distinct().collect()}
    assert {"resumen_general", "variables_numericas", "agrupaciones", "hallazgos", "kde"} <= secciones
    n = r.filter("seccion = 'resumen_general' and metrica = 'total_registros'").first()["valor_num"]
    assert n == casos(spark, DATOS, ("ingresado",)).count()


def test_matriz_sin_pares_completos(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 3)], "ingresado int, atendido int")
    r = {(x["var1"], x["var2"]): x["r"] for x in descriptiva.correlacion_pearson(descriptiva.pares_medidas(df)).collect()}
    assert len(r) == 16
    assert r["tasa_atencion", "atendido"] is None and r["atendido", "atendido"] == pytest.approx(1)
