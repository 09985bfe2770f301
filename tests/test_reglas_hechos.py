"""The constraint check reads a fact whose lookups ran once."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.operators import dimensiones, estrella
from balanza.plans.catalogo import consultas
from balanza.sources.demo import casos
from tests.conftest import DATOS


def test_busquedas_una_vez(spark, monkeypatch):
    veces = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def contado(x):
        veces.add(1)
        return x

    original = estrella.construir_hechos
    c = "casos_ingresados"
    monkeypatch.setattr(estrella, "construir_hechos", lambda *a: original(*a).withColumn(c, contado.asNondeterministic()(c)))
    assert consultas()["dq_sembradas"](spark, DATOS).filter("violaciones > 0").count() > 10
    assert veces.value == casos(spark, DATOS, ("ingresado",)).count()


def test_claves_compactas_suman_las_filas(spark):
    df = casos(spark, DATOS)
    n = df.count()
    tablas = dimensiones.compactar(df)
    assert set(tablas) == {"tipo_caso", "especializada", "especialidad", "lugar", "tipo_fiscalia", "tiempo"}
    for t, g in tablas.items():
        assert g.agg(F.sum(dimensiones.PESO)).first()[0] == n, t
    por_tipo = {x[0]: x[1] for x in df.groupBy("tipo_caso").count().collect()}
    assert {x[0]: x[1] for x in tablas["tipo_caso"].groupBy("tipo_caso").agg(F.sum(dimensiones.PESO)).collect()} == por_tipo
