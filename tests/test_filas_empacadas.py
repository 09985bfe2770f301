"""What the cleaning report moves: packed rows, and lines no more often than lookups need."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from balanza.esquema import esquema_crudo
from balanza.operators import limpieza as lim
from balanza.sesion import se_difunde
from balanza.sources import demo
from tests.test_limpieza import BASE


@pytest.fixture
def sin_difusion(spark):
    antes = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", antes)


def inicial(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()


def bajo(lineas, i):
    """The lines of a plan below line i."""
    hondo = lambda x: len(x) - len(x.lstrip(" :+-"))
    return list(itertools.takewhile(lambda x: hondo(x) > hondo(lineas[i]), lineas[i + 1 :]))


def test_celdas_vuelven_como_eran(spark):
    celdas = [None, "", "a", "\x1e", "\x1f", "\x1e0", "\x1e1", "\x1e2", "\x1f\x1e", "ñ\x1f", "a\x1f\x1f"]
    filas = list(itertools.product(celdas, repeat=3))
    df = spark.createDataFrame(filas, "x string, y string, z string")
    juntas = df.select(lim.empacar(["x", "y", "z"]).alias("p"))
    assert juntas.distinct().count() == len(filas)
    assert {tuple(r) for r in lim.desempacar(juntas, "p", ["x", "y", "z"]).collect()} == set(filas)


def test_celdas_que_no_son_utf8(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int").select(
        F.when(F.col("n") == 1, F.unhex(F.lit("61FF"))).otherwise(F.unhex(F.lit("61FE"))).cast("string").alias("x"), F.lit("b").alias("y")
    )
    otra = lim.desempacar(df.select(lim.empacar(["x", "y"]).alias("p")), "p", ["x", "y"])
    hexa = lambda d: {tuple(r) for r in d.select(F.hex(F.col("x").cast("binary")), "y").collect()}
    assert hexa(otra) == hexa(df) == {("61FF", "b"), ("61FE", "b")}


def test_filas_enteras_se_mueven_como_un_texto(spark):
    df = lim.reporte_limpieza(spark.createDataFrame([BASE, BASE, {**BASE, "anio": None}], esquema_crudo()))
    entera = next(x for x in inicial(df) if "Exchange hashpartitioning" in x and "distrito_fiscal" in x)
    claves = entera.split("hashpartitioning(")[1].split(")")[0].split(", ")
    assert len(claves) == 2  # the packed row and the number of partitions
    assert df.filter("anio = 2019").first()["filas_originales"] == 2


def test_columnas_con_tipo_son_claves_propias(spark):
    texto = spark.createDataFrame([BASE, BASE, {**BASE, "materia": "B", "atendido": "0"}], esquema_crudo())
    con_tipo = texto.withColumns({c: F.col(c).cast("int") for c in ("anio", "ubigeo_pjfs")})
    a, b = (lim.reporte_limpieza(d).orderBy("anio").collect() for d in (texto, con_tipo))
    assert a == b and a[-1]["filas_finales"] == 2


def test_clientes_se_buscan_desde_las_ordenes(spark, sin_difusion):
    plan = inicial(demo.casos_sucios(spark, "/root/testdata/sf0.001"))
    por_cliente = [i for i, x in enumerate(plan) if "Exchange hashpartitioning(o_custkey" in x]
    assert por_cliente and not any("l_orderkey" in x for i in por_cliente for x in bajo(plan, i))
    lineas = [i for i, x in enumerate(plan) if "Exchange hashpartitioning" in x and any("l_quantity" in y for y in bajo(plan, i))]
    # Lines move for parts, orders, suppliers and, without any broadcast, nations.
    assert len(lineas) == 4


def test_busquedas_con_claves_repetidas_y_nulas(spark, tmp_path):
    def tabla(nombre, filas, esquema):
        spark.createDataFrame(filas, esquema).write.parquet(f"{tmp_path}/{nombre}.parquet")

    d = dt.datetime(1995, 3, 4)
    tabla(
        "lineitem",
        [(k, p, s, 1, 10.0, 0.1, "A", d) for k, p, s in ((1, 1, 1), (1, 2, None), (2, 1, 1), (3, None, 2), (None, 1, 1), (9, 9, 9))],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp",
    )
    tabla("orders", [(1, 1, d, "X"), (1, 2, d, "Y"), (2, None, d, "X"), (3, 7, d, None), (None, 1, d, "Z")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    tabla("customer", [(1, "AUTO"), (1, "HOME"), (2, None), (None, "LOST")], "c_custkey long, c_mktsegment string")
    tabla("part", [(1, "T", "B"), (1, "T", "C"), (None, "N", "N")], "p_partkey long, p_type string, p_brand string")
    tabla("supplier", [(1, "S", 0), (2, "R", None), (None, "N", 0)], "s_suppkey long, s_name string, s_nationkey int")
    tabla("nation", [(0, "PERU", 0), (0, "CHILE", 1), (None, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    tabla("region", [(0, "AMERICA"), (None, "N")], "r_regionkey int, r_name string")
    dada = demo.casos(spark, str(tmp_path), (*demo.TODAS, "clave_orden"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        movida = demo.casos(spark, str(tmp_path), (*demo.TODAS, "clave_orden"))
        a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (dada, movida))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Order 1 stands twice, once with a customer that stands twice: lines of it come three times; parts and nations double them.
    assert a == b and len(a) == 3 * 4 + 3 + 4 + 1 + 4 + 1


def test_se_difunde_por_la_medida_de_spark(spark, sin_difusion):
    df = demo.leer_tabla(spark, "/root/testdata/sf0.001", "nation")
    assert not se_difunde(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert se_difunde(df)
