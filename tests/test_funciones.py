"""Literal cases for the column functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from balanza.esquema import SENTINELA
from balanza.functions import clases, estadistica, redondeo, tasas, texto


def valores(spark, filas, esquema, expr):
    df = spark.createDataFrame(filas, esquema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_tramos_cerrados_a_la_derecha(spark):
    v = valores(
        spark,
        [(0.0,), (10.0,), (10.5,), (50.0,), (1000.0,), (1001.0,), (None,)],
        "x double",
        clases.clase_volumen_fila(F.col("x")),
    )
    assert v == [None, "Muy Bajo", "Bajo", "Bajo", "Alto", "Muy Alto", None]


def test_tramos_de_eficiencia(spark):
    v = valores(
        spark,
        [(0.0,), (0.5,), (0.8,), (1.0,), (1.2,), (1.3,), (None,)],
        "x double",
        clases.clase_eficiencia_fila(F.col("x")),
    )
    assert v == [
        None,
        "Muy Baja (<0.5)",
        "Baja (0.5-0.8)",
        "Buena (0.8-1.0)",
        "Excelente (1.0-1.2)",
        "Excepcional (>1.2)",
        None,
    ]


def test_dos_tasas(spark):
    df = spark.createDataFrame([(0, 0), (3, 2), (8, 8)], "i int, a int")
    r = df.select(
        tasas.tasa_nula(F.col("i"), F.col("a")), tasas.tasa_almacen(F.col("i"), F.col("a"))
    ).collect()
    assert [x[0] for x in r] == [None, 2 / 3, 1.0]
    assert [str(x[1]) for x in r] == ["0.0000", "0.6667", "1.0000"]


def test_redondeo_exacto_no_desborda(spark):
    grande = 4 * 10**17
    df = spark.createDataFrame([(grande // 2, grande), (1, 8), (1, 0)], "a long, b long")
    r = df.select(redondeo.razon(F.col("a"), F.col("b")), redondeo.porcentaje(F.col("a"), F.col("b")))
    assert [tuple(x) for x in r.collect()] == [(0.5, 50.0), (0.125, 12.5), (0.0, None)]


def test_variacion_con_signo(spark):
    df = spark.createDataFrame([(5, 8), (8, 5), (5, 0), (5, None)], "a long, b long")
    v = [r[0] for r in df.select(redondeo.variacion(F.col("a"), F.col("b"))).collect()]
    assert v == [-37.5, 60.0, None, None]


def test_coercion_numerica(spark):
    filas = [(x,) for x in ("12.7", "x", " ", "-3", "1e3", " 7 ", "NaN", "inf", "5d", None)]
    e = F.greatest(texto.a_entero(texto.a_numero(F.col("s"))), F.lit(0))
    assert valores(spark, filas, "s string", e) == [12, 0, 0, 0, 1000, 7, 0, 0, 0, 0]


def test_fechas_en_varios_formatos(spark):
    filas = [("31/01/2024",), ("2024-01-31",), ("20240131",), ("sin fecha",), (None,)]
    v = valores(spark, filas, "s string", texto.a_fecha(F.col("s")).cast("date").cast("string"))
    assert v == ["2024-01-31"] * 3 + [None, None]


def test_especializada_vacia(spark):
    filas = [(x,) for x in (None, "", "   ", ",,", ",,,,", "na", " None ", "null", "nan", "\tturismo ")]
    v = valores(spark, filas, "s string", texto.normalizar_especializada(F.col("s")))
    assert v == [SENTINELA] * 9 + ["TURISMO"]


def test_limpiar_texto_quita_todo_espacio(spark):
    v = valores(spark, [("\t  lima \n",)], "s string", texto.limpiar_texto(F.col("s")))
    assert v == ["LIMA"]


@pytest.mark.parametrize(
    "nombre,esperada",
    [
        ("APELACION DENUNCIA", "INGRESO"),
        ("APELACION EXPEDIENTE", "RECURSO"),
        ("QUEJAS", "RECURSO"),
        ("PROCESO CIVIL", "PROCESO_FORMAL"),
        ("CONSULTAS", "PROCESO_GENERAL"),
        ("INVESTIGACION PREVENTIVA", "PROCESO_GENERAL"),
    ],
)
def test_categoria(spark, nombre, esperada):
    assert valores(spark, [(nombre,)], "s string", clases.categoria_caso(F.col("s"))) == [esperada]


@pytest.mark.parametrize(
    "nombre,esperada",
    [
        ("DELITOS DE CIBERDELINCUENCIA", "General"),
        ("DELITOS DE TRAFICO ILICITO DE DROGAS", "Trafico ilicito de drogas"),
        ("DELITOS DE CORRUPCION DE FUNCIONARIOS", "Anticorrupción"),
        ("CONTRA LA CRIMINALIDAD ORGANIZADA", "Crimen Organizado"),
        ("DELITOS ADUANEROS Y CONTRA LA PROPIEDAD INTELECTUAL", "Propiedad Intelectual"),
        ("DELITOS DE TRATA DE PERSONAS", "Trata de Personas"),
        ("LAVADO DE ACTIVOS Y PERDIDA DE DOMINIO", "Lavado de Activos"),
        ("MATERIA AMBIENTAL", "Medio Ambiente"),
        ("TRANSITO Y SEGURIDAD VIAL", "Tránsito y Seguridad Vial"),
        ("DELITOS TRIBUTARIOS", "Tributario"),
        ("TURISMO", "Turismo"),
        ("VIOLENCIA CONTRA LA MUJER Y LOS INTEGRANTES DEL GRUPO FAMILIAR", "Violencia de Género"),
        (SENTINELA, "General"),
    ],
)
def test_area(spark, nombre, esperada):
    v = valores(spark, [(nombre,)], "s string", clases.area_especializacion(F.col("s")))
    assert v == [esperada]


def test_region_y_nivel(spark):
    df = spark.createDataFrame(
        [("CALLAO", "SUPREMA"), ("Huanuco", "superior"), ("TACNA", "PROVINCIAL"), ("X", "OTRA")],
        "d string, t string",
    )
    r = df.select(clases.region_geografica(F.col("d")), clases.nivel_jerarquico(F.col("t"))).collect()
    assert [tuple(x) for x in r] == [
        ("CENTRO", 1),
        ("SELVA", 2),
        ("SUR", 3),
        ("REGION_NO_CLASIFICADA", 4),
    ]


def test_p_valor_dorado(spark):
    df = spark.createDataFrame(
        [
            (0.22076786665288647, 5),
            (0.2839222044305549, 5),
            (1.0, 5),
            (0.5, 2),
            (0.25, 4),
            (0.25, 3),
            (None, 5),
        ],
        "r double, n int",
    )
    p = [r[0] for r in df.select(estadistica.p_valor_pendiente(F.col("r"), F.col("n"))).collect()]
    assert p[0] == pytest.approx(0.42456206337591756, abs=1e-12)
    assert p[1] == pytest.approx(0.3551953179341912, abs=1e-12)
    assert p[2] == 0.0 and p[3] is None and p[6] is None
    # two degrees of freedom: p = 1 - |r|; one: 1 - 2/pi * asin(|r|)
    assert p[4] == pytest.approx(0.5, abs=1e-12)
    assert p[5] == pytest.approx(1 - 2 / math.pi * math.asin(0.5), abs=1e-12)


def test_jarque_bera(spark):
    df = spark.createDataFrame([(100, 0.5, 1.0)], "n long, s double, k double")
    jb = estadistica.jarque_bera(F.col("n"), F.col("s"), F.col("k"))
    r = df.select(jb, estadistica.p_jarque_bera(jb)).first()
    assert r[0] == pytest.approx(100 / 6 * (0.25 + 0.25))
    assert r[1] == pytest.approx(math.exp(-r[0] / 2))


def test_normal_acumulada_y_cola_de_lilliefors(spark):
    import math

    from balanza.functions.estadistica import normal_acumulada, p_lilliefors

    zs = [x / 10 for x in range(-50, 51)]
    r = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_acumulada(F.col("z")).alias("f")).collect()
    assert all(abs(x["f"] - 0.5 * math.erfc(-x["z"] / math.sqrt(2))) < 1e-6 for x in r)
    # Critical values of the published table: (n, distance, level).
    tabla = [(20, 0.192, 0.05), (30, 0.159, 0.05), (100, 0.0886, 0.05), (400, 0.0443, 0.05), (30, 0.185, 0.01), (25, 0.1602, 0.1)]
    r = spark.createDataFrame(tabla, "n long, d double, p double").select("p", p_lilliefors(F.col("d"), F.col("n")).alias("q")).collect()
    assert all(abs(x["q"] - x["p"]) < 0.25 * x["p"] for x in r)
    extremos = spark.createDataFrame([(50, 0.01), (50, 0.6), (5000, 0.3)], "n long, d double").select(p_lilliefors(F.col("d"), F.col("n")).alias("q")).collect()
    assert extremos[0]["q"] == 1.0 and extremos[1]["q"] < 1e-6 and extremos[2]["q"] < 1e-6


def test_normalidad_de_muestras(spark):
    import random

    from balanza.operators.descriptiva import normalidad

    rng = random.Random(6)
    filas = [(rng.gauss(100, 15), rng.expovariate(0.1), 7.0) for _ in range(2000)]
    r = {x["variable"]: x for x in normalidad(spark.createDataFrame(filas, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert r["a"]["es_normal_ks"] and r["a"]["ks"] < 0.03
    assert not r["b"]["es_normal_ks"] and r["b"]["ks_p"] < 1e-6
    assert r["c"]["ks"] is None and r["c"]["ks_p"] is None
