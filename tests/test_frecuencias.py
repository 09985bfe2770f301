"""Ordering primitives against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from balanza.operators import frecuencias as fr
from balanza.operators.estrella import con_clave


def cuantil(xs, p):
    xs = sorted(xs)
    h = (len(xs) - 1) * p
    i = int(h)
    j = min(i + 1, len(xs) - 1)
    return xs[i] + (xs[j] - xs[i]) * (h - i)


def gini(xs):
    xs, n = sorted(xs), len(xs)
    return 2 * sum((i + 1) * x for i, x in enumerate(xs)) / (n * sum(xs)) - (n + 1) / n


@pytest.fixture(scope="module")
def datos():
    rng = random.Random(3)
    filas = []
    # One group holds most rows; values are ties, tiny fractions, huge and negative numbers.
    for _ in range(3000):
        g = "a" if rng.random() < 0.7 else rng.choice("bcd")
        x = rng.choice([0.0, 1.0, float(rng.randint(-50, 50)), rng.random(), rng.random() * 1e12])
        filas.append((g, x))
    filas += [(None, 2.0), (None, 3.0), ("a", None)]
    return filas


def test_acumular(spark, datos):
    df = spark.createDataFrame(datos, "g string, valor double")
    acc = fr.acumular(fr.tabla(df, ["g", "valor"]), ["g"]).collect()
    for g in {g for g, _ in datos}:
        xs = [x for k, x in datos if k == g and x is not None]
        c = Counter(xs)
        filas = {r["valor"]: r for r in acc if r["g"] == g}
        assert len(filas) == len(c)
        antes = 0
        for orden, v in enumerate(sorted(c), 1):
            r = filas[v]
            assert (r["previos"], r["orden"], r["n"]) == (antes, orden, c[v])
            assert (r["total"], r["total_valores"]) == (len(xs), len(c))
            antes += c[v]


def test_cuantiles_y_gini(spark, datos):
    pos = [(g, abs(x)) for g, x in datos if x is not None]
    df = spark.createDataFrame(pos, "g string, valor double")
    acc = fr.acumular(fr.tabla(df, ["g", "valor"]), ["g"])
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    r = acc.groupBy("g").agg(
        *[fr.cuantil_agregado(p).alias(a) for a, p in probs.items()],
        fr.gini_agregado().alias("gini"),
    )
    for fila in r.collect():
        xs = [x for g, x in pos if g == fila["g"]]
        for a, p in probs.items():
            assert fila[a] == pytest.approx(cuantil(xs, p), rel=1e-9, abs=1e-12)
        assert fila["gini"] == pytest.approx(gini(xs), rel=1e-9)


def test_rangos_densos(spark):
    filas = [("x", 5, 0.1), ("x", 5, None), ("x", 9, 0.3), ("y", 1, None), ("y", 2, 0.2), (None, 7, 0.5)]
    df = spark.createDataFrame(filas, "g string, a long, b double")
    r = fr.rangos_densos(df, {"ra": ("a", True), "rb": ("b", False)}, ["g"])
    obtenido = {(x["g"], x["a"], x["b"]): (x["ra"], x["rb"]) for x in r.collect()}
    assert obtenido == {
        ("x", 5, 0.1): (2, 1),
        ("x", 5, None): (2, 3),
        ("x", 9, 0.3): (1, 2),
        ("y", 1, None): (2, 2),
        ("y", 2, 0.2): (1, 1),
        (None, 7, 0.5): (1, 1),
    }


def test_rango_ascendente_deja_nulos_al_final(spark):
    df = spark.createDataFrame([(0.1,), (None,)], "c double")
    r = fr.rangos_densos(df, {"k": ("c", False)}).collect()
    assert {x["c"]: x["k"] for x in r} == {0.1: 1, None: 2}


def test_claves_sustitutas(spark):
    df = spark.createDataFrame([(f"n{i:04d}",) for i in range(2000)], "nombre string")
    r = con_clave(df, "id", ["nombre"]).collect()
    assert sorted(x["id"] for x in r) == list(range(1, 2001))
    assert len({x["nombre"] for x in r}) == 2000


def test_momentos_dorados(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 20)], "v double")
    freq = fr.tabla_larga(df, ["v"])
    m = fr.momentos(freq, ["variable"]).select(
        fr.asimetria().alias("s"), fr.curtosis_exceso().alias("k")
    ).first()
    assert m["s"] == pytest.approx(0.9159709868553083)
    assert m["k"] == pytest.approx(-0.7338571946107271)
    q = fr.acumular(freq, ["variable"]).groupBy("variable").agg(
        *[fr.cuantil_agregado(p).alias(f"p{i}") for i, p in enumerate((0.25, 0.5, 0.75))]
    ).first()
    assert (q["p0"], q["p1"], q["p2"]) == (2, 3, 10)


def test_rangos_en_su_propio_tipo(spark):
    grande = 2**53
    df = spark.createDataFrame([(grande,), (grande + 1,), (1,)], "v long")
    r = {x["v"]: x["k"] for x in fr.rangos_densos(df, {"k": ("v", True)}).collect()}
    assert r == {grande + 1: 1, grande: 2, 1: 3}
    vivo = {x["v"]: x["k"] for x in fr.rangos_densos(df, {"k": ("v", True)}, vivo=True).collect()}
    assert vivo == r


def test_nan_queda_sobre_todo_numero(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "valor double")
    acc = fr.acumular(fr.tabla(df, ["valor"]), nulos=True).collect()
    assert [str(r["valor"]) for r in sorted(acc, key=lambda r: r["orden"])] == ["1.0", "inf", "nan", "None"]


def test_rango_estrecho_se_reparte(spark):
    df = spark.range(200_000).select((F.col("id") / 200 + 5_000_000).alias("valor"), F.lit(1).alias("n"))
    antes = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        partes = fr.por_rangos(df, [F.col("valor")]).groupBy("_parte").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", antes)
    assert len(partes) == 8 and max(r["count"] for r in partes) < 50_000
    acc = fr.acumular(df).agg(F.max("orden"), F.count_if(F.col("previos") + 1 != F.col("orden"))).first()
    assert tuple(acc) == (200_000, 0)


def test_bosquejos_guardados_y_unidos(spark, tmp_path):
    from balanza.operators import bosquejos as b

    filas = [(2000 + i % 5, f"d{i % 3000}", None if i % 7 == 0 else i % 1000) for i in range(30_000)]
    df = spark.createDataFrame(filas, "anio int, distrito_fiscal string, ingresado int")
    ruta = f"{tmp_path}/b"
    b.guardar_bosquejos(b.bosquejar(df, ["distrito_fiscal"], ["ingresado"]), ruta)
    # One year again: only its own sketches are replaced, and the result is the same.
    b.guardar_bosquejos(b.bosquejar(df.filter("anio = 2001"), ["distrito_fiscal"], ["ingresado"]), ruta)
    guardados = spark.read.parquet(ruta)
    assert guardados.count() == 10
    for desde, hasta in ((2000, 2004), (2001, 2002), (2003, 2003)):
        r = b.contraste(df, guardados, desde, hasta).collect()
        assert len(r) == 2 and all(x["dentro"] for x in r)
    todo = b.unir_bosquejos(guardados)
    assert abs(b.distintos_estimados(todo).first()["distintos"] - 3000) <= 4 * b.ERROR_DISTINTOS * 3000
    q = b.cuantiles_estimados(todo).first()
    assert q["filas"] == sum(f[2] is not None for f in filas) and abs(q["mediana"] - 500) <= 20 and q["q05"] < q["q25"] < q["q95"]
    assert b.unir_bosquejos(guardados, 1990, 1991).count() == 0
    # A column without a value has no sketch.
    vacia = b.bosquejar(df.withColumn("ingresado", F.lit(None).cast("int")), ["distrito_fiscal"], ["ingresado"])
    assert {x["clase"] for x in vacia.collect()} == {"distintos"}
