"""Drawn numbers, K-means and the forest against plain versions."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from balanza.functions.azar import PRIMO, sorteo, sorteo_de
from balanza.operators import bosque, descriptiva, grupos


def test_sorteo_igual_en_ambos_lados(spark):
    rng = random.Random(1)
    filas = [(rng.randint(0, 2**40), rng.randint(-5, 2**33)) for _ in range(300)]
    df = spark.createDataFrame(filas, "a long, b long").select("a", "b", sorteo(7, F.col("a"), F.col("b")).alias("s"))
    vistos = df.collect()
    assert all(r["s"] == sorteo_de(7, r["a"], r["b"]) for r in vistos)
    assert all(1 <= r["s"] <= PRIMO for r in vistos)
    # Spread: halves, quarters and neighbours.
    x = np.array([sorteo_de(42, a, j) for a in range(60) for j in range(60)]) / PRIMO
    assert abs(x.mean() - 0.5) < 0.02 and abs(np.corrcoef(x[:-1], x[1:])[0, 1]) < 0.05
    assert all(abs(np.mean((x >= k / 8) & (x < (k + 1) / 8)) - 0.125) < 0.02 for k in range(8))


def plano(z, n, centros, vueltas=300):
    """Lloyd steps in Python's integers."""
    for _ in range(vueltas):
        etiqueta = [min(range(len(centros)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(p, centros[i])), i)) for p in z]
        nuevos = []
        for i, c in enumerate(centros):
            suyos = [(p, w) for p, w, e in zip(z, n, etiqueta) if e == i]
            total = sum(w for _, w in suyos)
            nuevos.append(tuple(sum(p[k] * w for p, w in suyos) // total for k in range(3)) if suyos else c)
        if nuevos == centros:
            break
        centros = nuevos
    return centros


def test_pasos_de_kmeans_iguales_a_los_planos(spark):
    rng = random.Random(5)
    filas = [(rng.randint(1, 400), rng.randint(0, 300)) for _ in range(500)] + [(5000 + i % 7, 10) for i in range(40)]
    pares = descriptiva.pares_medidas(spark.createDataFrame(filas, "ingresado int, atendido int"))
    datos = grupos.tipificar(pares.filter("tasa_atencion IS NOT NULL")).cache()
    z = [(r["_x"], r["_y"], r["_z"]) for r in datos.collect()]
    n = [r["n"] for r in datos.collect()]
    comienzo = grupos.inicios(datos, 4, 2, 42)
    assert all(len(set(c)) == 4 and set(c) <= set(z) for c in comienzo)
    final = grupos.ajustar(datos, [2, 3, 4], 2, 42)
    assert set(final) == {(k, r) for k in (2, 3, 4) for r in (0, 1)}
    for (k, r), centros in final.items():
        assert centros == plano(z, n, comienzo[r][:k])
    mejor = grupos.mejores(datos, final)
    valores = grupos.siluetas(datos, mejor)
    for k, centros in mejor.items():
        etiqueta = [min(range(len(centros)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(p, centros[i])), i)) for p in z]
        total = 0.0
        for p, w, e in zip(z, n, etiqueta):
            medias = {}
            for g in set(etiqueta):
                suma = sum(v * sum((a - b) ** 2 for a, b in zip(p, q)) for q, v, f in zip(z, n, etiqueta) if f == g)
                medias[g] = suma / (sum(v for v, f in zip(n, etiqueta) if f == g) - (g == e))
            a, b = medias[e], min(v for g, v in medias.items() if g != e)
            total += w * (b - a) / max(a, b)
        assert abs(total / sum(n) - valores[k]) < 1e-6
    datos.unpersist()


def test_pocos_pares_y_pares_iguales(spark):
    # One distinct pair: no second group; the default number is reported without a silhouette.
    pares = descriptiva.pares_medidas(spark.createDataFrame([(5, 4)] * 40, "ingresado int, atendido int"))
    asignado, k, silueta = grupos.agrupar(pares)
    assert (k, silueta) == (3, -1.0) and {r["cluster"] for r in asignado.collect()} == {0}
    r = grupos.clusters_perfil(pares).collect()
    assert len(r) == 1 and r[0]["tamano"] == 40


def test_arboles_iguales_a_los_planos(spark):
    rng = random.Random(9)
    filas = [(a, float(rng.randint(1, 30)), float(rng.randint(0, 30))) for a in range(4) for _ in range(64)]
    df = spark.createDataFrame(filas, "arbol int, ingresado double, atendido double").withColumn("tasa_atencion", F.col("atendido") / F.col("ingresado"))
    nodos = {(r["arbol"], r["nodo"]): r for r in bosque.crecer(df, 64, 42).collect()}

    def crecer(arbol, nodo, nivel, x):
        r = nodos.pop((arbol, nodo))
        assert (r["tamano"], r["nivel"]) == (len(x), nivel)
        utiles = [i for i in range(3) if x[:, i].max() > x[:, i].min()]
        if nivel == 6 or not utiles:
            assert r["variable"] is None
            return
        v = utiles[sorteo_de(42, arbol, nodo, 0) % len(utiles)]
        corte = x[:, v].min() + (x[:, v].max() - x[:, v].min()) * (sorteo_de(42, arbol, nodo, 1) / (PRIMO + 1.0))
        assert (r["variable"], r["corte"]) == (v, corte)
        for hijo, parte in ((2 * nodo + 1, x[x[:, v] <= corte]), (2 * nodo + 2, x[x[:, v] > corte])):
            if len(parte):
                crecer(arbol, hijo, nivel + 1, parte)

    for a in range(4):
        crecer(a, 0, 0, np.array([(i, t, t / i) for b, i, t in filas if b == a]))
    assert not nodos


def test_posiciones_distintas():
    for filas in (40, 256, 300, 10_000):
        p = bosque.posiciones(filas, 3, 256, 42)
        for a in range(3):
            suyas = [x for x, b in p if b == a]
            assert len(suyas) == len(set(suyas)) == min(256, filas) and max(suyas) < filas


def test_negativos_no_se_confunden(spark):
    # Pairs keep both columns, so a negative count stays what it is.
    filas = [(10 + i % 5, -3 - i % 4) for i in range(300)]
    pares = descriptiva.pares_medidas(spark.createDataFrame(filas, "ingresado int, atendido int"))
    validos = pares.filter("tasa_atencion IS NOT NULL")
    m = bosque.muestras(validos, 300, 2, 256, 42)
    assert {(r["ingresado"], r["atendido"]) for r in m.collect()} <= {(float(a), float(b)) for a, b in filas}
