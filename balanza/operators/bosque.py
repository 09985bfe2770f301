"""Isolation forest over (filed, attended, rate).

Rows are drawn for each tree by position, trees grow on their small samples, one group
for each tree, and every distinct pair of measures is scored once, in Arrow batches.
Draws come from whole-number arithmetic and path lengths are added up in millionths,
so the result depends neither on the order of rows nor on the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.functions.azar import PRIMO, sorteo_de
from balanza.operators.frecuencias import acumular, cuantil_agregado
from balanza.operators.graficos import BARRAS, rejilla
from balanza.sesion import cortar, difundir

# Fixed values of the forest.
VARIABLES = ("ingresado", "atendido", "tasa_atencion")
CONTAMINACION = 0.05
MINIMO_FILAS = 50
ARBOLES, MUESTRA, SEMILLA = 100, 256, 42
K_CASOS = 3
# A tree draws at most so many numbers for each row of its sample.
SORTEOS = 16
ESCALA = 1_000_000


def posiciones(filas: int, arboles: int, muestra: int, semilla: int) -> list[tuple[int, int]]:
    """(position, tree) of the rows of each sample, ascending: the first distinct numbers drawn, or every row of few."""
    if filas <= muestra:
        return [(p, a) for p in range(filas) for a in range(arboles)]
    salida = []
    for a in range(arboles):
        vistas: set[int] = set()
        for j in range(SORTEOS * muestra):
            vistas.add(sorteo_de(semilla, a, j) % filas)
            if len(vistas) == muestra:
                break
        salida += [(p, a) for p in vistas]
    return sorted(salida)


def muestras(validos: DataFrame, filas: int, arboles: int, muestra: int, semilla: int) -> DataFrame:
    """Up to ``muestra`` distinct rows for each tree, as (arbol, measures).

    Rows have positions 0..N-1 through the running counts of the pairs; each batch of
    pairs picks out the draws (a fixed number of integers) that fall into its intervals.
    """
    lugares, duenos = (np.array(x, dtype=np.int64) for x in zip(*posiciones(filas, arboles, muestra, semilla)))
    par = F.struct(F.col("ingresado").cast("long").alias("ingresado"), F.col("atendido").cast("long").alias("atendido"))
    acc = acumular(validos.select(par.alias("par"), "n"), valor="par")

    def elegir(lotes: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lote in lotes:
            desde = np.searchsorted(lugares, lote["previos"].to_numpy())
            hasta = np.searchsorted(lugares, (lote["previos"] + lote["n"]).to_numpy())
            veces = hasta - desde
            fila = np.repeat(np.arange(len(lote)), veces)
            indice = np.arange(veces.sum()) - np.repeat(np.cumsum(veces) - veces, veces)
            medidas = {c: lote[c].to_numpy()[fila] for c in VARIABLES[:2]}
            yield pd.DataFrame({"arbol": duenos[desde[fila] + indice], **medidas})

    elegidas = acc.select("par.ingresado", "par.atendido", "previos", "n").mapInPandas(
        elegir, "arbol int, ingresado long, atendido long"
    )
    ing, at = F.col("ingresado").cast("double"), F.col("atendido").cast("double")
    return elegidas.select("arbol", ing.alias("ingresado"), at.alias("atendido"), (at / ing).alias("tasa_atencion"))


_NODOS = "arbol int, nodo long, variable int, corte double, tamano long, nivel int"


def crecer(sorteadas: DataFrame, muestra: int, semilla: int) -> DataFrame:
    """Node table (arbol, nodo, variable, corte, tamano, nivel) of all trees; a leaf has no variable.

    The children of node i are 2 i + 1 (up to the cut) and 2 i + 2.  A node that is not
    at the last level and whose rows differ is cut at a drawn point between the least
    and the largest value of a drawn variable.  A group is one tree's sample, ``muestra``
    rows at most.
    """
    tope = max(1, int(np.ceil(np.log2(max(muestra, 2)))))

    def un_arbol(clave: tuple, datos: pd.DataFrame) -> pd.DataFrame:
        arbol, x = int(clave[0]), datos[list(VARIABLES)].to_numpy(float)
        nodo, vive, notas = np.zeros(len(x), np.int64), np.ones(len(x), bool), []
        for nivel in range(tope + 1):
            for i in np.unique(nodo[vive]).tolist():
                aqui = np.flatnonzero(vive & (nodo == i))
                bajo, alto = x[aqui].min(axis=0), x[aqui].max(axis=0)
                utiles = np.flatnonzero(alto > bajo).tolist() if nivel < tope else []
                if not utiles:
                    notas.append((arbol, i, None, None, len(aqui), nivel))
                    vive[aqui] = False
                    continue
                v = utiles[sorteo_de(semilla, arbol, i, 0) % len(utiles)]
                corte = float(bajo[v] + (alto[v] - bajo[v]) * (sorteo_de(semilla, arbol, i, 1) / (PRIMO + 1.0)))
                notas.append((arbol, i, v, corte, len(aqui), nivel))
                nodo[aqui] = 2 * i + 1 + (x[aqui, v] > corte)
        tabla = pd.DataFrame(notas, columns=[c.split()[0] for c in _NODOS.split(", ")])
        return tabla.astype({"variable": "Int32", "corte": "float64"})

    return sorteadas.groupBy("arbol").applyInPandas(un_arbol, _NODOS)


def _media_de_caminos(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1)
    largo = 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1)
    return np.where(n > 2, largo, np.where(n == 2, 1.0, 0.0))


def puntuar(validos: DataFrame, nodos: pd.DataFrame, arboles: int, muestra: int) -> DataFrame:
    """Anomaly score 2^(-E[path] / c(sample)) of every pair, to nine digits."""
    # Trees as one table of all possible nodes; a child without rows is a leaf of size 0.
    niveles = int(nodos["nivel"].max()) + 1
    ancho = 2 ** (niveles + 1) - 1
    lugar = nodos["arbol"].to_numpy() * ancho + nodos["nodo"].to_numpy()
    variable, corte, tamano = np.full(arboles * ancho, -1), np.zeros(arboles * ancho), np.zeros(arboles * ancho)
    variable[lugar] = nodos["variable"].fillna(-1).to_numpy(int)
    corte[lugar], tamano[lugar] = nodos["corte"].fillna(0).to_numpy(), nodos["tamano"].to_numpy()
    nivel = np.floor(np.log2(np.arange(1, ancho + 1)))
    largo = np.floor((np.tile(nivel, arboles) + _media_de_caminos(tamano)) * ESCALA + 0.5).astype(np.int64)
    norma = float(_media_de_caminos(np.array([muestra]))[0])
    compartido = validos.sparkSession.sparkContext.broadcast((variable, corte, largo))

    @F.pandas_udf("double")
    def puntaje(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        variable, corte, largo = compartido.value
        x = np.column_stack([a.to_numpy(float), b.to_numpy(float), t.to_numpy(float)])
        filas = np.arange(len(x))
        suma = np.zeros(len(x), np.int64)
        for raiz in range(0, len(variable), ancho):
            nodo = np.zeros(len(x), np.int64)
            for _ in range(niveles):
                v = variable[raiz + nodo]
                sigue = v >= 0
                hijo = 2 * nodo + 1 + (x[filas, np.maximum(v, 0)] > corte[raiz + nodo])
                nodo = np.where(sigue, hijo, nodo)
            suma += largo[raiz + nodo]
        return pd.Series(np.exp2(-(suma / ESCALA) / arboles / norma))

    return validos.withColumn("puntaje", F.round(puntaje(*VARIABLES), 9))


def marcar_multivariados(
    pares: DataFrame,
    contaminacion: float = CONTAMINACION,
    arboles: int = ARBOLES,
    muestra: int = MUESTRA,
    semilla: int = SEMILLA,
) -> DataFrame | None:
    """Pairs with their anomaly score and flag; None with too few rows.

    A row is flagged when its score is strictly above the (1 - contamination)
    quantile over all rows, so ties at the cut are not flagged.
    """
    validos = cortar(pares.filter(F.col("tasa_atencion").isNotNull()))
    filas = validos.agg(F.sum("n")).first()[0] or 0
    if filas < MINIMO_FILAS:
        return None
    tam = min(muestra, filas)
    m = cortar(muestras(validos, filas, arboles, muestra, semilla))
    nodos = crecer(m, tam, semilla).toPandas()  # at most 2 * sample nodes per tree
    con = cortar(puntuar(validos, nodos, arboles, tam))
    freq = con.groupBy("puntaje").agg(F.sum("n").alias("n"))
    corte = acumular(freq, valor="puntaje").agg(cuantil_agregado(1 - contaminacion, "puntaje"))
    return cortar(con.withColumn("es_outlier", F.col("puntaje") > corte.scalar()))


def outliers_multivariados(marcados: DataFrame) -> DataFrame:
    """Number and share of flagged rows and their means."""
    n = F.when(F.col("es_outlier"), F.col("n"))
    total = F.coalesce(F.sum(n), F.lit(0))
    return marcados.agg(
        total.alias("total_outliers"),
        (total / F.sum("n") * 100).alias("porcentaje"),
        *[(F.sum(F.col(v) * n) / F.sum(n)).alias(f"{v}_promedio") for v in VARIABLES],
    )


def filas_multivariadas(df: DataFrame, marcados: DataFrame) -> DataFrame:
    """The flagged rows of the table, found by their pair of measures."""
    malos = cortar(marcados.filter("es_outlier").select("ingresado", "atendido", "puntaje"))
    return df.join(difundir(malos), ["ingresado", "atendido"])


def casos_multivariados(df: DataFrame, marcados: DataFrame, k: int = K_CASOS) -> DataFrame:
    """The k flagged rows with most filed cases."""
    return (
        filas_multivariadas(df, marcados)
        .orderBy(F.desc("ingresado"), "distrito_fiscal", "materia", "atendido")
        .select("distrito_fiscal", "materia", "ingresado", "atendido")
        .limit(k)
    )


def dispersion_multivariada(marcados: DataFrame, celdas: int = BARRAS) -> DataFrame:
    """The filed/attended chart as counts on a grid of cells, flagged rows apart, with the end of the diagonal."""
    tope = marcados.agg(F.greatest(F.max("ingresado"), F.max("atendido")) * 1.1).scalar()
    return rejilla(marcados, "ingresado", "atendido", celdas, "es_outlier").withColumn("fin_diagonal", tope)
