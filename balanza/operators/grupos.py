"""K-means groups of (filed, attended, rate), on weighted distinct pairs, in whole numbers.

Features are millionths of a standard deviation above the minimum, centres whole
numbers, and all sums exact, so that the result depends neither on the order of rows
nor on how they are spread, and can be computed again by another engine.

Every number of groups and every start goes through the same passes: one aggregate
over the pairs moves the centres of all runs that still move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.functions.azar import sorteo
from balanza.operators.frecuencias import acumular, cuantil_agregado
from balanza.sesion import cortar

# Fixed values of the grouping.
VARIABLES = ("ingresado", "atendido", "tasa_atencion")
MINIMO_FILAS = 10
K_MINIMO, K_MAXIMO, K_POR_DEFECTO = 2, 7, 3
REINICIOS, SEMILLA = 10, 42
MAX_ITERACIONES = 300
ESCALA = 1_000_000
EJES = ("_x", "_y", "_z")

Centro = tuple[int, ...]
Corrida = tuple[int, int]


def tipificar(validos: DataFrame) -> DataFrame:
    """The pairs with their three features as whole numbers."""
    ing, at, n = (F.col(c).cast("long") for c in ("ingresado", "atendido", "n"))
    tasa = F.expr(f"(2 * {ESCALA}L * atendido + ingresado) div (2L * ingresado)")
    datos = validos.withColumns({"_x": ing, "_y": at, "_z": tasa, "n": n})
    ancho = "decimal(38,0)"

    def resumen(c: str) -> Column:
        x = F.col(c)
        suma, cuadrados, filas = (F.sum(e).cast(ancho) for e in (n * x, (n * x).cast("decimal(19,0)") * x.cast("decimal(19,0)"), n))
        raiz = F.sqrt((filas * cuadrados - suma * suma).cast("double")) / filas.cast("double")
        return F.struct(F.min(x).alias("min"), raiz.alias("std")).alias(c)

    r = datos.agg(F.struct(*map(resumen, EJES)).alias("r")).scalar()

    def rasgo(c: str) -> Column:
        s = r.getField(c)
        z = F.floor((F.col(c) - s.getField("min")) / s.getField("std") * F.lit(float(ESCALA)) + 0.5)
        return F.when(s.getField("std") > 0, z).otherwise(0).cast("long")

    return datos.withColumns({c: rasgo(c) for c in EJES})


def _distancia(centro: Sequence[object]) -> str:
    """Squared distance to a centre, as SQL text: whole numbers that fit a long."""
    return " + ".join(f"({e} - {c}) * ({e} - {c})" for e, c in zip(EJES, centro))


def _arreglo(centros: Sequence[Centro]) -> str:
    return "array(" + ", ".join("struct(" + ", ".join(f"{v}L AS {e}" for e, v in zip(EJES, c)) + ")" for c in centros) + ")"


def _cercano(centros: str) -> Column:
    """(squared distance, number) of the nearest centre of an array; ties go to the smaller number."""
    d = _distancia([f"c.{e}" for e in EJES])
    return F.expr(f"array_min(transform({centros}, (c, i) -> struct({d} AS d, i AS i)))")


def inicios(datos: DataFrame, k: int, reinicios: int, semilla: int) -> list[list[Centro]]:
    """``k`` starting centres for each restart, drawn by weight times squared distance to the centres before.

    The draw takes the pair with the largest weight over a drawn number, which is the
    chance of a weighted draw; ties go to the smaller pair.
    """
    centros: list[list[Centro]] = [[] for _ in range(reinicios)]
    for paso in range(k):
        filas = [f"struct({r} AS r, {_arreglo(c) if c else 'CAST(NULL AS ARRAY<STRUCT<_x: BIGINT, _y: BIGINT, _z: BIGINT>>)'} AS centros)" for r, c in enumerate(centros)]
        por_inicio = datos.select(*EJES, "n", "ingresado", "atendido", F.inline(F.expr(f"array({', '.join(filas)})")))
        lejos = F.coalesce(_cercano("centros").getField("d"), F.lit(1))
        azar = sorteo(semilla + paso, F.col("r"), F.col("ingresado"), F.col("atendido"))
        # One product and one quotient of whole numbers: the same double everywhere.
        peso = F.col("n").cast("double") * lejos.cast("double") / azar.cast("double")
        turno = F.struct(peso.alias("p"), (-F.col("ingresado")).alias("a"), (-F.col("atendido")).alias("b"))
        elegidos = por_inicio.groupBy("r").agg(F.max_by(F.struct(*EJES), turno).alias("c")).collect()
        for f in elegidos:
            centros[f["r"]].append(tuple(f["c"]))
    return centros


def mover(datos: DataFrame, centros: Mapping[Corrida, list[Centro]]) -> dict[Corrida, list[Centro]]:
    """One step of all runs: each centre goes to the mean of its pairs, rounded down; one without pairs stays."""
    corridas = list(centros)
    filas = ", ".join(f"struct({i} AS corrida, {_arreglo(centros[c])} AS centros)" for i, c in enumerate(corridas))
    con = datos.select(*EJES, "n", F.inline(F.expr(f"array({filas})"))).withColumn("i", _cercano("centros").getField("i"))
    medias = con.groupBy("corrida", "i").agg(
        *[F.expr(f"sum(CAST(n AS DECIMAL(19, 0)) * CAST({e} AS DECIMAL(19, 0))) div sum(n)").alias(e) for e in EJES]
    )
    nuevos = {c: list(v) for c, v in centros.items()}
    for f in medias.collect():
        nuevos[corridas[f["corrida"]]][f["i"]] = tuple(f[e] for e in EJES)
    return nuevos


def ajustar(datos: DataFrame, ks: Sequence[int], reinicios: int, semilla: int) -> dict[Corrida, list[Centro]]:
    """Centres of each (k, restart) once they stand still."""
    comienzo = inicios(datos, max(ks), reinicios, semilla)
    final: dict[Corrida, list[Centro]] = {}
    activos = {(k, r): comienzo[r][:k] for k in ks for r in range(reinicios)}
    for _ in range(MAX_ITERACIONES):
        movidos = mover(datos, activos)
        final |= movidos
        activos = {c: v for c, v in movidos.items() if v != activos[c]}
        if not activos:
            break
    return final


def mejores(datos: DataFrame, centros: Mapping[Corrida, list[Centro]]) -> dict[int, list[Centro]]:
    """For each k the centres of its cheapest restart that hold a pair, by mean of filed cases."""
    corridas = list(centros)
    filas = ", ".join(f"struct({i} AS corrida, {_arreglo(centros[c])} AS centros)" for i, c in enumerate(corridas))
    con = datos.select(*EJES, "n", "ingresado", F.inline(F.expr(f"array({filas})"))).withColumn("c", _cercano("centros"))
    peso = F.col("n").cast("decimal(19,0)")
    partes = con.groupBy("corrida", "c.i").agg(
        F.sum(peso * F.col("c.d").cast("decimal(19,0)")).alias("costo"),
        F.sum(peso * F.col("ingresado").cast("decimal(19,0)")).alias("volumen"),
        F.sum("n").alias("n"),
    )
    por_corrida: dict[Corrida, list] = {}
    for f in partes.collect():
        por_corrida.setdefault(corridas[f["corrida"]], []).append(f)
    salida = {}
    for k in sorted({c[0] for c in corridas}):
        _, r = min((sum(f["costo"] for f in por_corrida[k, r]), r) for j, r in corridas if j == k)
        # Whole numbers: millionths of the mean, so that close means do not depend on rounding.
        orden = sorted(por_corrida[k, r], key=lambda f: (int(f["volumen"]) * ESCALA // f["n"], f["i"]))
        salida[k] = [centros[k, r][f["i"]] for f in orden]
    return salida


def siluetas(datos: DataFrame, grupos: Mapping[int, list[Centro]]) -> dict[int, float]:
    """Squared-Euclidean silhouette over all rows for each k with two groups or more, to nine digits."""
    usados = {k: v for k, v in grupos.items() if len(v) > 1}
    if not usados:
        return {}
    d = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    # Distances over a group follow from its size, sums and sum of squares.
    cuadrado = " + ".join(f"{d(e)} * {d(e)}" for e in EJES)
    filas = ", ".join(f"struct({k} AS k, {_arreglo(v)} AS centros)" for k, v in usados.items())
    con = datos.select(*EJES, "n", F.inline(F.expr(f"array({filas})"))).withColumn("i", _cercano("centros").getField("i"))
    sumas = con.groupBy("k", "i").agg(
        F.sum("n").alias("n"), F.expr(f"sum({d('n')} * ({cuadrado}))").alias("q"), *[F.expr(f"sum({d('n')} * {d(e)})").alias(e) for e in EJES]
    ).collect()
    expresiones = []
    for k, v in usados.items():
        de = {f["i"]: f for f in sumas if f["k"] == k}
        i = _cercano(_arreglo(v)).getField("i")

        def total(f) -> str:
            cruz = " + ".join(f"CAST({e} AS DECIMAL(12, 0)) * CAST({Decimal(f[e])} AS DECIMAL(26, 0))" for e in EJES)
            return f"CAST({d(f['n'])} * ({cuadrado}) + CAST({f['q']} AS DECIMAL(38, 0)) - 2 * ({cruz}) AS DOUBLE)"

        valor = F.lit(0.0)
        for g, f in de.items():
            if f["n"] == 1:
                continue
            a = F.expr(f"{total(f)} / {f['n'] - 1}D")
            b = F.least(*[F.expr(f"{total(o)} / {o['n']}D") for h, o in de.items() if h != g], F.lit(float("inf")))
            mayor = F.greatest(a, b)
            valor = F.when(i == g, F.when(mayor > 0, (b - a) / mayor).otherwise(0.0)).otherwise(valor)
        expresiones.append((F.sum(valor * F.col("n")) / F.sum("n")).alias(f"k{k}"))
    r = datos.agg(*expresiones).first()
    return {k: round(r[f"k{k}"], 9) for k in usados}


def agrupar(
    pares: DataFrame,
    ks: Sequence[int] | None = None,
    reinicios: int = REINICIOS,
    semilla: int = SEMILLA,
) -> tuple[DataFrame, int, float] | None:
    """Assign every pair to a group: ``(pairs with cluster, k, silhouette)``.

    The number of groups is the one with the best silhouette, the smaller one among
    equals; groups are numbered from 0 by their mean of filed cases.  None when there
    are too few rows.  Work on distinct pairs with weights is the same as work on the
    rows.
    """
    validos = cortar(pares.filter(F.col("tasa_atencion").isNotNull()))
    filas = validos.agg(F.sum("n")).first()[0] or 0
    if filas < MINIMO_FILAS:
        return None
    if ks is None:
        ks = range(K_MINIMO, min(K_MAXIMO, filas // 10 - 1) + 1)
    # Every step is a pass over these pairs; there may be few of them, so they are dealt out to all cores.
    tareas = pares.sparkSession.sparkContext.defaultParallelism
    datos = cortar(tipificar(validos).repartition(tareas))
    grupos = mejores(datos, ajustar(datos, [*ks] or [K_POR_DEFECTO], reinicios, semilla))
    valores = siluetas(datos, {k: v for k, v in grupos.items() if k in ks})
    if valores:
        k = min(valores, key=lambda k: (-valores[k], k))
    else:
        k = K_POR_DEFECTO
        if k not in grupos:
            grupos = mejores(datos, ajustar(datos, [k], reinicios, semilla))
    asignado = datos.withColumn("cluster", _cercano(_arreglo(grupos[k])).getField("i"))
    return asignado.select(*VARIABLES, "n", "cluster"), k, valores.get(k, -1.0)


def etiqueta_volumen(media: Column, q25: Column, q75: Column) -> Column:
    return (
        F.when(media > q75, F.lit("Alto volumen"))
        .when(media < q25, F.lit("Bajo volumen"))
        .otherwise(F.lit("Volumen medio"))
    )


def etiqueta_eficiencia(media: Column) -> Column:
    return (
        F.when(media > 0.9, F.lit("Alta eficiencia"))
        .when(media > 0.7, F.lit("Eficiencia media"))
        .otherwise(F.lit("Baja eficiencia"))
    )


def perfil_grupos(asignado: DataFrame, k: int, silueta: float) -> DataFrame:
    """Size, means, spreads and labels of each group."""
    asignado = cortar(asignado)
    n = F.col("n")
    freq = asignado.groupBy("ingresado").agg(F.sum("n").alias("n"))
    q = cortar(
        acumular(freq, valor="ingresado").agg(
            F.struct(
                cuantil_agregado(0.25, "ingresado").alias("q25"),
                cuantil_agregado(0.75, "ingresado").alias("q75"),
            ).alias("q")
        )
    ).scalar()
    total = asignado.agg(F.sum("n")).scalar()
    medias = asignado.groupBy("cluster").agg(
        F.sum("n").alias("tamano"),
        *[(F.sum(F.col(v) * n) / F.sum("n")).alias(f"{v}_media") for v in VARIABLES],
    )
    # At most K_MAXIMO groups.
    con = asignado.join(F.broadcast(medias), "cluster")
    desv = con.groupBy("cluster").agg(
        *[
            F.sqrt(
                F.sum(n * (F.col(v) - F.col(f"{v}_media")) * (F.col(v) - F.col(f"{v}_media")))
                / F.when(F.first("tamano") > 1, F.first("tamano") - 1)
            ).alias(f"{v}_std")
            for v in VARIABLES
        ]
    )
    return (
        medias.join(desv, "cluster")
        .withColumns(
            {
                "porcentaje": F.col("tamano") / total * 100,
                "caracteristica_volumen": etiqueta_volumen(
                    F.col("ingresado_media"), q.getField("q25"), q.getField("q75")
                ),
                "caracteristica_eficiencia": etiqueta_eficiencia(F.col("tasa_atencion_media")),
                "numero_clusters_optimo": F.lit(k),
                "silhouette_score": F.lit(float(silueta)),
            }
        )
        .orderBy("cluster")
    )


def clusters_perfil(pares: DataFrame, reinicios: int = REINICIOS) -> DataFrame | None:
    r = agrupar(pares, reinicios=reinicios)
    return None if r is None else perfil_grupos(*r)
