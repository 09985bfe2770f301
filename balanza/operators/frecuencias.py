"""Frequency tables and what can be read from them exactly.

Most statistics of this package need order: quantiles, ranks, Gini, outlier
fences.  A window over raw rows would send whole groups through one task, so the
work goes in two steps that both stay spread over the cluster:

1. ``tabla_larga`` / ``tabla`` count equal values (map-side combine, one shuffle);
2. ``acumular`` gives every distinct value its position: the table is range-partitioned
   by group and value, so that the boundaries follow the data, the totals of each part
   are summed up in order, and the order inside a part is found separately.  The same
   steps serve a table of any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from balanza.sesion import construir, cortar, difundir

def tabla(df: DataFrame, columnas: Sequence[str]) -> DataFrame:
    """Distinct combinations of ``columnas`` with their row count ``n``."""
    return df.groupBy(*columnas).agg(F.count(F.lit(1)).alias("n"))


def tabla_larga(
    df: DataFrame, variables: Sequence[str], claves: Sequence[str] = (), tipo: str = "double",
    peso: str | None = None,
) -> DataFrame:
    """Long form ``(claves, variable, valor, n)`` of several columns, nulls kept."""
    pares = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.col(v).cast(tipo).alias("valor")) for v in variables]
    )
    extra = [peso] if peso else []
    largo = df.select(*claves, *extra, F.inline(pares))
    n = F.sum(peso) if peso else F.count(F.lit(1))
    return largo.groupBy(*claves, "variable", "valor").agg(n.alias("n"))


def iguales(claves: Sequence[str], izq: str = "a", der: str = "b") -> list[Column]:
    """Null-safe equality of each key between two aliased frames."""
    return [F.col(f"{izq}.{k}").eqNullSafe(F.col(f"{der}.{k}")) for k in claves]


def por_rangos(df: DataFrame, orden: Sequence[Column]) -> DataFrame:
    """``df`` written in range partitions of ``orden``, with the partition's number in ``_parte``."""
    return cortar(df.repartitionByRange(*orden).withColumn("_parte", F.spark_partition_id()))


def numerar(df: DataFrame, orden: Sequence[Column], nombre: str) -> DataFrame:
    """Number the rows 1..n (long) in a total order, without one task that holds them all."""
    partes = por_rangos(df, orden)
    # One row for each range partition goes through this window.
    antes = Window.orderBy("_parte").rowsBetween(Window.unboundedPreceding, -1)
    inicio = partes.groupBy("_parte").agg(F.count(F.lit(1)).alias("_n"))
    inicio = inicio.select("_parte", F.coalesce(F.sum("_n").over(antes), F.lit(0)).alias("_n0"))
    local = F.row_number().over(Window.partitionBy("_parte").orderBy(*orden))
    numerado = partes.withColumn("_ra", local).join(inicio, "_parte")
    return numerado.select((F.col("_n0") + F.col("_ra")).alias(nombre), *df.columns)


def acumular(
    freq: DataFrame,
    claves: Sequence[str] = (),
    valor: str = "valor",
    n: str = "n",
    nulos: bool = False,
) -> DataFrame:
    """Positions of the distinct values inside each group of ``claves``.

    ``freq`` has one row per ``(claves, valor)``.  Added columns: ``previos`` (rows
    with a smaller value), ``orden`` (dense rank from 1), ``total`` (rows of the
    group) and ``total_valores``.  Rows with a null value are left out, or come
    last when ``nulos`` is set; NaN stands above all numbers.

    Values keep their type.  A group of any size is spread over the range partitions
    it needs; only the totals of a group in each partition are summed up together.
    """
    claves = list(claves)
    base = freq if nulos else freq.filter(F.col(valor).isNotNull())
    base = base.select(*claves, F.col(valor), F.col(n))
    base = por_rangos(base, [*map(F.col, claves), F.asc_nulls_last(valor)])
    por_parte = base.groupBy(*claves, "_parte").agg(
        F.sum(n).alias("_n"), F.count(F.lit(1)).alias("_v")
    )
    grupo = Window.partitionBy(*claves)
    antes = grupo.orderBy("_parte").rowsBetween(Window.unboundedPreceding, -1)
    inicio = por_parte.select(
        *claves,
        "_parte",
        F.coalesce(F.sum("_n").over(antes), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_v").over(antes), F.lit(0)).alias("_v0"),
        F.sum("_n").over(grupo).alias("total"),
        F.sum("_v").over(grupo).alias("total_valores"),
    )
    dentro = Window.partitionBy(*claves, "_parte").orderBy(F.asc_nulls_last(valor))
    local = base.select(
        "*",
        F.coalesce(
            F.sum(n).over(dentro.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_na"),
        F.row_number().over(dentro).alias("_ra"),
    )
    cond = reduce(Column.__and__, iguales([*claves, "_parte"]))
    return (
        local.alias("a")
        .join(inicio.alias("b"), cond)
        .select(
            *[F.col(f"a.{k}").alias(k) for k in claves],
            F.col(f"a.{valor}").alias(valor),
            F.col(f"a.{n}").alias(n),
            (F.col("_n0") + F.col("_na")).alias("previos"),
            (F.col("_v0") + F.col("_ra")).cast("long").alias("orden"),
            "total",
            "total_valores",
        )
    )


def cuantil_agregado(
    p: float, valor: str = "valor", n: str = "n", total: Column | None = None
) -> Column:
    """Aggregate that reads one quantile (linear interpolation) off ``acumular``'s columns."""
    total = F.col("total") if total is None else total
    h = (total - 1) * F.lit(float(p))
    bajo = F.floor(h)
    alto = F.ceil(h)

    def en(k: Column) -> Column:
        dentro = (F.col("previos") <= k) & (k < F.col("previos") + F.col(n))
        return F.max(F.when(dentro, F.col(valor).cast("double")))

    frac = F.max(h - bajo)
    v0, v1 = en(bajo), en(alto)
    return v0 + (v1 - v0) * frac


def cuantiles(
    freq: DataFrame,
    probs: Mapping[str, float],
    claves: Sequence[str] = (),
    valor: str = "valor",
    n: str = "n",
) -> DataFrame:
    """One row per group with a column per requested quantile."""
    acc = acumular(freq, claves, valor, n)
    return acc.groupBy(*claves).agg(
        *[cuantil_agregado(p, valor, n).alias(nombre) for nombre, p in probs.items()]
    )


def unir_por_grupo(
    freq: DataFrame, grupos: DataFrame, claves: Sequence[str], columnas: Sequence[str]
) -> DataFrame:
    """Attach per-group columns (one row per group) to a frequency table.

    The group table is cut and, being small, broadcast: the rows of a large group
    stay where they are instead of meeting in one task.
    """
    cond = reduce(Column.__and__, iguales(claves))
    g = difundir(cortar(grupos), [*claves, *columnas])
    return freq.alias("a").join(g.alias("b"), cond).select("a.*", *[f"b.{c}" for c in columnas])


def momentos(
    freq: DataFrame, claves: Sequence[str], valor: str = "valor", n: str = "n"
) -> DataFrame:
    """Per group: ``conteo, suma, media, minimo, maximo, m2, m3, m4, ceros, negativos``.

    ``m2..m4`` are sums of powers of deviations from the mean (two passes over the
    frequency table, so nothing cancels).
    """
    freq = cortar(freq).filter(F.col(valor).isNotNull())
    v, k = F.col(valor).cast("double"), F.col(n)
    g = freq.groupBy(*claves).agg(
        F.sum(k).alias("conteo"),
        F.sum(v * k).alias("suma"),
        F.min(v).alias("minimo"),
        F.max(v).alias("maximo"),
        F.coalesce(F.sum(F.when(v == 0, k)), F.lit(0)).alias("ceros"),
        F.coalesce(F.sum(F.when(v < 0, k)), F.lit(0)).alias("negativos"),
    )
    g = cortar(g.withColumn("media", F.col("suma") / F.col("conteo")))
    d = v - F.col("media")
    desv = (
        unir_por_grupo(freq, g, claves, ["media"])
        .groupBy(*claves)
        .agg(
            F.sum(k * d * d).alias("m2"),
            F.sum(k * d * d * d).alias("m3"),
            F.sum(k * d * d * d * d).alias("m4"),
        )
    )
    cond = reduce(Column.__and__, iguales(claves))
    return (
        g.alias("a").join(desv.alias("b"), cond).select("a.*", "b.m2", "b.m3", "b.m4")
    )


def std_muestral() -> Column:
    return F.when(F.col("conteo") > 1, F.sqrt(F.col("m2") / (F.col("conteo") - 1)))


def std_poblacional() -> Column:
    return F.sqrt(F.col("m2") / F.col("conteo"))


def asimetria() -> Column:
    s2 = F.col("m2") / F.col("conteo")
    return F.when(s2 > 0, F.col("m3") / F.col("conteo") / (s2 * F.sqrt(s2)))


def curtosis_exceso() -> Column:
    s2 = F.col("m2") / F.col("conteo")
    return F.when(s2 > 0, F.col("m4") / F.col("conteo") / (s2 * s2) - 3)


def gini_agregado(valor: str = "valor", n: str = "n") -> Column:
    """Gini of the value vector, off ``acumular``'s columns (positions start at 1)."""
    v = F.col(valor).cast("double")
    k = F.col(n).cast("double")
    # n equal values at positions previos+1 .. previos+n.
    posiciones = k * F.col("previos") + k * (k + 1) / 2
    total = F.max("total").cast("double")
    suma = F.sum(v * k)
    return F.lit(2.0) * F.sum(v * posiciones) / (total * F.when(suma != 0, suma)) - (
        total + 1
    ) / total


def rangos_densos(
    df: DataFrame,
    rangos: Mapping[str, tuple[str, bool]],
    claves: Sequence[str] = (),
    vivo: bool = False,
) -> DataFrame:
    """Add dense ranks: ``rangos`` maps the new column to ``(column, descending)``.

    Nulls come last in ascending order and first in descending order; values are
    compared in their own type.  ``df`` is an aggregate; it is cut, and the ranks come
    from the frequency table of each column.  With ``vivo`` the result is a pure plan
    instead, for views that must follow their tables: plain windows, same ranks.
    """
    claves = list(claves)
    if vivo:
        grupo = Window.partitionBy(*claves)
        nuevos = {}
        for alias, (columna, desc) in rangos.items():
            o = F.desc_nulls_first(columna) if desc else F.asc_nulls_last(columna)
            nuevos[alias] = F.dense_rank().over(grupo.orderBy(o))
        return df.withColumns(nuevos)
    salida = df = cortar(df)
    columnas = sorted({c for c, _ in rangos.values()})
    posiciones = construir(
        {
            c: lambda c=c: acumular(tabla(df, [*claves, c]), claves, c, nulos=True)
            for c in columnas
        }
    )
    for alias, (columna, desc) in rangos.items():
        orden = F.col("total_valores") - F.col("orden") + 1 if desc else F.col("orden")
        r = posiciones[columna].select(*claves, columna, orden.cast("int").alias(alias))
        cond = reduce(Column.__and__, iguales([*claves, columna]))
        salida = salida.alias("a").join(r.alias("b"), cond, "left").select("a.*", f"b.{alias}")
    return salida
