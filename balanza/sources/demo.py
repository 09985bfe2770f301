"""The case-load table read from order-processing parquet tables.

One row per order line; place, subject and office attributes are looked up.  A
lookup is a left join on the unique key of the looked-up table, so leaving out a
lookup whose columns nobody asked for cannot change the rows.  That is what
``columnas`` is for: Catalyst prunes columns by itself but never drops a join.

No broadcast is forced.  Spark broadcasts a lookup only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.  As every
shuffled lookup moves all lines once more, customers are looked up from the orders
when these are shuffled anyway; lookups that add little come first, broadcast ones last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.esquema import ANIO_DESCARGA, COLUMNAS_PLANAS, SENTINELA
from balanza.sesion import se_difunde
from balanza.sources import referencia

# How the columns of the case table are read from the order tables.
PERIODO = "ENERO - DICIEMBRE"
SEGMENTOS_GENERALES = ("MACHINERY", "BUILDING")

# Lookup -> (key in the rows so far, key of the table, lookups needed first).
_BUSQUEDAS = {
    "part": ("l_partkey", "p_partkey", ()),
    "supplier": ("l_suppkey", "s_suppkey", ()),
    "orders": ("l_orderkey", "o_orderkey", ()),
    "customer": ("o_custkey", "c_custkey", ("orders",)),
    "nation": ("s_nationkey", "n_nationkey", ("supplier",)),
    "region": ("n_regionkey", "r_regionkey", ("supplier", "nation")),
}
# The columns that are read of a lookup; by these Spark measures it.
_LEIDAS = {
    "part": ("p_partkey", "p_type", "p_brand"),
    "orders": ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "region": ("r_regionkey", "r_name"),
}


def _ingresado() -> Column:
    q = F.col("l_quantity")
    return F.floor(q * q * q * q / F.lit(500.0)).cast("int")


def _expresiones() -> dict[str, tuple[tuple[str, ...], Column]]:
    anio = F.year("o_orderdate")
    ing = _ingresado()
    atendido = F.when(
        (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), F.lit(0)
    ).otherwise(F.floor(ing * (F.lit(1.0) - F.lit(3.0) * F.col("l_discount"))).cast("int"))
    descarga = F.when(F.col("l_orderkey") % 50 == 0, F.to_date("l_shipdate")).otherwise(
        F.make_date(anio + 1, F.lit(1), F.lit(31))
    )
    segmento = F.col("c_mktsegment")
    especializada = F.when(
        segmento.isNull() | segmento.isin(*SEGMENTOS_GENERALES), F.lit(SENTINELA)
    ).otherwise(segmento)
    ubigeo = (F.col("s_nationkey") + 1) * 10000 + (F.col("s_suppkey") % 50).cast("int")
    return {
        "periodo": ((), F.lit(PERIODO)),
        "anio": (("orders",), anio),
        "fecha_descarga": (("orders",), descarga),
        "fecha_corte": ((), F.to_date("l_shipdate")),
        "distrito_fiscal": (("supplier",), F.col("s_name")),
        "tipo_fiscalia": ((), F.col("l_returnflag")),
        "materia": (("part",), F.col("p_type")),
        "especialidad": (("part",), F.concat("p_type", F.lit(" "), "p_brand")),
        "tipo_caso": (("orders",), F.col("o_orderpriority")),
        "especializada": (("customer",), especializada),
        "ingresado": ((), ing),
        "atendido": ((), atendido),
        "ubigeo_pjfs": (("supplier",), ubigeo),
        "dpto_pjfs": (("nation",), F.col("n_name")),
        "prov_pjfs": (
            ("nation",),
            F.concat("n_name", F.lit(" "), (F.col("s_suppkey") % 5).cast("string")),
        ),
        "dist_pjfs": (
            ("nation",),
            F.concat("n_name", F.lit("-"), (F.col("s_suppkey") % 50).cast("string")),
        ),
        ANIO_DESCARGA: (("orders",), F.year(descarga)),
        "region_geografica": (("region",), F.col("r_name")),
        "clave_orden": ((), F.col("l_orderkey")),
    }


def leer_tabla(spark: SparkSession, carpeta: str, nombre: str) -> DataFrame:
    return spark.read.parquet(f"{carpeta}/{nombre}.parquet")


TODAS = (*COLUMNAS_PLANAS, ANIO_DESCARGA, "region_geografica")


def casos(
    spark: SparkSession, carpeta: str, columnas: Sequence[str] = TODAS
) -> DataFrame:
    """Flat case table with the requested columns."""
    exprs = _expresiones()
    directas = {t for c in columnas for t in exprs[c][0]}
    necesarias = directas | {p for t in directas for p in _BUSQUEDAS[t][2]}
    df = leer_tabla(spark, carpeta, "lineitem")
    tablas = {t: leer_tabla(spark, carpeta, t).select(*_LEIDAS[t]) for t in _BUSQUEDAS if t in necesarias}
    difundidas = {t for t, otra in tablas.items() if se_difunde(otra)}

    def buscar(en: DataFrame, nombre: str) -> DataFrame:
        izq, der, _ = _BUSQUEDAS[nombre]
        return en.join(tablas.pop(nombre), F.col(izq) == F.col(der), "left")

    if "customer" in tablas and "orders" not in difundidas:
        tablas["orders"] = buscar(tablas["orders"], "customer")
    # A lookup that needs another one is smaller, so it stays behind it.
    for nombre in sorted(tablas, key=lambda t: t in difundidas or bool(_BUSQUEDAS[t][2])):
        df = buscar(df, nombre)
    return df.select(*[exprs[c][1].alias(c) for c in columnas])


def casos_sucios(spark: SparkSession, carpeta: str) -> DataFrame:
    """The same table as raw text with planted defects, as a yearly file would come."""
    df = casos(spark, carpeta, (*COLUMNAS_PLANAS, "clave_orden"))
    k = F.col("clave_orden")

    def cada(m: int) -> Column:
        return k % m == 0

    ingresado = (
        F.when(cada(97), F.lit(None).cast("string"))
        .when(cada(89), F.lit(" "))
        .when(cada(83), F.lit("x"))
        .when(cada(79), F.lit("-5"))
        .otherwise(F.col("ingresado").cast("string"))
    )
    atendido = F.when(cada(71), F.col("ingresado") + 10).otherwise(F.col("atendido"))
    vacia = (
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 1, F.lit(""))
        .when(k % 5 == 2, F.lit(",,"))
        .when(k % 5 == 3, F.lit("na"))
        .otherwise(F.lit(" None "))
    )
    cambios = {
        "ingresado": ingresado,
        "atendido": atendido.cast("string"),
        "distrito_fiscal": F.when(
            cada(53), F.concat(F.lit("  "), F.lower("distrito_fiscal"), F.lit(" "))
        ).otherwise(F.col("distrito_fiscal")),
        "tipo_caso": F.when(~cada(101), F.col("tipo_caso")),
        "especializada": F.when(F.col("especializada") == SENTINELA, vacia).otherwise(
            F.col("especializada")
        ),
        "fecha_descarga": F.when(cada(67), F.lit("sin fecha")).otherwise(
            F.date_format("fecha_descarga", "dd/MM/yyyy")
        ),
        "fecha_corte": F.date_format("fecha_corte", "dd/MM/yyyy"),
        "copias": F.when(cada(61), F.lit(2)).otherwise(F.lit(1)),
    }
    sucio = df.withColumns(cambios)
    repetido = sucio.select("*", F.explode(F.sequence(F.lit(1), "copias")).alias("_copia"))
    return repetido.select(*[F.col(c).cast("string").alias(c) for c in COLUMNAS_PLANAS])


def casos_publicados(
    spark: SparkSession, carpeta: str, columnas: Sequence[str] = TODAS
) -> DataFrame:
    """The case table with published names, and with rows that meet every rule on names and measures.

    Names follow from the order's number and the place; one order in 499 has ten times
    the filed cases, one in 211 three times as many attended as filed.
    """
    df = casos(spark, carpeta, (*columnas, *[c for c in ("ubigeo_pjfs", "ingresado", "clave_orden") if c not in columnas]))
    k = F.col("clave_orden")

    def nombre(valores: Sequence[str], indice: Column) -> Column:
        return F.get(F.array(*map(F.lit, valores)), indice.cast("int"))

    departamentos = sorted({d[2] for d in referencia.DISTRITOS})
    lugar = nombre(departamentos, F.floor(F.col("ubigeo_pjfs") / 10000) - 1)
    ing = F.when(k % 499 == 0, F.col("ingresado") * 10).otherwise(F.col("ingresado"))
    tipos = F.when(k % 10 == 0, F.lit("ESPECIAL")).otherwise(nombre(referencia.TIPOS_FISCALIA, k % 3))
    cambios = {
        "tipo_caso": nombre(referencia.TIPOS_CASO, k % len(referencia.TIPOS_CASO)),
        "especializada": nombre(referencia.ESPECIALIZADAS, k % len(referencia.ESPECIALIZADAS)),
        "tipo_fiscalia": F.concat(F.lit("FISCALIA "), tipos),
        "dpto_pjfs": F.when(F.col("ubigeo_pjfs") % 7 == 0, F.lit("EXTERIOR")).otherwise(lugar),
        "atendido": F.when(k % 211 == 0, ing * 3 + 1).otherwise(F.col("atendido")) if "atendido" in columnas else None,
        "ingresado": ing,
    }
    return df.withColumns({c: v for c, v in cambios.items() if c in df.columns and v is not None}).select(*columnas)
