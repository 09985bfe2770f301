"""Dimension analyses: the distinct values of each dimension, classified and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.functions import clases
from balanza.functions.texto import limpiar_texto
from balanza.sesion import cortar

# Fixed value: share of rows from which a subject counts as a main one.
UMBRAL_PRINCIPAL = 0.05


# Row count that a row of ``compactar``'s tables stands for.
PESO = "_n"

# Columns of few values are counted together: a row then stands for three keys instead of six.
_GRUPOS = {
    "caso": ("tipo_caso", "especializada", "tipo_fiscalia", "anio", "periodo"),
    "especialidad": ("especialidad", "materia"),
    "lugar": ("distrito_fiscal", "ubigeo_pjfs", "dpto_pjfs", "prov_pjfs", "dist_pjfs"),
}
# Tables that are read off a group, and their columns.
_TABLAS = {
    "tipo_caso": ("caso", ("tipo_caso",)),
    "especializada": ("caso", ("especializada",)),
    "especialidad": ("especialidad", ("especialidad", "materia")),
    "lugar": ("lugar", _GRUPOS["lugar"]),
    "tipo_fiscalia": ("caso", ("tipo_fiscalia",)),
    "tiempo": ("caso", ("anio", "periodo")),
}


def compactar(
    df: DataFrame, region: Column | None = None
) -> dict[str, DataFrame]:
    """Natural keys of every dimension with their row counts, from a single pass over the rows.

    Each table feeds the functions below in place of the rows themselves.  A key may
    come several times; its rows are the sum.
    """
    grupos = dict(_GRUPOS)
    if region is not None:
        df = df.withColumn("_region", region)
        grupos["lugar"] = (*grupos["lugar"], "_region")
    ancho = max(len(c) for c in grupos.values())
    nulo = F.lit(None).cast("string")

    def fila(grupo: str, columnas: tuple[str, ...]) -> Column:
        celdas = [F.col(c).cast("string") for c in columnas] + [nulo] * (ancho - len(columnas))
        return F.struct(
            F.lit(grupo).alias("_grupo"), *[c.alias(f"_k{i}") for i, c in enumerate(celdas)]
        )

    largo = df.select(F.inline(F.array(*[fila(g, c) for g, c in grupos.items()])))
    largo = cortar(largo.groupBy(*largo.columns).agg(F.count(F.lit(1)).alias(PESO)))
    enteros = {"ubigeo_pjfs", "anio"}

    def tabla(grupo: str, columnas: tuple[str, ...]) -> DataFrame:
        celdas = {c: F.col(f"_k{grupos[grupo].index(c)}") for c in columnas}
        return largo.filter(F.col("_grupo") == grupo).select(
            *[k.cast("int" if c in enteros else "string").alias(c) for c, k in celdas.items()], PESO
        )

    return {t: tabla(g, grupos["lugar"] if t == "lugar" else columnas) for t, (g, columnas) in _TABLAS.items()}


def _conteo(df: DataFrame) -> Column:
    return F.sum(PESO) if PESO in df.columns else F.count(F.lit(1))


def _frecuencia(df: DataFrame, columna: str, sobre_no_nulos: bool = False) -> DataFrame:
    """Normalised values of a column with count and share of rows."""
    g = df.groupBy(limpiar_texto(F.col(columna)).alias(columna)).agg(
        _conteo(df).alias("frecuencia")
    )
    if PESO not in df.columns:
        g = cortar(g)
    con_valor = g.filter(F.col(columna).isNotNull())
    total = (con_valor if sobre_no_nulos else g).agg(F.sum("frecuencia")).scalar()
    return con_valor.withColumn("porcentaje", F.col("frecuencia") / total * 100)


def dim_tipos_caso(df: DataFrame) -> DataFrame:
    return _frecuencia(df, "tipo_caso").withColumn(
        "categoria", clases.categoria_caso(F.col("tipo_caso"))
    )


def dim_fiscalias_especializadas(df: DataFrame) -> DataFrame:
    return _frecuencia(df, "especializada", sobre_no_nulos=True).withColumn(
        "area_especializacion", clases.area_especializacion(F.col("especializada"))
    )


def dim_materias(df: DataFrame) -> DataFrame:
    # freq >= 5 % of the rows, as a comparison of whole numbers.
    return _frecuencia(df, "materia").withColumn(
        "es_principal", F.col("porcentaje") >= UMBRAL_PRINCIPAL * 100
    )


def dim_especialidades(df: DataFrame) -> DataFrame:
    """Each speciality with the subject it occurs with most (ties: first by name)."""
    pares = df.groupBy(
        limpiar_texto(F.col("especialidad")).alias("especialidad"),
        limpiar_texto(F.col("materia")).alias("materia"),
    ).agg(_conteo(df).alias("n"))
    if PESO not in df.columns:
        pares = cortar(pares)
    total = pares.agg(F.sum("n")).scalar()
    con_materia = F.when(F.col("materia").isNotNull(), F.col("materia"))
    return (
        pares.filter(F.col("especialidad").isNotNull())
        .groupBy("especialidad")
        .agg(
            F.min_by(con_materia, F.struct(F.col("materia").isNull(), -F.col("n"), "materia")).alias(
                "materia_asociada"
            ),
            F.sum("n").alias("frecuencia"),
        )
        .filter(F.col("materia_asociada").isNotNull())
        .withColumn("porcentaje", F.col("frecuencia") / total * 100)
    )


def dim_ubicaciones(df: DataFrame, region: Column | None = None) -> DataFrame:
    """Distinct locations with their rows and region, inferred from the department unless given."""
    nombres = {"dpto_pjfs": "departamento", "prov_pjfs": "provincia", "dist_pjfs": "distrito"}
    if region is None:
        region = clases.region_geografica(limpiar_texto(F.col("dpto_pjfs")))
    return (
        df.select(
            "ubigeo_pjfs",
            *[limpiar_texto(F.col(c)).alias(a) for c, a in nombres.items()],
            region.alias("region_geografica"),
            (F.col(PESO) if PESO in df.columns else F.lit(1)).alias("registros"),
        )
        .dropna(subset=["ubigeo_pjfs", *nombres.values()])
        .groupBy("ubigeo_pjfs", *nombres.values(), "region_geografica")
        .agg(F.sum("registros").alias("registros"))
    )


def dim_distritos(df: DataFrame) -> DataFrame:
    """Distinct (district, location code, department)."""
    return (
        df.select(
            limpiar_texto(F.col("distrito_fiscal")).alias("distrito_fiscal"),
            "ubigeo_pjfs",
            "dpto_pjfs",
        )
        .dropna()
        .distinct()
    )


def dim_tipos_fiscalia(df: DataFrame) -> DataFrame:
    return _frecuencia(df, "tipo_fiscalia").withColumn(
        "nivel_jerarquico", clases.nivel_jerarquico(F.col("tipo_fiscalia"))
    )


def dim_tiempo(df: DataFrame) -> DataFrame:
    """Years with a period text, whole-year months and days of the year."""
    # Distinct pairs first: a minimum of text is only taken over those few rows.
    return (
        df.filter(F.col("anio").isNotNull())
        .select("anio", F.trim("periodo").alias("periodo"))
        .distinct()
        .groupBy("anio")
        .agg(F.min("periodo").alias("periodo"))
        .withColumns(
            {
                "mes_inicio": F.lit(1),
                "mes_fin": F.lit(12),
                "total_dias": F.dayofyear(F.make_date("anio", F.lit(12), F.lit(31))),
            }
        )
    )


def rango_anios(df: DataFrame) -> DataFrame:
    """The years covered as text, ``min-max``; null without a year."""
    return df.agg(
        F.when(
            F.min("anio").isNotNull(),
            F.concat_ws("-", F.min("anio").cast("string"), F.max("anio").cast("string")),
        ).alias("rango")
    )


def conteo_por_clase(dim: DataFrame, clase: str) -> DataFrame:
    """How many dimension values fall in each class (category, area, region, subject)."""
    return dim.groupBy(clase).agg(F.count(F.lit(1)).alias("valores"))


def distritos_por_departamento(distritos: DataFrame) -> DataFrame:
    return distritos.groupBy("dpto_pjfs").agg(
        F.countDistinct("distrito_fiscal").alias("distritos")
    )


def especializacion(df: DataFrame) -> DataFrame:
    """Rows with and without a specialised-office value (the sentinel is a value)."""
    con = F.count("especializada")
    todas = F.count(F.lit(1))
    return df.agg(
        con.alias("casos_especializados"),
        (todas - con).alias("casos_generales"),
        (con / todas * 100).alias("porcentaje_especializacion"),
    )


def mas_frecuentes(dim: DataFrame, clave: str, k: int = 10) -> DataFrame:
    return dim.orderBy(F.desc("frecuencia"), clave).limit(k)
