"""Cleaning of raw yearly tables and the reports that go with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from balanza.esquema import ANIO_DESCARGA, COLUMNAS_PLANAS, ROLES, RolesColumnas
from balanza.functions.texto import (
    FORMATOS_FECHA,
    a_entero,
    a_fecha,
    a_numero,
    limpiar_texto,
    normalizar_especializada,
)
from balanza.operators.frecuencias import (
    acumular,
    cuantil_agregado,
    momentos,
    std_muestral,
    std_poblacional,
    tabla_larga,
    unir_por_grupo,
)
from balanza.sesion import cortar

# Fence factor and z limit of the outlier report.
FACTOR_IQR = 1.5
LIMITE_Z = 3

_FECHAS = ("fecha_descarga", "fecha_corte")


def anio_de_fila(c: Column) -> Column:
    return a_entero(a_numero(c.cast("string")))


# --------------------------------------------------------------------------- steps


def medidas_a_numero(df: DataFrame, roles: RolesColumnas = ROLES) -> DataFrame:
    """Blank, missing or unreadable measures become 0."""
    return df.withColumns(
        {
            c: F.coalesce(a_numero(F.col(c).cast("string")), F.lit(0.0))
            for c in roles.metricas
            if c in df.columns
        }
    )


def tiene_criticas(df: DataFrame, roles: RolesColumnas = ROLES) -> Column:
    """True when every critical column present in the table has a value."""
    cond = F.lit(True)
    for c in roles.criticas:
        if c in df.columns:
            cond = cond & F.col(c).isNotNull()
    return cond


def limpiar_nulos(df: DataFrame, roles: RolesColumnas = ROLES) -> DataFrame:
    return medidas_a_numero(df, roles).filter(tiene_criticas(df, roles))


def quitar_duplicados(df: DataFrame) -> DataFrame:
    """Full-row distinct (nulls equal), before names are normalised."""
    return df.dropDuplicates()


def convertir_tipos(df: DataFrame, formatos: Sequence[str] = FORMATOS_FECHA) -> DataFrame:
    cambios: dict[str, Column] = {
        c: a_fecha(F.col(c), formatos).cast("timestamp_ntz") for c in _FECHAS if c in df.columns
    }
    for c in ("anio", "ubigeo_pjfs"):
        cambios[c] = anio_de_fila(F.col(c))
    for c in ROLES.metricas:
        if c in df.columns:
            cambios[c] = F.greatest(a_entero(F.col(c)), F.lit(0))
    return df.withColumns(cambios)


def normalizar_textos(df: DataFrame, roles: RolesColumnas = ROLES) -> DataFrame:
    return df.withColumns(
        {
            c: normalizar_especializada(F.col(c))
            if c == "especializada"
            else limpiar_texto(F.col(c))
            for c in roles.texto
            if c in df.columns
        }
    )


def validar_consistencia(df: DataFrame) -> DataFrame:
    """Attended never exceeds filed; the download year is added."""
    df = df.withColumn("atendido", F.least("atendido", "ingresado"))
    if "fecha_descarga" in df.columns:
        df = df.withColumn(ANIO_DESCARGA, F.year("fecha_descarga"))
    return df


def limpiar(
    df: DataFrame, formatos: Sequence[str] = FORMATOS_FECHA, roles: RolesColumnas = ROLES
) -> DataFrame:
    """Clean table of one or many years: one shuffle, for the duplicate rows."""
    df = quitar_duplicados(limpiar_nulos(df, roles))
    return validar_consistencia(normalizar_textos(convertir_tipos(df, formatos), roles))


# ------------------------------------------------------------------------- profiles


def perfil_calidad(df: DataFrame, claves: Sequence[str] = ("anio",)) -> DataFrame:
    """Rows, columns, duplicate rows, and nulls and type per column, in long form.

    Counts are in ``valor``, types in ``texto``.
    """
    columnas = df.columns
    copias = df.groupBy(*columnas).agg(F.count(F.lit(1)).alias("_n"))
    agregados = [
        F.sum("_n").alias("filas"),
        F.lit(len(columnas)).cast("long").alias("columnas"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicados"),
        *[
            F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"nulos_{i}")
            for i, c in enumerate(columnas)
        ],
    ]
    # Grouping keys are renamed, as the columns themselves are profiled too.
    g = copias.groupBy(*[anio_de_fila(F.col(k)).alias(f"_{k}") for k in claves]).agg(*agregados)
    filas = [(m, None, m) for m in ("filas", "columnas", "duplicados")]
    filas += [("nulos", c, f"nulos_{i}") for i, c in enumerate(columnas)]
    celdas = [(m, c, F.col(origen), None) for m, c, origen in filas]
    celdas += [("tipo", c, F.lit(None), tipo) for c, tipo in df.dtypes]
    largo = F.array(
        *[
            F.struct(
                F.lit(m).alias("metrica"),
                F.lit(c).cast("string").alias("columna"),
                valor.cast("long").alias("valor"),
                F.lit(texto).cast("string").alias("texto"),
            )
            for m, c, valor, texto in celdas
        ]
    )
    return g.select(*[F.col(f"_{k}").alias(k) for k in claves], F.inline(largo))


def _tabla_textos(df: DataFrame, columnas: Sequence[str], claves: Sequence[str]) -> DataFrame:
    return tabla_larga(df, [c for c in columnas if c in df.columns], claves, tipo="string")


def top_valores(
    df: DataFrame,
    columnas: Sequence[str] = ROLES.perfil_categorico,
    claves: Sequence[str] = ("anio",),
    k: int = 10,
) -> DataFrame:
    """The k most frequent values of each column (ties by value)."""
    freq = _tabla_textos(df, columnas, claves).filter(F.col("valor").isNotNull())
    orden = Window.partitionBy(*claves, "variable").orderBy(F.desc("n"), "valor")
    # row_number <= k is cut down to k rows per task before the shuffle.
    return (
        freq.withColumn("puesto", F.row_number().over(orden))
        .filter(F.col("puesto") <= k)
        .select(*claves, F.col("variable").alias("columna"), "puesto", "valor", F.col("n").alias("frecuencia"))
    )


def perfil_categorico(
    df: DataFrame,
    columnas: Sequence[str] = ROLES.perfil_categorico,
    claves: Sequence[str] = ("anio",),
) -> DataFrame:
    """Distinct values, most frequent value and its frequency per column."""
    freq = _tabla_textos(df, columnas, claves)
    con = F.col("valor").isNotNull()
    mejor = F.struct(F.when(con, -F.col("n")).otherwise(F.lit(0)), "valor")
    return freq.groupBy(*claves, F.col("variable").alias("columna")).agg(
        F.count("valor").alias("valores_unicos"),
        F.min_by("valor", F.when(con, mejor)).alias("valor_mas_frecuente"),
        F.max(F.when(con, F.col("n"))).alias("frecuencia_maxima"),
    )


def perfil_numerico(
    df: DataFrame,
    columnas: Sequence[str] = ROLES.perfil_numerico,
    claves: Sequence[str] = ("anio",),
) -> DataFrame:
    """Min, max, mean, median, sample std, quartiles, zeros and negatives per column."""
    # A profiled column may also be a key, so keys get their own names first.
    base = df.withColumns({f"_{k}": F.col(k) for k in claves})
    propias = [f"_{k}" for k in claves]
    freq = cortar(tabla_larga(base, [c for c in columnas if c in df.columns], propias))
    grupos = [*propias, "variable"]
    q = acumular(freq, grupos).groupBy(*grupos).agg(
        cuantil_agregado(0.25).alias("q25"),
        cuantil_agregado(0.5).alias("mediana"),
        cuantil_agregado(0.75).alias("q75"),
    )
    m = momentos(freq, grupos)
    return m.join(q, grupos).select(
        *[F.col(f"_{k}").alias(k) for k in claves],
        F.col("variable").alias("columna"),
        F.col("minimo").alias("min"),
        F.col("maximo").alias("max"),
        "media",
        "mediana",
        std_muestral().alias("std"),
        "q25",
        "q75",
        F.col("ceros").alias("valores_cero"),
        F.col("negativos").alias("valores_negativos"),
    )


def perfil_fechas(
    df: DataFrame,
    claves: Sequence[str] = ("anio",),
    formatos: Sequence[str] = FORMATOS_FECHA,
) -> DataFrame:
    """First and last date and the count of unreadable ones, per date column."""
    columnas = [c for c in _FECHAS if c in df.columns]
    largo = df.select(
        *[anio_de_fila(F.col(k)).alias(k) for k in claves],
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("columna"),
                        a_fecha(F.col(c).cast("string"), formatos)
                        .cast("timestamp_ntz")
                        .alias("fecha"),
                    )
                    for c in columnas
                ]
            )
        ),
    )
    return largo.groupBy(*claves, "columna").agg(
        F.min("fecha").alias("fecha_min"),
        F.max("fecha").alias("fecha_max"),
        F.count_if(F.col("fecha").isNull()).alias("fechas_invalidas"),
    )


# -------------------------------------------------------------------------- reports


def cambios_texto(
    df: DataFrame, claves: Sequence[str] = ("anio",), roles: RolesColumnas = ROLES
) -> DataFrame:
    """Distinct values of each text column before and after normalisation.

    ``df`` is the table as it enters the normalisation step; a null counts as one
    value before it.
    """
    freq = _tabla_textos(df, roles.texto, claves)
    despues = F.when(
        F.col("variable") == "especializada", normalizar_especializada(F.col("valor"))
    ).otherwise(limpiar_texto(F.col("valor")))
    # Second grouping folds the spellings, so both counts are plain counts.
    plegada = freq.groupBy(*claves, "variable", despues.alias("nuevo")).agg(
        F.count(F.lit(1)).alias("antes")
    )
    g = plegada.groupBy(*claves, F.col("variable").alias("columna")).agg(
        F.sum("antes").alias("valores_antes"), F.count(F.lit(1)).alias("valores_despues")
    )
    return g.withColumn("reduccion", F.col("valores_antes") - F.col("valores_despues"))


def huella(columnas: Sequence[str], nombre: str) -> dict[str, Column]:
    """Two 64-bit digests of the cells of a row, ``nombre`` with 0 and 1; a missing cell differs from every value."""
    faltan = sum((F.col(c).isNull().cast("long") * 2**i for i, c in enumerate(columnas)), F.lit(0))
    return {f"{nombre}{k}": F.xxhash64(F.lit(k), faltan, *columnas) for k in range(2)}


# Stand between the cells of a packed row, and before a character that tells what is meant.
_ENTRE, _MARCA = "\x1f", "\x1e"
_VACIA = f"{_MARCA}2"


def empacar(columnas: Sequence[str]) -> Column:
    """The cells of text columns as one text, another one for every other row.

    It is shuffled and compared in place of the cells: a row of sixteen cells brings as
    many pairs of position and length, which take more room than the text itself.
    """
    marcadas = [
        F.replace(F.replace(F.col(c), F.lit(_MARCA), F.lit(f"{_MARCA}0")), F.lit(_ENTRE), F.lit(f"{_MARCA}1"))
        for c in columnas
    ]
    return F.concat_ws(_ENTRE, *[F.coalesce(c, F.lit(_VACIA)) for c in marcadas])


def desempacar(df: DataFrame, empacada: str, columnas: Sequence[str]) -> DataFrame:
    """The cells that ``empacar`` has put together."""
    e, entre = F.col(empacada), F.lit(_ENTRE)
    # Splitting would repair text that is not UTF-8; such cells are cut out byte by byte.
    por_bytes = [F.substring_index(F.substring_index(e, _ENTRE, i + 1), _ENTRE, -1) for i in range(len(columnas))]
    celdas = F.when(F.is_valid_utf8(e), F.split(e, _ENTRE)).otherwise(F.array(*por_bytes))
    df = df.withColumn("_celdas", celdas)

    def celda(i: int) -> Column:
        c = F.get("_celdas", F.lit(i))
        sin_marcas = F.replace(F.replace(c, F.lit(f"{_MARCA}1"), entre), F.lit(f"{_MARCA}0"), F.lit(_MARCA))
        return F.when(c != _VACIA, sin_marcas)

    return df.withColumns({c: celda(i) for i, c in enumerate(columnas)}).drop(empacada, "_celdas")


def reporte_limpieza(
    df: DataFrame, formatos: Sequence[str] = FORMATOS_FECHA, roles: RolesColumnas = ROLES
) -> DataFrame:
    """Per-year cleaning report plus a total row (``anio`` null).

    Three nested groupings follow the life of a row: equal raw rows, equal rows after
    the null rules, equal rows after cleaning.  Each level carries the counts of the
    level below, so copies collapse early and no row is counted in a second pass.  Raw
    rows meet by their cells, packed; what each becomes is worked out then, and only digests
    of it go on, to where equal clean rows meet: both later groupings find them there.
    """
    crudas = [c for c in COLUMNAS_PLANAS if c in df.columns]
    textos = [c for c in crudas if dict(df.dtypes)[c] == "string"]
    empacada = "+".join(textos) or "_sin_textos"
    empacadas = df.select(*[c for c in crudas if c not in textos], empacar(textos).alias(empacada))
    n1 = empacadas.groupBy(*empacadas.columns).agg(F.count(F.lit(1)).alias("_copias"))
    n1 = desempacar(n1, empacada, textos)
    nulos = sum((F.col(c).isNull().cast("int") for c in crudas), F.lit(0))
    convertidos = {
        f"ceros_{c}": (F.col(c).isNull() | F.col(c).isin("", " ")).cast("long")
        for c in roles.metricas
    }
    n1 = n1.withColumns(
        {
            "_valida": tiene_criticas(df, roles),
            "_nulos": nulos * F.col("_copias"),
            **{k: v * F.col("_copias") for k, v in convertidos.items()},
        }
    )
    sin_nulos = medidas_a_numero(n1, roles)
    sin_nulos = sin_nulos.withColumns(huella([*crudas, "_valida"], "_hn"))
    tipada = convertir_tipos(sin_nulos, formatos)
    ing, at = F.col("ingresado"), F.col("atendido")
    marcas = {
        "exceso": F.col("_valida") & (at > ing),
        "desfase": F.col("_valida") & ~F.year("fecha_descarga").eqNullSafe(F.col("anio") + 1),
        "negativos": F.col("_valida") & ((ing < 0) | (at < 0)),
        "sin_ingreso": F.col("_valida") & (ing == 0) & (F.least("atendido", "ingresado") > 0),
    }
    final = validar_consistencia(normalizar_textos(tipada.withColumns(marcas), roles))
    limpias = [*crudas, ANIO_DESCARGA]
    nulos_finales = sum((F.col(c).isNull().cast("int") for c in limpias), F.lit(0))
    final = final.withColumn("_nulos_fila", nulos_finales).withColumns(huella([*limpias, "_valida"], "_hf"))
    fila_limpia = ["anio", "_valida", "_nulos_fila", "_hf0", "_hf1"]
    n2 = (
        final.select(*fila_limpia, "_hn0", "_hn1", *marcas, "_copias", "_nulos", *convertidos)
        .repartition("_hf0", "_hf1")
        .groupBy(*fila_limpia, "_hn0", "_hn1", *marcas)
        .agg(
            F.sum("_copias").alias("filas"),
            F.count(F.lit(1)).alias("distintas"),
            F.sum("_nulos").alias("nulos"),
            *[F.sum(k).alias(k) for k in convertidos],
        )
        .withColumns({c: F.col(c).cast("long") for c in marcas})
    )
    sumas = ["filas", "distintas", "nulos", *convertidos, *marcas]
    n3 = (
        n2.groupBy(*fila_limpia)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in sumas])
        .withColumns(
            {
                "_finales": F.when(F.col("_valida"), F.col("_n")).otherwise(F.lit(0)),
                "_dup_finales": F.when(F.col("_valida"), F.col("_n") - 1).otherwise(F.lit(0)),
                "_validas": F.when(F.col("_valida"), F.col("filas")).otherwise(F.lit(0)),
                "_nulos_finales": F.when(F.col("_valida"), F.col("_nulos_fila") * F.col("_n")).otherwise(
                    F.lit(0)
                ),
            }
        )
    )
    por_anio = n3.groupBy("anio").agg(
        *[F.sum(c).alias(c) for c in sumas],
        F.sum("_finales").alias("filas_finales"),
        F.sum("_dup_finales").alias("dup_finales"),
        F.sum("_validas").alias("validas"),
        F.sum("_nulos_finales").alias("nulos_finales"),
    )
    # The total row is a roll-up of the yearly rows.
    g = por_anio.rollup("anio").agg(
        *[F.sum(c).alias(c) for c in por_anio.columns if c != "anio"]
    )
    c = F.col
    return g.select(
        "anio",
        c("filas").alias("filas_originales"),
        "filas_finales",
        (c("filas") - c("filas_finales")).alias("filas_eliminadas"),
        (c("filas") - c("validas")).alias("filas_eliminadas_nulos"),
        (c("validas") - c("filas_finales")).alias("duplicados_paso"),
        (c("filas_finales") / c("filas") * 100).alias("porcentaje_retencion"),
        (c("nulos") - c("nulos_finales")).alias("nulos_detectados"),
        (c("filas") - c("distintas") - c("dup_finales")).alias("duplicados_eliminados"),
        (c("filas") - c("nulos")).alias("calidad_antes"),
        (c("filas_finales") - c("nulos_finales")).alias("calidad_despues"),
        *[c(k).alias(f"{k}_convertidos") for k in convertidos],
        c("exceso").alias("casos_atendido_mayor_ingresado"),
        c("desfase").alias("inconsistencias_fecha"),
        c("negativos").alias("valores_negativos"),
        c("sin_ingreso").alias("casos_atendido_sin_ingreso"),
    )


def limites_iqr(freq: DataFrame, claves: Sequence[str], factor: float = FACTOR_IQR) -> DataFrame:
    """Quartiles and fences per group of a frequency table."""
    q = acumular(freq, claves).groupBy(*claves).agg(
        cuantil_agregado(0.25).alias("q1"),
        cuantil_agregado(0.5).alias("mediana"),
        cuantil_agregado(0.75).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns(
        {
            "limite_inferior": F.col("q1") - factor * iqr,
            "limite_superior": F.col("q3") + factor * iqr,
        }
    )


def outliers_limpieza(
    df: DataFrame, claves: Sequence[str] = ("anio",), roles: RolesColumnas = ROLES
) -> DataFrame:
    """Rows outside the fences and rows with |z| > 3 per year and measure; rows are kept."""
    grupos = [*claves, "variable"]
    freq = cortar(tabla_larga(df, roles.metricas, claves))
    lim = limites_iqr(freq, grupos)
    m = momentos(freq, grupos).withColumn("std", std_poblacional())
    con = unir_por_grupo(freq, lim, grupos, ["limite_inferior", "limite_superior"])
    con = unir_por_grupo(con, m, grupos, ["media", "std", "conteo"])
    v, n = F.col("valor"), F.col("n")
    fuera = (v < F.col("limite_inferior")) | (v > F.col("limite_superior"))
    lejos = F.abs(v - F.col("media")) > LIMITE_Z * F.col("std")
    g = con.groupBy(*claves, F.col("variable").alias("columna")).agg(
        F.first("limite_inferior").alias("limite_inferior"),
        F.first("limite_superior").alias("limite_superior"),
        F.coalesce(F.sum(F.when(fuera, n)), F.lit(0)).alias("iqr_conteo"),
        F.coalesce(F.sum(F.when(lejos, n)), F.lit(0)).alias("z_conteo"),
        F.first("conteo").alias("_n"),
    )
    return g.withColumns(
        {
            "iqr_porcentaje": F.col("iqr_conteo") / F.col("_n") * 100,
            "z_porcentaje": F.col("z_conteo") / F.col("_n") * 100,
        }
    ).drop("_n")


def dispersion_zscore(
    df: DataFrame, claves: Sequence[str] = ("anio",), roles: RolesColumnas = ROLES
) -> DataFrame:
    """Points of the z-score chart: distinct values, their flag and the reference lines."""
    grupos = [*claves, "variable"]
    freq = cortar(tabla_larga(df, roles.metricas, claves))
    m = momentos(freq, grupos).withColumns({"_pob": std_poblacional(), "_mue": std_muestral()})
    con = unir_por_grupo(freq, m, grupos, ["media", "_pob", "_mue"])
    return con.select(
        *claves,
        F.col("variable").alias("columna"),
        "valor",
        "n",
        (F.abs(F.col("valor") - F.col("media")) > LIMITE_Z * F.col("_pob")).alias("es_outlier"),
        F.round(F.col("media") + LIMITE_Z * F.col("_mue"), 6).alias("linea_superior"),
        F.round(F.col("media") - LIMITE_Z * F.col("_mue"), 6).alias("linea_inferior"),
    )
