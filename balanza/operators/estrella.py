"""Star schema: dimension tables with surrogate keys, the fact table, the wide view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.esquema import SENTINELA
from balanza.functions.tasas import tasa_almacen
from balanza.functions.texto import limpiar_texto
from balanza.operators import dimensiones as dim
from balanza.operators.frecuencias import numerar
from balanza.sesion import construir, cortar, difundir

Tablas = dict[str, DataFrame]


def con_clave(
    df: DataFrame,
    id_col: str,
    natural: list[str],
    previas: DataFrame | None = None,
    identidad: list[str] | None = None,
) -> DataFrame:
    """Add a surrogate key (long) in natural-key order, by one rule for every size.

    Keys are 1..n, or follow the largest key of ``previas``: rows of ``previas`` come
    first, as they are, and only values of ``identidad`` (the natural key unless given)
    that they lack are numbered.  A key once given never moves.
    """
    orden = [F.col(c) for c in natural]
    if previas is None:
        return numerar(df, orden, id_col)
    a, b = df.alias("a"), previas.alias("b")
    iguales = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in identidad or natural]
    nuevas = numerar(a.join(b, iguales, "left_anti"), orden, id_col)
    ultima = F.coalesce(previas.agg(F.max(id_col)).scalar(), F.lit(0))
    nuevas = nuevas.withColumn(id_col, F.col(id_col) + ultima)
    return previas.unionByName(nuevas, allowMissingColumns=True)


# Key column and natural key of each dimension table.
CLAVES = {
    "dim_ubicaciones": ("id_ubicacion", ["ubigeo_pjfs", "departamento", "provincia", "distrito"]),
    "dim_tipos_fiscalia": ("id_tipo_fiscalia", ["tipo_fiscalia"]),
    "dim_materias": ("id_materia", ["materia"]),
    "dim_tipos_caso": ("id_tipo_caso", ["tipo_caso"]),
    "dim_fiscalias_especializadas": ("id_fiscalia_especializada", ["especializada"]),
    "dim_tiempo": ("id_tiempo", ["anio", "periodo"]),
    "dim_distritos_fiscales": ("id_distrito_fiscal", ["distrito_fiscal", "id_ubicacion"]),
    "dim_especialidades": ("id_especialidad", ["especialidad"]),
}


# What makes a row the same one in a later load, where it is less than the natural key.
IDENTIDAD = {"dim_tiempo": ["anio"]}

# Columns that the published schema leaves open or gives a default.
ABIERTAS = {
    "dim_tipos_fiscalia": {"descripcion": ("string", None)},
    "dim_materias": {
        "area_derecho": ("string", None),
        "prioridad_nacional": ("int", None),
        "descripcion": ("string", None),
    },
    "dim_especialidades": {
        "es_especializada": ("boolean", None),
        "gravedad_casos": ("int", None),
        "descripcion": ("string", None),
    },
    "dim_tipos_caso": {
        "complejidad_promedio": ("int", None),
        "tiempo_promedio_dias": ("int", None),
        "descripcion": ("string", None),
    },
    "dim_fiscalias_especializadas": {
        "nivel_especialidad": ("int", None),
        "requiere_capacitacion_especial": ("boolean", True),
        "descripcion": ("string", None),
    },
    "dim_tiempo": {"trimestre": ("int", None), "es_periodo_completo": ("boolean", True)},
    "dim_distritos_fiscales": {"estado_activo": ("boolean", True)},
}


def completar(tabla: str, df: DataFrame) -> DataFrame:
    """``df`` with the open columns of its table, at their defaults."""
    return df.withColumns(
        {c: F.lit(v).cast(t) for c, (t, v) in ABIERTAS.get(tabla, {}).items() if c not in df.columns}
    )


def numerar_tablas(tablas: Tablas, previas: Tablas | None = None) -> Tablas:
    """Complete and number dimension tables, after the rows of ``previas``; their jobs run side by side."""

    def una(t: str) -> DataFrame:
        antes = None if previas is None else previas[t]
        return cortar(con_clave(completar(t, tablas[t]), *CLAVES[t], antes, IDENTIDAD.get(t)))

    return construir({t: lambda t=t: una(t) for t in tablas})


def ubicacion_por_codigo(ubicaciones: DataFrame, previas: Tablas | None = None) -> DataFrame:
    """One surviving location for each code: the one with most rows, then by name.

    A code with several spellings would otherwise double the rows of every fact that
    has it; ``calidad.violaciones`` reports the others.  Where ``previas`` has the code,
    the location that its districts use stays, so that a later load cannot move it.
    """
    orden = [-F.coalesce("registros", F.lit(0)), *map(F.col, ("departamento", "provincia", "distrito", "id_ubicacion"))]
    if previas is not None:
        usadas = previas["dim_distritos_fiscales"].select("id_ubicacion").distinct().withColumn("usada", F.lit(0))
        conocidas = previas["dim_ubicaciones"].select("id_ubicacion", F.lit(0).alias("conocida"))
        ubicaciones = ubicaciones.join(usadas, "id_ubicacion", "left").join(conocidas, "id_ubicacion", "left")
        orden = [F.coalesce("usada", F.lit(1)), F.coalesce("conocida", F.lit(1)), *orden]
    return ubicaciones.groupBy("ubigeo_pjfs").agg(
        F.min_by("id_ubicacion", F.struct(*orden)).alias("id_ubicacion")
    )


def construir_dimensiones(
    df: DataFrame,
    region: Column | None = None,
    sentinela_como_fila: bool = True,
    previas: Tablas | None = None,
) -> Tablas:
    """The eight dimension tables of a clean flat table, from one pass over it.

    With ``previas`` (tables of an earlier load) their rows and keys stay as they are
    and values not met before are added after them.
    """
    g = dim.compactar(df, region)
    dada = None if region is None else F.col("_region")
    fiscalias = dim.dim_fiscalias_especializadas(g["especializada"])
    if not sentinela_como_fila:
        fiscalias = fiscalias.filter(F.col("especializada") != SENTINELA)
    dims = numerar_tablas(
        {
            "dim_ubicaciones": dim.dim_ubicaciones(g["lugar"], dada),
            "dim_tipos_fiscalia": dim.dim_tipos_fiscalia(g["tipo_fiscalia"]).select(
                "tipo_fiscalia", "nivel_jerarquico"
            ),
            "dim_materias": dim.dim_materias(g["especialidad"]).select("materia"),
            "dim_tipos_caso": dim.dim_tipos_caso(g["tipo_caso"]).select("tipo_caso", "categoria"),
            "dim_fiscalias_especializadas": fiscalias.select("especializada", "area_especializacion"),
            "dim_tiempo": dim.dim_tiempo(g["tiempo"]),
        },
        previas,
    )
    especialidades = dim.dim_especialidades(g["especialidad"]).withColumnRenamed(
        "materia_asociada", "materia"
    )
    codigos = cortar(ubicacion_por_codigo(dims["dim_ubicaciones"], previas))
    con_padre = numerar_tablas(
        {
            "dim_especialidades": especialidades.join(
                difundir(dims["dim_materias"], ["id_materia", "materia"]), "materia"
            ).select("especialidad", "id_materia"),
            "dim_distritos_fiscales": dim.dim_distritos(g["lugar"])
            .join(difundir(codigos), "ubigeo_pjfs")
            .select("distrito_fiscal", "id_ubicacion")
            .distinct(),
        },
        previas,
    )
    dims["dim_ubicaciones"] = cortar(dims["dim_ubicaciones"].drop("registros"))
    return {**dims, **con_padre}


def numero_de_caso() -> Column:
    """Record id, unique over all loads: the year's key, the task and the row in it, in 13, 20 and 30 bits.

    A year is written whole, so its ids depend on its own write only.
    """
    orden = F.monotonically_increasing_id()
    tarea, fila = F.shiftright(orden, 33), orden.bitwiseAND(F.lit((1 << 33) - 1))
    anio = F.coalesce(F.col("id_tiempo"), F.lit(0)).cast("long")
    return F.shiftleft(anio, 50) + F.shiftleft(tarea, 30) + fila


def construir_hechos(
    df: DataFrame, dims: dict[str, DataFrame], sentinela_a_nulo: bool = True
) -> DataFrame:
    """Fact rows: natural keys become surrogate keys, measures get their derived columns.

    A key that is not found stays null and is reported by the constraint check.
    ``id_caso`` is given when the table is written.
    """
    esp = limpiar_texto(F.col("especializada"))
    if sentinela_a_nulo:
        esp = F.when(esp != SENTINELA, esp)
    h = df.select(
        "anio",
        "ubigeo_pjfs",
        *[
            limpiar_texto(F.col(c)).alias(c)
            for c in ("distrito_fiscal", "tipo_fiscalia", "materia", "especialidad", "tipo_caso")
        ],
        esp.alias("especializada"),
        F.col("ingresado").alias("casos_ingresados"),
        F.col("atendido").alias("casos_atendidos"),
        F.col("fecha_descarga").cast("date").alias("fecha_descarga"),
        F.col("fecha_corte").cast("date").alias("fecha_corte"),
        F.col("periodo").alias("periodo_original"),
    )
    ubicaciones = difundir(dims["dim_ubicaciones"], ["id_ubicacion", "ubigeo_pjfs"])
    lugar = cortar(
        dims["dim_distritos_fiscales"]
        .join(ubicaciones, "id_ubicacion")
        .select("id_distrito_fiscal", "distrito_fiscal", "ubigeo_pjfs")
    )
    busquedas = [
        (dims["dim_tiempo"], "id_tiempo", ["anio"]),
        (lugar, "id_distrito_fiscal", ["distrito_fiscal", "ubigeo_pjfs"]),
        (dims["dim_tipos_fiscalia"], "id_tipo_fiscalia", ["tipo_fiscalia"]),
        (dims["dim_materias"], "id_materia", ["materia"]),
        (dims["dim_especialidades"], "id_especialidad", ["especialidad"]),
        (dims["dim_tipos_caso"], "id_tipo_caso", ["tipo_caso"]),
        (dims["dim_fiscalias_especializadas"], "id_fiscalia_especializada", ["especializada"]),
    ]
    for d, id_col, clave in busquedas:
        h = h.join(difundir(d, [id_col, *clave]), clave, "left")
    ing, at = F.col("casos_ingresados"), F.col("casos_atendidos")
    return h.select(
        numero_de_caso().alias("id_caso"),
        "id_tiempo",
        "id_distrito_fiscal",
        "id_tipo_fiscalia",
        "id_materia",
        "id_especialidad",
        "id_tipo_caso",
        "id_fiscalia_especializada",
        ing,
        at,
        (ing - at).alias("casos_pendientes"),
        tasa_almacen(ing, at).alias("tasa_atencion"),
        "fecha_descarga",
        "fecha_corte",
        "periodo_original",
    )


def comparar_claves(antes: Tablas, ahora: Tablas) -> DataFrame:
    """For each dimension table its rows before and now, and the keys that are new, moved, lost or given twice."""
    partes = []
    for t, (id_col, natural) in CLAVES.items():
        iguales = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in natural]
        a = antes[t].select(id_col, *natural).alias("a")
        b = ahora[t].select(id_col, *natural).alias("b")
        vieja, nueva = F.col(f"a.{id_col}"), F.col(f"b.{id_col}")
        juntas = a.join(b, iguales, "full").agg(
            F.count(vieja).alias("filas_antes"),
            F.count(nueva).alias("filas"),
            F.count_if(vieja.isNull()).alias("nuevas"),
            F.count_if(vieja != nueva).alias("movidas"),
            F.count_if(nueva.isNull()).alias("perdidas"),
            (F.count(nueva) - F.countDistinct(nueva)).alias("repetidas"),
            F.max(nueva).alias("ultima_clave"),
        )
        partes.append(juntas.select(F.lit(t).alias("tabla"), "*"))
    return reduce(DataFrame.unionByName, partes)


def control_hechos(df: DataFrame, dims: dict[str, DataFrame], hechos: DataFrame) -> DataFrame:
    """Rows and both sums by year, in the flat table and in the fact: nothing is lost or doubled."""
    planas = df.groupBy("anio").agg(
        F.count(F.lit(1)).alias("filas"),
        F.sum("ingresado").alias("ingresado"),
        F.sum("atendido").alias("atendido"),
    )
    en_hechos = (
        hechos.groupBy("id_tiempo")
        .agg(
            F.count(F.lit(1)).alias("filas_hechos"),
            F.sum("casos_ingresados").alias("ingresado_hechos"),
            F.sum("casos_atendidos").alias("atendido_hechos"),
            F.count_if(F.col("tasa_atencion").isNull()).alias("tasas_fuera_de_rango"),
        )
        .join(difundir(dims["dim_tiempo"], ["id_tiempo", "anio"]), "id_tiempo")
        .drop("id_tiempo")
    )
    return planas.join(en_hechos, "anio", "left")


def vista_casos_completo(dims: dict[str, DataFrame], hechos: DataFrame) -> DataFrame:
    """The wide view: fact joined with all dimensions, the specialised office optional."""
    d = {k: difundir(v).alias(k) for k, v in dims.items()}
    c = F.col
    v = hechos.alias("f")
    for nombre, clave in (
        ("dim_tiempo", "id_tiempo"),
        ("dim_distritos_fiscales", "id_distrito_fiscal"),
        ("dim_tipos_fiscalia", "id_tipo_fiscalia"),
        ("dim_materias", "id_materia"),
        ("dim_especialidades", "id_especialidad"),
        ("dim_tipos_caso", "id_tipo_caso"),
    ):
        v = v.join(d[nombre], c(f"f.{clave}") == c(f"{nombre}.{clave}"))
    v = v.join(
        d["dim_ubicaciones"],
        c("dim_distritos_fiscales.id_ubicacion") == c("dim_ubicaciones.id_ubicacion"),
    ).join(
        d["dim_fiscalias_especializadas"],
        c("f.id_fiscalia_especializada")
        == c("dim_fiscalias_especializadas.id_fiscalia_especializada"),
        "left",
    )
    return v.select(
        "id_caso",
        "anio",
        "periodo",
        "distrito_fiscal",
        "departamento",
        "provincia",
        "distrito",
        "ubigeo_pjfs",
        "region_geografica",
        "tipo_fiscalia",
        "nivel_jerarquico",
        "materia",
        "especialidad",
        "tipo_caso",
        c("categoria").alias("categoria_caso"),
        c("especializada").alias("fiscalia_especializada"),
        "area_especializacion",
        "casos_ingresados",
        "casos_atendidos",
        "casos_pendientes",
        "tasa_atencion",
        "fecha_descarga",
        "fecha_corte",
    )
