"""Table constraints as a violations table (rule, table, key, count, example)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.sesion import cortar

# Constraints of the warehouse tables.
NO_NULOS_DIM = {
    "dim_ubicaciones": ("ubigeo_pjfs", "departamento", "provincia", "distrito"),
    "dim_distritos_fiscales": ("distrito_fiscal",),
    "dim_tipos_fiscalia": ("tipo_fiscalia",),
    "dim_materias": ("materia",),
    "dim_especialidades": ("especialidad",),
    "dim_tipos_caso": ("tipo_caso",),
    "dim_tiempo": ("anio", "periodo"),
}
UNICOS = {
    "dim_ubicaciones": ("ubigeo_pjfs",),
    "dim_distritos_fiscales": ("distrito_fiscal",),
    "dim_tipos_fiscalia": ("tipo_fiscalia",),
    "dim_materias": ("materia",),
    "dim_especialidades": ("especialidad",),
    "dim_tipos_caso": ("tipo_caso",),
    "dim_fiscalias_especializadas": ("especializada",),
    "dim_tiempo": ("anio", "periodo"),
}
LONGITUDES = {
    "dim_ubicaciones": {
        "departamento": 70,
        "provincia": 70,
        "distrito": 70,
        "region_geografica": 20,
    },
    "dim_distritos_fiscales": {"distrito_fiscal": 50},
    "dim_tipos_fiscalia": {"tipo_fiscalia": 20},
    "dim_materias": {"materia": 30},
    "dim_especialidades": {"especialidad": 50},
    "dim_tipos_caso": {"tipo_caso": 50, "categoria": 30},
    "dim_fiscalias_especializadas": {"especializada": 100, "area_especializacion": 50},
    "dim_tiempo": {"periodo": 50},
}
FORANEAS_HECHOS = {
    "id_tiempo": "dim_tiempo",
    "id_distrito_fiscal": "dim_distritos_fiscales",
    "id_tipo_fiscalia": "dim_tipos_fiscalia",
    "id_materia": "dim_materias",
    "id_especialidad": "dim_especialidades",
    "id_tipo_caso": "dim_tipos_caso",
    "id_fiscalia_especializada": "dim_fiscalias_especializadas",
}
FORANEAS_DIM = {
    ("dim_distritos_fiscales", "id_ubicacion"): "dim_ubicaciones",
    ("dim_especialidades", "id_materia"): "dim_materias",
}
NO_NULOS_HECHOS = (
    "id_tiempo",
    "id_distrito_fiscal",
    "id_tipo_fiscalia",
    "id_materia",
    "id_especialidad",
    "id_tipo_caso",
    "casos_ingresados",
    "casos_atendidos",
    "fecha_descarga",
    "fecha_corte",
)
HECHOS = "fact_casos_fiscales"
# Columns of the fact that the rules read.
COLUMNAS_HECHOS = (*NO_NULOS_HECHOS, "id_fiscalia_especializada")


def _chequeos() -> dict[str, Column]:
    """Violation conditions of the fact table's CHECK constraints."""
    c = F.col
    return {
        "chk_casos_positivos": (c("casos_ingresados") < 0) | (c("casos_atendidos") < 0),
        "chk_casos_logicos": c("casos_atendidos") > c("casos_ingresados"),
        "chk_fechas_logicas": c("fecha_corte") < c("fecha_descarga"),
    }


def _filas_regla(tabla: str, reglas: Mapping[tuple[str, str], Column]) -> Column:
    """Rows of the violations table for counts and examples held in columns ``_0, _e0, _1, ...``."""
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(regla).alias("regla"),
                    F.lit(tabla).alias("tabla"),
                    F.lit(clave).alias("clave"),
                    F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("long").alias("violaciones"),
                    F.col(f"_e{i}").cast("string").alias("ejemplo"),
                )
                for i, (regla, clave) in enumerate(reglas)
            ]
        )
    )


def _texto(columnas: Sequence[str]) -> Column:
    """The cells of a row as one text, a missing one empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columnas])


def contar_reglas(df: DataFrame, tabla: str, reglas: Mapping[tuple[str, str], Column]) -> DataFrame:
    """Evaluate many row conditions in one pass; keys are ``(rule, column)``.

    The example is the smallest offending value, or for a missing one the row's other
    cells.
    """
    resto = [c for c in df.columns if not c.startswith("id_") and c != "created_at"]
    conteos = []
    for i, ((regla, clave), cond) in enumerate(reglas.items()):
        muestra = _texto([c for c in resto if c != clave]) if regla == "NOT NULL" else F.col(clave)
        conteos += [F.count_if(cond).alias(f"_{i}"), F.min(F.when(cond, muestra)).alias(f"_e{i}")]
    return df.agg(*conteos).select(_filas_regla(tabla, reglas))


# Cells that stand for a fact row in an example.
MUESTRA_HECHOS = ("casos_ingresados", "casos_atendidos", "fecha_descarga", "fecha_corte")


def _reglas_hechos(hechos: DataFrame, reglas: Mapping[tuple[str, str], Column]) -> DataFrame:
    """Rule counts and examples of the fact, without a grouping; an example's text is made only for a row that breaks the rule."""
    texto = _texto(MUESTRA_HECHOS)
    agregados = []
    for i, cond in enumerate(reglas.values()):
        agregados += [F.count_if(cond).alias(f"_{i}"), F.min(F.when(cond, texto)).alias(f"_e{i}")]
    return cortar(hechos.agg(*agregados)).select(_filas_regla(HECHOS, reglas))


def _claves_usadas(hechos: DataFrame) -> DataFrame:
    """The used foreign keys with their rows: every fact row appears once per foreign key."""
    celdas = F.array(
        *[
            F.struct(F.lit(k).alias("variable"), F.col(k).cast("long").alias("valor"))
            for k in FORANEAS_HECHOS
        ]
    )
    largo = hechos.select(F.inline(celdas))
    return cortar(largo.groupBy("variable", "valor").agg(F.count(F.lit(1)).alias("n")))


def _fila(regla: str, tabla: str, clave: str, malos: DataFrame, n: Column, ejemplo: Column) -> DataFrame:
    return malos.agg(
        F.coalesce(n, F.lit(0)).cast("long").alias("violaciones"),
        F.min(ejemplo.cast("string")).alias("ejemplo"),
    ).select(
        F.lit(regla).alias("regla"),
        F.lit(tabla).alias("tabla"),
        F.lit(clave).alias("clave"),
        "violaciones",
        "ejemplo",
    )


def violaciones(dims: Mapping[str, DataFrame], hechos: DataFrame) -> DataFrame:
    """Every constraint with its number of violations (0 included).

    The fact is read twice: a plan with lookups is cut first, to ``COLUMNAS_HECHOS``.
    """
    partes = []
    for t, d in dims.items():
        reglas = {("NOT NULL", c): F.col(c).isNull() for c in NO_NULOS_DIM.get(t, ())}
        reglas |= {
            (f"LONGITUD {n}", c): F.length(c) > n for c, n in LONGITUDES.get(t, {}).items()
        }
        if reglas:
            partes.append(contar_reglas(d, t, reglas))
        clave = list(UNICOS[t])
        repetidos = (
            d.dropna(subset=clave)
            .groupBy(*clave)
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1)
        )
        partes.append(
            _fila(
                "UNIQUE",
                t,
                ",".join(clave),
                repetidos,
                F.count(F.lit(1)),
                F.concat_ws("|", *[F.col(c).cast("string") for c in clave]),
            )
        )
    reglas = {("NOT NULL", c): F.col(c).isNull() for c in NO_NULOS_HECHOS}
    reglas |= {("CHECK", k): cond for k, cond in _chequeos().items()}
    partes.append(_reglas_hechos(hechos, reglas))
    claves = _claves_usadas(hechos)
    # Anti-joins run on the distinct keys only.
    for fk, t in FORANEAS_HECHOS.items():
        usadas = claves.filter((F.col("variable") == fk) & F.col("valor").isNotNull())
        malas = usadas.join(dims[t], usadas["valor"] == dims[t][fk], "left_anti")
        partes.append(_fila("FOREIGN KEY", HECHOS, fk, malas, F.sum("n"), F.col("valor")))
    for (t, fk), destino in FORANEAS_DIM.items():
        usadas = dims[t].filter(F.col(fk).isNotNull()).select(F.col(fk).alias("valor"))
        malas = usadas.join(dims[destino], usadas["valor"] == dims[destino][fk], "left_anti")
        partes.append(_fila("FOREIGN KEY", t, fk, malas, F.count(F.lit(1)), F.col("valor")))
    return reduce(DataFrame.unionByName, partes)
