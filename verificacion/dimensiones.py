"""Oracle SQL of the dimension analyses, the wide view and the constraint check."""

from __future__ import annotations

from verificacion.base import AREAS, CASOS, CATEGORIAS, NIVEL, PUBLICADOS, REGIONES, VISTA, con, regla

_REGION = regla("dpto_pjfs", [(r, [(d,) for d in ds]) for r, ds in REGIONES], "REGION_NO_CLASIFICADA")
_CUENTA = "COUNT(*) AS frecuencia, COUNT(*) / CAST((SELECT COUNT(*) FROM casos) AS DOUBLE) * 100 AS porcentaje"


def _simple(col: str, extra: str = "") -> str:
    return con(CASOS, f"SELECT {col}, {_CUENTA}{extra} FROM casos WHERE {col} IS NOT NULL GROUP BY {col}")


_ESPECIALIDADES = """
, p AS (SELECT especialidad, materia, COUNT(*) AS n FROM casos
        WHERE especialidad IS NOT NULL AND materia IS NOT NULL GROUP BY ALL),
o AS (SELECT upper(especialidad) AS especialidad, materia, n, row_number() OVER (PARTITION BY especialidad ORDER BY n DESC, materia) AS k FROM p),
e AS (
  SELECT o.especialidad, o.materia AS materia_asociada, f.frecuencia,
    f.frecuencia / CAST((SELECT COUNT(*) FROM casos) AS DOUBLE) * 100 AS porcentaje
  FROM o JOIN (SELECT upper(especialidad) AS especialidad, COUNT(*) AS frecuencia FROM casos GROUP BY 1) f
    ON f.especialidad = o.especialidad WHERE k = 1)
"""


def _clave_quitada(quitadas: dict[str, tuple[str, str]], tabla: str) -> str:
    """Key of the row that a table lacks: its place among the values in order."""
    if tabla not in quitadas:
        return "CAST(NULL AS VARCHAR)"
    c, v = quitadas[tabla]
    return f"(SELECT CAST(COUNT(DISTINCT {c}) AS VARCHAR) FROM casos WHERE {c} <= '{v}')"


# Rows that break every kind of rule.
_SEMBRADOS = PUBLICADOS.replace("\ncasos AS (", "\npublicados AS (", 1) + """,
casos AS (
  SELECT * REPLACE (
    CASE WHEN clave_orden % 97 <> 0 THEN materia END AS materia,
    CASE WHEN clave_orden % 89 <> 0 THEN especialidad END AS especialidad,
    CASE WHEN clave_orden % 101 = 0 THEN 'INCIDENTE ' || repeat('Z', 60) ELSE tipo_caso END AS tipo_caso,
    CASE WHEN clave_orden % 3 = 0 THEN prov_pjfs || ' B' ELSE prov_pjfs END AS prov_pjfs,
    CASE WHEN clave_orden % 307 = 0 THEN -5 ELSE ingresado END AS ingresado,
    CASE WHEN clave_orden % 113 <> 0 THEN fecha_corte END AS fecha_corte)
  FROM publicados
)"""
# Rows that the planted dimension tables lack, and years without a period text.
_QUITADAS = {"dim_tipos_caso": ("tipo_caso", "CONSULTAS"), "dim_materias": ("materia", "PROMO")}
_SIN_PERIODO = 1996
_HECHO = "concat_ws('|', coalesce(CAST(ingresado AS VARCHAR), ''), coalesce(CAST(atendido AS VARCHAR), ''), coalesce(CAST(fecha_descarga AS VARCHAR), ''), coalesce(CAST(fecha_corte AS VARCHAR), ''))"


def _dq(casos: str = CASOS, sembrada: bool = False) -> str:
    """Constraint counts; tables rebuilt with natural keys, as keys decide every count."""
    quitadas = _QUITADAS if sembrada else {}
    tablas = {
        "dim_ubicaciones": "SELECT DISTINCT ubigeo_pjfs, dpto_pjfs AS departamento, prov_pjfs AS provincia, dist_pjfs AS distrito, region_geografica FROM casos",
        "dim_distritos_fiscales": "SELECT DISTINCT distrito_fiscal, ubigeo_pjfs FROM casos",
        "dim_tipos_fiscalia": "SELECT DISTINCT tipo_fiscalia FROM casos WHERE tipo_fiscalia IS NOT NULL",
        "dim_materias": "SELECT DISTINCT materia FROM casos WHERE materia IS NOT NULL",
        "dim_especialidades": "SELECT DISTINCT especialidad FROM casos WHERE especialidad IS NOT NULL",
        "dim_tipos_caso": f"SELECT DISTINCT tipo_caso, {regla('tipo_caso', CATEGORIAS, 'PROCESO_GENERAL')} AS categoria FROM casos WHERE tipo_caso IS NOT NULL",
        "dim_fiscalias_especializadas": f"SELECT DISTINCT especializada, {regla('especializada', AREAS, 'General')} AS area_especializacion FROM casos",
        "dim_tiempo": f"SELECT anio, CASE WHEN anio > {_SIN_PERIODO if sembrada else 0} THEN min(periodo) END AS periodo FROM casos GROUP BY anio",
    }
    for t, (c, v) in quitadas.items():
        tablas[t] += f" AND {c} <> '{v}'"
    no_nulos = {
        "dim_ubicaciones": ["ubigeo_pjfs", "departamento", "provincia", "distrito"],
        "dim_distritos_fiscales": ["distrito_fiscal"],
        "dim_tipos_fiscalia": ["tipo_fiscalia"],
        "dim_materias": ["materia"],
        "dim_especialidades": ["especialidad"],
        "dim_tipos_caso": ["tipo_caso"],
        "dim_tiempo": ["anio", "periodo"],
    }
    longitudes = {
        "dim_ubicaciones": {"departamento": 70, "provincia": 70, "distrito": 70, "region_geografica": 20},
        "dim_distritos_fiscales": {"distrito_fiscal": 50},
        "dim_tipos_fiscalia": {"tipo_fiscalia": 20},
        "dim_materias": {"materia": 30},
        "dim_especialidades": {"especialidad": 50},
        "dim_tipos_caso": {"tipo_caso": 50, "categoria": 30},
        "dim_fiscalias_especializadas": {"especializada": 100, "area_especializacion": 50},
        "dim_tiempo": {"periodo": 50},
    }
    unicos = {t: [next(iter(c))] for t, c in longitudes.items()}
    unicos |= {"dim_ubicaciones": ["ubigeo_pjfs"], "dim_tiempo": ["anio", "periodo"]}
    ctes = casos + "".join(f",\n{t} AS ({q})" for t, q in tablas.items())

    def fila(r, t, k, cuenta, origen, ejemplo="CAST(NULL AS VARCHAR)"):
        return (
            f"SELECT '{r}' AS regla, '{t}' AS tabla, '{k}' AS clave, "
            f"CAST({cuenta} AS BIGINT) AS violaciones, {ejemplo} AS ejemplo FROM {origen}"
        )

    partes = []
    otros = "CAST(anio AS VARCHAR) || '|1|12|' || CAST(dayofyear(make_date(anio, 12, 31)) AS VARCHAR) || '||true'"
    for t, cols in no_nulos.items():
        for c in cols:
            ejemplo = f"min({otros}) FILTER (periodo IS NULL)" if (t, c) == ("dim_tiempo", "periodo") else "CAST(NULL AS VARCHAR)"
            partes.append(fila("NOT NULL", t, c, f"COUNT(*) FILTER ({c} IS NULL)", t, ejemplo))
    for t, cols in longitudes.items():
        partes += [
            fila(f"LONGITUD {n}", t, c, f"COUNT(*) FILTER (length({c}) > {n})", t, f"min({c}) FILTER (length({c}) > {n})")
            for c, n in cols.items()
        ]
    for t, cols in unicos.items():
        texto = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
        con_valor = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        sub = f"(SELECT {texto} AS k FROM {t} WHERE {con_valor} GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1)"
        partes.append(fila("UNIQUE", t, ",".join(cols), "COUNT(*)", sub, "min(k)"))
    hechos = "fact_casos_fiscales"
    claves = {
        "id_tiempo": "anio",
        "id_distrito_fiscal": "distrito_fiscal",
        "id_tipo_fiscalia": "tipo_fiscalia",
        "id_materia": "materia",
        "id_especialidad": "especialidad",
        "id_tipo_caso": "tipo_caso",
        "casos_ingresados": "ingresado",
        "casos_atendidos": "atendido",
        "fecha_descarga": "fecha_descarga",
        "fecha_corte": "fecha_corte",
    }
    malas = {("NOT NULL", k): f"{c} IS NULL" for k, c in claves.items()} | {
        ("CHECK", "chk_casos_positivos"): "ingresado < 0 OR atendido < 0",
        ("CHECK", "chk_casos_logicos"): "atendido > ingresado",
        ("CHECK", "chk_fechas_logicas"): "fecha_corte < fecha_descarga",
    }
    partes += [
        fila(r, hechos, k, f"COUNT(*) FILTER ({c})", "casos", f"min({_HECHO}) FILTER ({c})") for (r, k), c in malas.items()
    ]
    fks = {
        "id_tiempo": ("anio", "dim_tiempo"),
        "id_distrito_fiscal": ("distrito_fiscal", "dim_distritos_fiscales"),
        "id_tipo_fiscalia": ("tipo_fiscalia", "dim_tipos_fiscalia"),
        "id_materia": ("materia", "dim_materias"),
        "id_especialidad": ("especialidad", "dim_especialidades"),
        "id_tipo_caso": ("tipo_caso", "dim_tipos_caso"),
        "id_fiscalia_especializada": ("especializada", "dim_fiscalias_especializadas"),
    }
    for k, (c, t) in fks.items():
        sub = f"(SELECT 1 FROM casos ANTI JOIN {t} USING ({c}) WHERE {c} IS NOT NULL)"
        partes.append(fila("FOREIGN KEY", hechos, k, "COUNT(*)", sub, _clave_quitada(quitadas, t)))
    partes.append(
        fila("FOREIGN KEY", "dim_distritos_fiscales", "id_ubicacion", "COUNT(*)",
             "(SELECT 1 FROM dim_distritos_fiscales ANTI JOIN dim_ubicaciones USING (ubigeo_pjfs))")
    )
    partes.append(
        fila("FOREIGN KEY", "dim_especialidades", "id_materia", "COUNT(*)",
             "(SELECT 1 FROM (SELECT DISTINCT especialidad, materia FROM casos WHERE especialidad IS NOT NULL AND materia IS NOT NULL) ANTI JOIN dim_materias USING (materia))",
             _clave_quitada(quitadas, "dim_materias"))
    )
    return con(ctes, "\nUNION ALL ".join(partes))


_NUEVAS = ("distrito_fiscal", "tipo_fiscalia", "materia", "especialidad", "tipo_caso", "especializada", "prov_pjfs")
# The rows of two loads: a third of the orders after 1997 has values that the first load lacks.
_CARGAS = CASOS + f""", v AS (
  SELECT * REPLACE ({', '.join(f"CASE WHEN anio > 1997 AND clave_orden % 3 = 0 THEN 'AA ' ELSE '' END || {c} AS {c}" for c in _NUEVAS)})
  FROM casos)
"""


def _claves() -> str:
    """Distinct natural keys of both loads together and of the first one; no key moves, is lost or given twice."""
    naturales = {
        "dim_ubicaciones": "ubigeo_pjfs, dpto_pjfs, prov_pjfs, dist_pjfs",
        "dim_tipos_fiscalia": "tipo_fiscalia",
        "dim_materias": "materia",
        "dim_tipos_caso": "tipo_caso",
        "dim_fiscalias_especializadas": "especializada",
        "dim_tiempo": "anio",
        "dim_distritos_fiscales": "distrito_fiscal, ubigeo_pjfs",
        "dim_especialidades": "especialidad",
    }
    filas = [
        f"""SELECT '{t}' AS tabla, (SELECT COUNT(*) FROM (SELECT DISTINCT {c} FROM v WHERE anio <= 1997)) AS filas_antes,
  (SELECT COUNT(*) FROM (SELECT DISTINCT {c} FROM v)) AS filas"""
        for t, c in naturales.items()
    ]
    ceros = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("movidas", "perdidas", "repetidas"))
    return con(_CARGAS, f"SELECT *, filas - filas_antes AS nuevas, {ceros}, filas AS ultima_clave FROM ({' UNION ALL '.join(filas)})")


def _bosquejos() -> str:
    partes = [
        f"""SELECT '{c}' AS variable, '{clase}' AS clase, {desde} AS desde, {hasta} AS hasta, COUNT({c}) AS filas, COUNT(DISTINCT {c}) AS exactos, true AS dentro
FROM casos WHERE anio BETWEEN {desde} AND {hasta}"""
        for desde, hasta in ((1995, 2001), (1997, 1998))
        for clase, columnas in (("distintos", ("distrito_fiscal", "materia", "especialidad", "tipo_caso")), ("cuantiles", ("ingresado", "atendido")))
        for c in columnas
    ]
    return con(CASOS, " UNION ALL ".join(partes))


ORACULOS = {
    "bosquejos_por_periodo": _bosquejos(),
    "claves_duraderas": _claves(),
    "almacen_incremental": con(
        _CARGAS,
        """SELECT anio, COUNT(*) AS filas, CAST(sum(ingresado) AS BIGINT) AS ingresado, CAST(sum(atendido) AS BIGINT) AS atendido,
  COUNT(*) AS filas_hechos, CAST(sum(ingresado) AS BIGINT) AS ingresado_hechos, CAST(sum(atendido) AS BIGINT) AS atendido_hechos,
  COUNT(*) FILTER (ingresado > 0 AND atendido >= 10 * ingresado) AS tasas_fuera_de_rango, COUNT(*) AS casos_distintos
FROM v GROUP BY anio""",
    ),
    "dim_tipos_caso": _simple("tipo_caso", f", {regla('tipo_caso', CATEGORIAS, 'PROCESO_GENERAL')} AS categoria"),
    "dim_fiscalias_especializadas": con(
        CASOS,
        f"""SELECT especializada, COUNT(*) AS frecuencia,
  COUNT(*) / CAST((SELECT COUNT(especializada) FROM casos) AS DOUBLE) * 100 AS porcentaje,
  {regla('especializada', AREAS, 'General')} AS area_especializacion
FROM casos WHERE especializada IS NOT NULL GROUP BY especializada""",
    ),
    "dim_materias": _simple("materia", ", COUNT(*) >= CAST((SELECT COUNT(*) FROM casos) AS DOUBLE) * CAST(0.05 AS DOUBLE) AS es_principal"),
    "dim_especialidades": con(CASOS, f"{_ESPECIALIDADES} SELECT * FROM e"),
    "especialidades_por_materia": con(
        CASOS, f"{_ESPECIALIDADES} SELECT materia_asociada, COUNT(*) AS valores FROM e GROUP BY 1"
    ),
    "dim_ubicaciones": con(
        CASOS,
        f"""SELECT DISTINCT ubigeo_pjfs, dpto_pjfs AS departamento, prov_pjfs AS provincia,
  dist_pjfs AS distrito, {_REGION} AS region_geografica FROM casos""",
    ),
    "dim_distritos": con(
        CASOS, "SELECT DISTINCT upper(distrito_fiscal) AS distrito_fiscal, ubigeo_pjfs, dpto_pjfs FROM casos"
    ),
    "distritos_por_departamento": con(
        CASOS, "SELECT dpto_pjfs, COUNT(DISTINCT upper(distrito_fiscal)) AS distritos FROM casos GROUP BY 1"
    ),
    "dim_tipos_fiscalia": _simple("tipo_fiscalia", f", {NIVEL.format(c='tipo_fiscalia')} AS nivel_jerarquico"),
    "tipos_caso_por_categoria": con(
        CASOS,
        f"""SELECT {regla('tipo_caso', CATEGORIAS, 'PROCESO_GENERAL')} AS categoria,
  COUNT(DISTINCT tipo_caso) AS valores FROM casos WHERE tipo_caso IS NOT NULL GROUP BY 1""",
    ),
    "dim_tiempo": con(
        CASOS,
        """SELECT anio, min(periodo) AS periodo, 1 AS mes_inicio, 12 AS mes_fin,
  CAST(dayofyear(make_date(anio, 12, 31)) AS INTEGER) AS total_dias FROM casos GROUP BY anio""",
    ),
    "especializacion": con(
        CASOS,
        """SELECT COUNT(especializada) AS casos_especializados,
  COUNT(*) - COUNT(especializada) AS casos_generales,
  COUNT(especializada) / CAST(COUNT(*) AS DOUBLE) * 100 AS porcentaje_especializacion FROM casos""",
    ),
    "rango_anios": con(CASOS, "SELECT CAST(min(anio) AS VARCHAR) || '-' || CAST(max(anio) AS VARCHAR) AS rango FROM casos"),
    "tipos_caso_frecuentes": con(
        CASOS,
        f"""SELECT tipo_caso, {_CUENTA}, {regla('tipo_caso', CATEGORIAS, 'PROCESO_GENERAL')} AS categoria
FROM casos WHERE tipo_caso IS NOT NULL GROUP BY tipo_caso ORDER BY frecuencia DESC, tipo_caso LIMIT 10""",
    ),
    "fiscalias_por_area": con(
        CASOS,
        f"""SELECT {regla('especializada', AREAS, 'General')} AS area_especializacion,
  COUNT(DISTINCT especializada) AS valores FROM casos WHERE especializada IS NOT NULL GROUP BY 1""",
    ),
    "ubicaciones_por_region": con(
        CASOS,
        f"""SELECT region_geografica, COUNT(*) AS valores FROM (
  SELECT DISTINCT ubigeo_pjfs, dpto_pjfs, prov_pjfs, dist_pjfs, {_REGION} AS region_geografica FROM casos) GROUP BY 1""",
    ),
    "control_hechos": con(
        CASOS,
        """, v AS (
  SELECT anio, ingresado, CASE WHEN clave_orden % 97 = 0 THEN ingresado * 12 ELSE atendido END AS atendido FROM casos)
SELECT anio, COUNT(*) AS filas, CAST(sum(ingresado) AS BIGINT) AS ingresado, CAST(sum(atendido) AS BIGINT) AS atendido,
  COUNT(*) AS filas_hechos, CAST(sum(ingresado) AS BIGINT) AS ingresado_hechos, CAST(sum(atendido) AS BIGINT) AS atendido_hechos,
  COUNT(*) FILTER (ingresado > 0 AND atendido >= 10 * ingresado) AS tasas_fuera_de_rango
FROM v GROUP BY anio""",
    ),
    "vista_completa": con(
        VISTA,
        """SELECT * EXCLUDE (tasa_e4, distrito_fiscal, departamento, provincia, distrito, especialidad),
  upper(especialidad) AS especialidad,
  upper(distrito_fiscal) AS distrito_fiscal, upper(departamento) AS departamento,
  upper(provincia) AS provincia, upper(distrito) AS distrito,
  tasa_e4 / CAST(10000 AS DOUBLE) AS tasa_atencion FROM vista""",
    ),
    "dq_violaciones": _dq(),
    "dq_sembradas": _dq(_SEMBRADOS, True),
}
