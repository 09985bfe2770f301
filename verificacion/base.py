"""Shared SQL text: the case table, its dirty form and helper expressions (DuckDB dialect)."""

from __future__ import annotations

# Word rules of the classes, stated here for themselves so that a wrong word in the library shows.
CATEGORIAS = (
    ("INGRESO", (("DENUNCIA",),)),
    ("RECURSO", (("APELACION",), ("QUEJA",))),
    ("PROCESO_FORMAL", (("PROCESO",),)),
)
AREAS = (
    ("Anticorrupción", (("CORRUPCION",),)),
    ("Medio Ambiente", (("AMBIENTAL",), ("AMBIENTE",))),
    ("Crimen Organizado", (("CRIMINALIDAD",),)),
    ("Trafico ilicito de drogas", (("DROGAS",), ("TRAFICO",))),
    ("Violencia de Género", (("VIOLENCIA", "MUJER"),)),
    ("Lavado de Activos", (("LAVADO", "ACTIVOS"),)),
    ("Propiedad Intelectual", (("ADUANEROS",), ("PROPIEDAD INTELECTUAL",))),
    ("Trata de Personas", (("TRATA", "PERSONAS"),)),
    ("Tránsito y Seguridad Vial", (("TRANSITO",), ("VIAL",))),
    ("Tributario", (("TRIBUTARIOS",),)),
    ("Turismo", (("TURISMO",),)),
)
REGIONES = (
    ("NORTE", ("TUMBES", "PIURA", "LAMBAYEQUE", "LA LIBERTAD", "CAJAMARCA", "AMAZONAS")),
    ("CENTRO", ("ANCASH", "LIMA", "CALLAO", "ICA", "HUANCAVELICA", "JUNIN", "PASCO")),
    ("SUR", ("AREQUIPA", "MOQUEGUA", "TACNA", "CUSCO", "APURIMAC", "AYACUCHO", "PUNO")),
    ("SELVA", ("LORETO", "UCAYALI", "MADRE DE DIOS", "SAN MARTIN", "HUANUCO")),
)

CASOS = """
casos AS (
  SELECT
    'ENERO - DICIEMBRE' AS periodo,
    CAST(year(o_orderdate) AS INTEGER) AS anio,
    CASE WHEN l_orderkey % 50 = 0 THEN CAST(l_shipdate AS DATE)
         ELSE make_date(CAST(year(o_orderdate) + 1 AS INTEGER), 1, 31) END AS fecha_descarga,
    CAST(l_shipdate AS DATE) AS fecha_corte,
    s_name AS distrito_fiscal, l_returnflag AS tipo_fiscalia, p_type AS materia,
    p_type || ' ' || p_brand AS especialidad, o_orderpriority AS tipo_caso,
    CASE WHEN c_mktsegment IS NULL OR c_mktsegment IN ('MACHINERY', 'BUILDING')
         THEN 'NO_TIPO_ESPECIALIZADA' ELSE c_mktsegment END AS especializada,
    ingresado,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 0
         ELSE CAST(floor(ingresado * (CAST(1 AS DOUBLE) - CAST(3 AS DOUBLE) * l_discount)) AS INTEGER)
    END AS atendido,
    CAST((s_nationkey + 1) * 10000 + s_suppkey % 50 AS INTEGER) AS ubigeo_pjfs,
    n_name AS dpto_pjfs,
    n_name || ' ' || CAST(s_suppkey % 5 AS VARCHAR) AS prov_pjfs,
    n_name || '-' || CAST(s_suppkey % 50 AS VARCHAR) AS dist_pjfs,
    r_name AS region_geografica,
    l_orderkey AS clave_orden
  FROM (SELECT *, CAST(floor(l_quantity * l_quantity * l_quantity * l_quantity
                             / CAST(500 AS DOUBLE)) AS INTEGER) AS ingresado FROM lineitem) l
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""

# Published names, stated here for themselves.
TIPOS_CASO = (
    "APELACION DENUNCIA", "APELACION EXPEDIENTE", "CONSULTAS", "CONTIENDA", "DENUNCIA", "EXCLUSION FISCAL", "EXPEDIENTE", "INCIDENTE",
    "INCIDENTE-EXPEDIENTE", "INVESTIGACION PREVENTIVA", "PROCESO CIVIL", "PROCESO CONTENCIOSO", "PROCESO FAMILIA", "PROCESO PENAL", "QUEJAS",
)
ESPECIALIZADAS = (
    "CONTRA LA CRIMINALIDAD ORGANIZADA", "CRIMINALIDAD ORGANIZADA", "DELITOS ADUANEROS Y CONTRA LA PROPIEDAD INTELECTUAL", "DELITOS DE CIBERDELINCUENCIA",
    "DELITOS DE CORRUPCION DE FUNCIONARIOS", "DELITOS DE TRAFICO ILICITO DE DROGAS", "DELITOS DE TRATA DE PERSONAS", "DELITOS TRIBUTARIOS",
    "LAVADO DE ACTIVOS Y PERDIDA DE DOMINIO", "MATERIA AMBIENTAL", "NO_TIPO_ESPECIALIZADA", "TRANSITO Y SEGURIDAD VIAL", "TURISMO",
    "VIOLENCIA CONTRA LA MUJER Y LOS INTEGRANTES DEL GRUPO FAMILIAR",
)
DEPARTAMENTOS = (
    "AMAZONAS", "ANCASH", "APURIMAC", "AREQUIPA", "AYACUCHO", "CAJAMARCA", "CALLAO", "CUSCO", "HUANCAVELICA", "HUANUCO", "ICA", "JUNIN",
    "LA LIBERTAD", "LAMBAYEQUE", "LIMA", "LORETO", "MADRE DE DIOS", "MOQUEGUA", "PASCO", "PIURA", "PUNO", "SAN MARTIN", "TACNA", "TUMBES", "UCAYALI",
)


def _lista(valores) -> str:
    return "[" + ", ".join(f"'{v}'" for v in valores) + "]"


# The case table with published names and planted measures, in place of ``casos``.
PUBLICADOS = CASOS.replace("casos AS (", "sin_nombres AS (", 1) + f""",
casos AS (
  SELECT * REPLACE (
    {_lista(TIPOS_CASO)}[clave_orden % 15 + 1] AS tipo_caso,
    {_lista(ESPECIALIZADAS)}[clave_orden % 14 + 1] AS especializada,
    'FISCALIA ' || CASE WHEN clave_orden % 10 = 0 THEN 'ESPECIAL' ELSE ['PROVINCIAL', 'SUPERIOR', 'SUPREMA'][clave_orden % 3 + 1] END AS tipo_fiscalia,
    CASE WHEN ubigeo_pjfs % 7 = 0 THEN 'EXTERIOR' ELSE {_lista(DEPARTAMENTOS)}[ubigeo_pjfs // 10000] END AS dpto_pjfs,
    CASE WHEN clave_orden % 211 = 0 THEN CASE WHEN clave_orden % 499 = 0 THEN 10 ELSE 1 END * ingresado * 3 + 1 ELSE atendido END AS atendido,
    CASE WHEN clave_orden % 499 = 0 THEN ingresado * 10 ELSE ingresado END AS ingresado)
  FROM sin_nombres
)"""


# Rounded ratio of integers, half up, as an integer number of 1/escala.
def ent(num: str, den: str, escala: int) -> str:
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return f"((2 * {escala} * {n} + {d}) // nullif(2 * {d}, 0))"


def razon(num: str, den: str) -> str:
    return f"(CASE WHEN {den} > 0 THEN CAST({ent(num, den, 10000)} AS DOUBLE) ELSE 0 END / CAST(10000 AS DOUBLE))"


def pct(num: str, den: str) -> str:
    return f"(CAST({ent(num, den, 10000)} AS DOUBLE) / CAST(100 AS DOUBLE))"


def prom2(num: str, den: str) -> str:
    return f"(CAST({ent(num, den, 100)} AS DOUBLE) / CAST(100 AS DOUBLE))"


def regla(col: str, reglas, resto: str) -> str:
    """CASE over word rules: (class, alternatives of words that must all occur)."""
    ramas = []
    for clase, alternativas in reglas:
        cond = " OR ".join(
            "(" + " AND ".join(f"contains(upper({col}), '{p}')" for p in alt) + ")"
            for alt in alternativas
        )
        ramas.append(f"WHEN {cond} THEN '{clase}'")
    return f"CASE WHEN {col} IS NULL THEN NULL {' '.join(ramas)} ELSE '{resto}' END"


# Cuts and labels of the classes.
EFICIENCIA = (
    "CASE WHEN {c} >= 0.95 THEN 'Excelente' WHEN {c} >= 0.85 THEN 'Bueno' "
    "WHEN {c} >= 0.70 THEN 'Regular' ELSE 'Deficiente' END"
)
VOLUMEN = (
    "CASE WHEN {c} >= 10000 THEN 'Muy Alto{s}' WHEN {c} >= 5000 THEN 'Alto{s}' "
    "WHEN {c} >= 1000 THEN 'Medio{s}' ELSE 'Bajo{s}' END"
)
TRAMO_VOLUMEN = (
    "CASE WHEN {c} <= 0 THEN NULL WHEN {c} <= 10 THEN 'Muy Bajo' WHEN {c} <= 50 THEN 'Bajo' "
    "WHEN {c} <= 200 THEN 'Medio' WHEN {c} <= 1000 THEN 'Alto' ELSE 'Muy Alto' END"
)
TRAMO_EFICIENCIA = (
    "CASE WHEN {c} IS NULL OR {c} <= 0 THEN NULL WHEN {c} <= 0.5 THEN 'Muy Baja (<0.5)' "
    "WHEN {c} <= 0.8 THEN 'Baja (0.5-0.8)' WHEN {c} <= 1.0 THEN 'Buena (0.8-1.0)' "
    "WHEN {c} <= 1.2 THEN 'Excelente (1.0-1.2)' ELSE 'Excepcional (>1.2)' END"
)

NIVEL = (
    "CAST(CASE WHEN {c} IS NULL THEN NULL WHEN contains(upper({c}), 'SUPREMA') THEN 1 "
    "WHEN contains(upper({c}), 'SUPERIOR') THEN 2 "
    "WHEN contains(upper({c}), 'PROVINCIAL') THEN 3 ELSE 4 END AS INTEGER)"
)

VISTA = CASOS + f""",
vista AS (
  SELECT anio, periodo, distrito_fiscal, dpto_pjfs AS departamento, prov_pjfs AS provincia,
    dist_pjfs AS distrito, ubigeo_pjfs, region_geografica, tipo_fiscalia,
    {NIVEL.format(c='tipo_fiscalia')} AS nivel_jerarquico,
    materia, especialidad, tipo_caso,
    {regla('tipo_caso', CATEGORIAS, 'PROCESO_GENERAL')} AS categoria_caso,
    nullif(especializada, 'NO_TIPO_ESPECIALIZADA') AS fiscalia_especializada,
    {regla("nullif(especializada, 'NO_TIPO_ESPECIALIZADA')", AREAS, 'General')} AS area_especializacion,
    ingresado AS casos_ingresados, atendido AS casos_atendidos,
    ingresado - atendido AS casos_pendientes,
    CAST(CASE WHEN ingresado > 0 THEN {ent('atendido', 'ingresado', 10000)} ELSE 0 END AS BIGINT) AS tasa_e4,
    fecha_descarga, fecha_corte
  FROM casos
)"""

# Flat table with the derived metrics of the exploratory analysis.
DERIVADA = CASOS + f""",
d AS (
  SELECT *, CAST(year(fecha_descarga) AS INTEGER) AS anio_descarga,
    CASE WHEN ingresado > 0 THEN CAST(atendido AS DOUBLE) / CAST(ingresado AS DOUBLE) END AS tasa_atencion,
    ingresado - atendido AS casos_pendientes,
    {TRAMO_VOLUMEN.format(c='ingresado')} AS volumen_ingresado
  FROM casos
)"""


def con(ctes: str, consulta: str) -> str:
    return f"WITH {ctes}\n{consulta}"
