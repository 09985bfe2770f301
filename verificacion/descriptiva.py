"""Oracle SQL of the descriptive statistics."""

from __future__ import annotations

from balanza.functions.clases import CONCENTRACION, RESTO_CONCENTRACION
from verificacion.base import DERIVADA, con

_NUM = ["anio", "ingresado", "atendido"]
_CAT = [
    "distrito_fiscal", "tipo_fiscalia", "materia", "especialidad", "tipo_caso", "especializada",
    "dpto_pjfs", "prov_pjfs",
]
_VARS = ["ingresado", "atendido", "tasa_atencion", "casos_pendientes"]


def union(plantilla: str, columnas: list[str]) -> str:
    return "\nUNION ALL ".join(plantilla.format(c=c) for c in columnas)


_LARGA = ", l AS (" + union("SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM d", _NUM) + ")"
# Population moments written out: the engine's own skewness is the sample version.
_MOM = """
, mu AS (SELECT variable, avg(v) AS m, COUNT(v) AS n FROM l GROUP BY variable),
mo AS (
  SELECT variable, any_value(m) AS m, any_value(n) AS n, SUM((v - m) ** 2) AS m2, SUM((v - m) ** 3) AS m3, SUM((v - m) ** 4) AS m4
  FROM l JOIN mu USING (variable) GROUP BY variable),
fo AS (
  SELECT variable, n, (m3 / n) / ((m2 / n) * sqrt(m2 / n)) AS sk, (m4 / n) / ((m2 / n) ** 2) - 3 AS ku FROM mo)
"""
_JB = "(n / CAST(6 AS DOUBLE) * (sk * sk + ku * ku / CAST(4 AS DOUBLE)))"

# Error function of x with t = 1 / (1 + 0.3275911 x), to 1.5e-7.
_ERF = ("1 - ((((CAST(1.061405429 AS DOUBLE) * t - CAST(1.453152027 AS DOUBLE)) * t + CAST(1.421413741 AS DOUBLE)) * t - CAST(0.284496736 AS DOUBLE)) * t"
        " + CAST(0.254829592 AS DOUBLE)) * t * exp(-x * x)")

_PERFIL = f"""{_LARGA}{_MOM},
q AS (
  SELECT variable, COUNT(v) AS c, avg(v) AS media, stddev_samp(v) AS s, min(v) AS mn, max(v) AS mx, SUM(v) AS suma,
    quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
    quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95,
    COUNT(*) FILTER (v = 0) AS ceros, COUNT(*) FILTER (v < 0) AS neg, COUNT(*) FILTER (v IS NULL) AS nulos, COUNT(*) AS filas
  FROM l GROUP BY variable),
ex AS (SELECT variable, COUNT(*) FILTER (v > q95) AS altos, COUNT(*) FILTER (v < q05) AS bajos FROM l JOIN q USING (variable) GROUP BY variable),
md AS (SELECT variable, v AS moda FROM (SELECT variable, v, row_number() OVER (PARTITION BY variable ORDER BY COUNT(*) DESC, v) AS k
  FROM l WHERE v IS NOT NULL GROUP BY variable, v) WHERE k = 1),
tp AS (SELECT variable, SUM(v) AS top FROM (SELECT variable, v, row_number() OVER (PARTITION BY variable ORDER BY v DESC) AS k FROM l) WHERE k <= 10 GROUP BY variable)
SELECT variable, c AS count, round(media, 6) AS mean, q50 AS median, moda AS mode, round(s, 6) AS std, mn AS min, mx AS max, q25, q75,
  mx - mn AS range, q75 - q25 AS iqr, round(CASE WHEN media <> 0 THEN s / media ELSE 0 END, 6) AS coefficient_variation,
  round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, ceros AS zeros_count,
  round(ceros / CAST(c AS DOUBLE) * 100, 6) AS zeros_percentage, neg AS negative_count, nulos AS missing_count,
  round(nulos / CAST(filas AS DOUBLE) * 100, 6) AS missing_percentage,
  round(exp(-{_JB} / 2), 6) AS normalidad_p, exp(-{_JB} / 2) > 0.05 AS es_normal,
  CASE WHEN variable <> 'anio' THEN altos END AS casos_extremos_altos,
  CASE WHEN variable <> 'anio' THEN bajos END AS casos_extremos_bajos,
  CASE WHEN variable <> 'anio' THEN round(top / suma * 100, 6) END AS concentracion_top10
FROM q JOIN fo USING (variable) JOIN ex USING (variable) JOIN md USING (variable) JOIN tp USING (variable)"""

_NIVELES = " ".join(f"WHEN tres * 100 >= {c} * tot THEN '{t}'" for c, t in CONCENTRACION)
_CATEG = f"""
, f AS ({union("SELECT '{c}' AS variable, {c} AS v, COUNT(*) AS n FROM d GROUP BY {c}", _CAT)}),
g AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, v) AS k,
        row_number() OVER (PARTITION BY variable ORDER BY n) AS i FROM f WHERE v IS NOT NULL),
t AS (
  SELECT variable, COUNT(*) AS u, SUM(n) AS tot,
    any_value(v) FILTER (k = 1) AS moda, any_value(n) FILTER (k = 1) AS fm,
    SUM(n) FILTER (k <= 3) AS tres,
    string_agg(v || ': ' || n, '; ' ORDER BY k) FILTER (k <= 3) AS txt,
    2 * SUM(i * n) / CAST(COUNT(*) * SUM(n) AS DOUBLE) - (COUNT(*) + 1) / CAST(COUNT(*) AS DOUBLE) AS gini
  FROM g GROUP BY variable),
e AS (SELECT g.variable, -SUM(n / CAST(tot AS DOUBLE) * ln(n / CAST(tot AS DOUBLE))) AS ent FROM g JOIN t USING (variable) GROUP BY 1),
a AS (SELECT variable, SUM(n) AS filas, coalesce(SUM(n) FILTER (v IS NULL), 0) AS nulos FROM f GROUP BY variable)
SELECT variable, u AS unique_values, CAST(nulos AS BIGINT) AS missing_count,
  round(CAST(nulos AS DOUBLE) / CAST(filas AS DOUBLE) * 100, 6) AS missing_percentage, moda AS mode, fm AS mode_frequency,
  round(fm / CAST(filas AS DOUBLE) * 100, 6) AS mode_percentage,
  round(CASE WHEN u > 1 THEN ent ELSE 0 END, 6) AS entropy, round(gini, 6) AS gini_concentration, txt AS top_3_values,
  round(CAST(tres AS DOUBLE) / CAST(filas AS DOUBLE) * 100, 6) AS top_3_percentage,
  CASE {_NIVELES} ELSE '{RESTO_CONCENTRACION}' END AS interpretacion_concentracion
FROM t JOIN e USING (variable) JOIN a USING (variable)"""

# Two-sided p of a slope over seven yearly points (five degrees of freedom).
ANUAL = """
, an AS (SELECT anio, SUM(ingresado) AS ingresado, SUM(atendido) AS atendido FROM d GROUP BY anio),
sl AS (
  SELECT 'ingresado' AS variable, anio, CAST(ingresado AS DOUBLE) AS valor, row_number() OVER (ORDER BY anio) - 1 AS x FROM an
  UNION ALL SELECT 'atendido', anio, CAST(atendido AS DOUBLE), row_number() OVER (ORDER BY anio) - 1 FROM an),
tr AS (
  SELECT variable, regr_slope(valor, x) AS b, regr_r2(valor, x) AS r2, COUNT(*) AS n, stddev_samp(valor) AS s,
    stddev_pop(valor) AS sp, avg(valor) AS m,
    arg_min(valor, anio) AS v0, arg_max(valor, anio) AS v1 FROM sl GROUP BY variable),
th AS (SELECT *, atan(sqrt(r2 / (1 - r2))) AS o FROM tr),
tend AS (
  SELECT *, 1 - (2 / pi()) * (o + sin(o) * (cos(o) + CAST(2 AS DOUBLE) / 3 * cos(o) ** 3)) AS p FROM th)
"""


def par(a: str, b: str) -> str:
    return f"corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END)"


def _pearson() -> str:
    filas = [
        f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r FROM d"
        for a in _VARS for b in _VARS
    ]
    return "\nUNION ALL ".join(filas)


def _rango(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE))"


def _spearman() -> str:
    otras = [v for v in _VARS if v != "tasa_atencion"]
    ctes = (
        ", ra AS (SELECT " + ", ".join(f"{_rango(v)} AS {v}" for v in otras) + " FROM d)"
        ", rv AS (SELECT " + ", ".join(f"{_rango(v)} AS {v}" for v in _VARS)
        + " FROM d WHERE tasa_atencion IS NOT NULL)"
    )
    filas = []
    for a in _VARS:
        for b in _VARS:
            t = "rv" if "tasa_atencion" in (a, b) else "ra"
            filas.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r FROM {t}")
    return ctes + ", sp AS (" + "\nUNION ALL ".join(filas) + ")"


_FUERTES = """
, o AS (SELECT * FROM (VALUES ('ingresado', 1), ('atendido', 2), ('tasa_atencion', 3), ('casos_pendientes', 4)) t(v, k))
SELECT '{metodo}' AS metodo, var1 AS variable1, var2 AS variable2, r AS correlacion,
  CASE WHEN abs(r) >= 0.9 THEN 'Muy fuerte' WHEN abs(r) >= 0.7 THEN 'Fuerte' WHEN abs(r) >= 0.5 THEN 'Moderada'
       WHEN abs(r) >= 0.3 THEN 'Débil' ELSE 'Muy débil' END AS fuerza,
  CASE WHEN r > 0 THEN 'Positiva' ELSE 'Negativa' END AS direccion
FROM {m} JOIN o a ON a.v = var1 JOIN o b ON b.v = var2 WHERE a.k < b.k AND abs(r) >= 0.5"""

_TOTAL_COLUMNAS = 16 + 2 + 8

ORACULOS = {
    "resumen_inicial": con(
        DERIVADA,
        """SELECT min(anio) AS anio_min, max(anio) AS anio_max, COUNT(*) AS total_registros,
  COUNT(DISTINCT distrito_fiscal) AS distritos, COUNT(DISTINCT materia) AS materias,
  CAST(SUM(ingresado) AS BIGINT) AS total_ingresados, CAST(SUM(atendido) AS BIGINT) AS total_atendidos,
  round(SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE * 100, 6) AS tasa_global_pct,
  COUNT(*) FILTER (ingresado = 0) AS sin_ingreso, round(COUNT(*) FILTER (ingresado = 0) / COUNT(*)::DOUBLE * 100, 6) AS sin_ingreso_pct,
  COUNT(*) FILTER (atendido = 0) AS sin_atencion, round(COUNT(*) FILTER (atendido = 0) / COUNT(*)::DOUBLE * 100, 6) AS sin_atencion_pct,
  COUNT(*) FILTER (atendido > ingresado) AS sobreatendidos,
  round(COUNT(*) FILTER (atendido > ingresado) / COUNT(*)::DOUBLE * 100, 6) AS sobreatendidos_pct FROM d""",
    ),
    "resumen_general": con(
        DERIVADA,
        f"""SELECT COUNT(*) AS total_registros, min(anio) AS periodo_inicio, max(anio) AS periodo_fin,
  COUNT(DISTINCT distrito_fiscal) AS total_distritos, COUNT(DISTINCT dpto_pjfs) AS total_departamentos,
  CAST(SUM(ingresado) AS BIGINT) AS casos_totales_ingresados, CAST(SUM(atendido) AS BIGINT) AS casos_totales_atendidos,
  round(SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE, 6) AS tasa_atencion_global,
  round((1 - SUM(CAST(tasa_atencion IS NULL AS INTEGER) + CAST(volumen_ingresado IS NULL AS INTEGER))::DOUBLE
        / (COUNT(*) * {_TOTAL_COLUMNAS})::DOUBLE) * 100, 6) AS completitud_datos FROM d""",
    ),
    "perfil_eda_numerico": con(DERIVADA, _PERFIL),
    "normalidad": con(
        DERIVADA,
        f"""{_LARGA}{_MOM},
ds AS (
  SELECT variable, v, SUM(k) OVER (PARTITION BY variable ORDER BY v) - k AS previos, k, SUM(k) OVER (PARTITION BY variable) AS total
  FROM (SELECT variable, v, COUNT(*) AS k FROM l WHERE v IS NOT NULL GROUP BY variable, v)),
zs AS (SELECT ds.*, (v - media) / s AS z FROM ds JOIN (SELECT variable, avg(v) AS media, stddev_samp(v) AS s FROM l GROUP BY variable) USING (variable)),
ts AS (SELECT *, abs(z) / sqrt(CAST(2 AS DOUBLE)) AS x, 1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(z) / sqrt(CAST(2 AS DOUBLE))) AS t FROM zs),
es AS (SELECT *, {_ERF} AS erf FROM ts),
fs AS (SELECT *, CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CASE WHEN z < 0 THEN -erf ELSE erf END AS fi FROM es),
ks AS (SELECT variable, max(greatest(abs(previos / total - fi), abs((previos + k) / total - fi))) AS ks, any_value(total) AS total FROM fs GROUP BY variable),
pl AS (SELECT variable, ks, total, least(total, 100) AS nd, CASE WHEN total > 100 THEN ks * pow(total / CAST(100 AS DOUBLE), 0.49) ELSE ks END AS dd,
  (sqrt(total) - 0.01 + 0.85 / sqrt(total)) * ks AS kk FROM ks),
pd AS (SELECT *, exp(-7.01256 * dd * dd * (nd + 2.78019) + 2.99587 * dd * sqrt(nd + 2.78019) - 0.122119 + 0.974598 / sqrt(nd) + 1.67997 / nd) AS p FROM pl),
pk AS (SELECT *, CASE WHEN p <= 0.1 THEN p WHEN kk <= 0.302 THEN 1
  WHEN kk <= 0.5 THEN 2.76773 - 19.828315 * kk + 80.709644 * kk ** 2 - 138.55152 * kk ** 3 + 81.218052 * kk ** 4
  WHEN kk <= 0.9 THEN -4.901232 + 40.662806 * kk - 97.490286 * kk ** 2 + 94.029866 * kk ** 3 - 32.355711 * kk ** 4
  WHEN kk <= 1.31 THEN 6.198765 - 19.558097 * kk + 23.186922 * kk ** 2 - 12.234627 * kk ** 3 + 2.423045 * kk ** 4 ELSE 0 END AS ks_p FROM pd)
SELECT variable, n AS conteo, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, round({_JB}, 4) AS jb,
  round(exp(-{_JB} / 2), 6) AS p_valor, exp(-{_JB} / 2) > 0.05 AS es_normal, round(ks, 6) AS ks, round(ks_p, 6) AS ks_p, ks_p > 0.05 AS es_normal_ks
FROM fo JOIN pk USING (variable)""",
    ),
    "perfil_eda_categorico": con(DERIVADA, _CATEG),
    "metricas_eficiencia": con(
        DERIVADA,
        """SELECT round(avg(tasa_atencion), 6) AS tasa_atencion_promedio,
  round(quantile_cont(tasa_atencion, 0.5), 6) AS tasa_atencion_mediana,
  COUNT(*) FILTER (tasa_atencion >= 1) AS casos_eficiencia_perfecta,
  round(COUNT(*) FILTER (tasa_atencion >= 1) / COUNT(*)::DOUBLE * 100, 6) AS casos_eficiencia_perfecta_pct,
  COUNT(*) FILTER (tasa_atencion < 0.5) AS casos_baja_eficiencia,
  round(COUNT(*) FILTER (tasa_atencion < 0.5) / COUNT(*)::DOUBLE * 100, 6) AS casos_baja_eficiencia_pct
FROM d WHERE tasa_atencion IS NOT NULL""",
    ),
    "metricas_volumen": con(
        DERIVADA,
        """SELECT COUNT(*) FILTER (volumen_ingresado = 'Muy Bajo') AS muy_bajo, COUNT(*) FILTER (volumen_ingresado = 'Bajo') AS bajo,
  COUNT(*) FILTER (volumen_ingresado = 'Medio') AS medio, COUNT(*) FILTER (volumen_ingresado = 'Alto') AS alto,
  COUNT(*) FILTER (volumen_ingresado = 'Muy Alto') AS muy_alto, COUNT(*) FILTER (ingresado > 1000) AS casos_alto_volumen,
  COUNT(*) FILTER (ingresado <= 10) AS casos_bajo_volumen,
  round((SELECT SUM(t) FROM (SELECT SUM(ingresado) AS t FROM d GROUP BY distrito_fiscal ORDER BY t DESC LIMIT 10))::DOUBLE
        / SUM(ingresado)::DOUBLE * 100, 6) AS concentracion_top_10_distritos FROM d""",
    ),
    "metricas_temporales": con(
        DERIVADA,
        f"""{ANUAL}
SELECT variable, round(b, 4) AS pendiente, round(r2, 6) AS r_cuadrado, round(p, 6) AS p_valor, p < 0.05 AS es_significativa,
  CASE WHEN b > 0 THEN 'Creciente' WHEN b < 0 THEN 'Decreciente' ELSE 'Estable' END AS direccion,
  round(s, 4) AS variabilidad_anual, round((v1 - v0) / v0 * 100, 6) AS crecimiento_total FROM tend""",
    ),
    "correlacion_pearson": con(DERIVADA, _pearson()),
    "correlacion_spearman": con(DERIVADA, _spearman() + " SELECT * FROM sp"),
    "correlaciones_fuertes": con(
        DERIVADA,
        _spearman() + ", pe AS (" + _pearson() + ")" + _FUERTES.format(metodo="pearson", m="pe")
        + " UNION ALL " + _FUERTES.format(metodo="spearman", m="sp").split("t(v, k))", 1)[1],
    ),
    "correlaciones_principales": con(
        DERIVADA,
        ", pe AS (" + _pearson() + ")" + _FUERTES.format(metodo="pearson", m="pe").replace("'pearson' AS metodo, ", "")
        + " ORDER BY abs(correlacion) DESC, variable1, variable2 LIMIT 3",
    ),
    "mapa_correlacion_spearman": con(
        DERIVADA,
        _spearman() + """, o AS (SELECT * FROM (VALUES ('ingresado', 1), ('atendido', 2), ('tasa_atencion', 3), ('casos_pendientes', 4)) t(v, k))
SELECT var1, var2, r FROM sp JOIN o a ON a.v = var1 JOIN o b ON b.v = var2 WHERE a.k > b.k""",
    ),
    "mapa_correlacion": con(
        DERIVADA,
        f""", pe AS ({_pearson()}), o AS (SELECT * FROM (VALUES ('ingresado', 1), ('atendido', 2), ('tasa_atencion', 3), ('casos_pendientes', 4)) t(v, k))
SELECT var1, var2, r FROM pe JOIN o a ON a.v = var1 JOIN o b ON b.v = var2 WHERE a.k > b.k""",
    ),
}
