"""Oracle SQL of patterns, outliers and chart data."""

from __future__ import annotations

from verificacion.base import DERIVADA, TRAMO_EFICIENCIA, con
from verificacion.descriptiva import ANUAL, union

_ESP = "especializada <> 'NO_TIPO_ESPECIALIZADA'"


def r3(e: str) -> str:
    return f"(round_even(({e}) * 1000, 0) / CAST(1000 AS DOUBLE))"


def r6(e: str) -> str:
    return f"round({e}, 6)"


_DEP = """
, dep AS (SELECT dpto_pjfs, SUM(ingresado) AS total FROM d GROUP BY dpto_pjfs),
o AS (SELECT *, row_number() OVER (ORDER BY total DESC, dpto_pjfs) AS k, row_number() OVER (ORDER BY total) AS i FROM dep)
"""
_EXTREMOS = """
, e AS (SELECT {k} AS clave, avg(tasa_atencion) AS media, SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE AS tasa FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY media DESC, clave) AS a, row_number() OVER (ORDER BY media, clave DESC) AS z FROM e)
"""

_LARGA = ", l AS (" + union("SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v, d.* FROM d", ["anio", "ingresado", "atendido"]) + ")"

_IQR = f"""{_LARGA},
q AS (SELECT variable, quantile_cont(v, 0.25) - 1.5::DOUBLE * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS li,
        quantile_cont(v, 0.75) + 1.5::DOUBLE * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS ls FROM l GROUP BY variable),
m AS (SELECT variable, v, v < li OR v > ls AS fuera FROM l JOIN q USING (variable))"""

_MAD = f"""{_LARGA},
q AS (SELECT variable, quantile_cont(v, 0.5) AS med FROM l GROUP BY variable),
q2 AS (SELECT variable, any_value(med) AS med, quantile_cont(abs(v - med), 0.5) AS mad FROM l JOIN q USING (variable) GROUP BY variable),
m AS (SELECT variable, v, abs(CAST(0.6745 AS DOUBLE) * (v - med) / mad) > 3.5 AS fuera FROM l JOIN q2 USING (variable) WHERE mad > 0)"""

_RESUMEN = """
, t AS (SELECT variable, COUNT(*) AS total_valores, COUNT(*) FILTER (fuera) AS conteo FROM m GROUP BY variable),
x AS (SELECT variable, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ', ' ORDER BY v DESC) AS valores_extremos
  FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY v DESC) AS k FROM m WHERE fuera) WHERE k <= 5 GROUP BY variable)
"""
_PCT = "conteo / CAST(total_valores AS DOUBLE) * 100"
_ETI_IQR = f"CASE WHEN variable = 'anio' THEN 'detectados' WHEN {_PCT} > 10 THEN 'alta' WHEN {_PCT} > 5 THEN 'moderada' ELSE 'baja' END"
_ETI_MAD = f"CASE WHEN {_PCT} > 15 THEN 'muchos' WHEN {_PCT} > 5 THEN 'algunos' ELSE 'pocos' END"


def _salida(eti: str) -> str:
    return f"""SELECT variable, total_valores, conteo, {r6(_PCT)} AS porcentaje,
  coalesce(valores_extremos, '') AS valores_extremos, {eti} AS interpretacion FROM t LEFT JOIN x USING (variable)"""


_CTX = """
, u AS (SELECT quantile_cont(CAST(ingresado AS DOUBLE), 0.5) AS med, quantile_cont(CAST(ingresado AS DOUBLE), 0.99) AS p99 FROM d),
c AS (
  SELECT 'sobre_atencion_extrema' AS tipo, tasa_atencion AS mm, d.* FROM d WHERE atendido > ingresado * 2
  UNION ALL SELECT 'volumen_extremo', CAST(ingresado AS DOUBLE), d.* FROM d, u WHERE ingresado > p99
  UNION ALL SELECT 'sin_atencion_alto_volumen', CAST(ingresado AS DOUBLE), d.* FROM d, u WHERE atendido = 0 AND ingresado > med)
"""

# Long form of the charted variables: both measures and rates up to 3.
_G = ", g AS (" + union("SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM d", ["ingresado", "atendido"]) + \
    " UNION ALL SELECT 'tasa_atencion', tasa_atencion FROM d WHERE tasa_atencion <= 3)"


def _cajas(origen: str, claves: str) -> str:
    return f"""
, q AS (SELECT {claves}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS mediana, quantile_cont(v, 0.75) AS q3 FROM {origen} GROUP BY {claves}),
w AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS li, q3 + 1.5::DOUBLE * (q3 - q1) AS ls FROM q)
SELECT {claves}, round(any_value(q1), 6) AS q1, round(any_value(mediana), 6) AS mediana, round(any_value(q3), 6) AS q3,
  round(min(v) FILTER (v >= li AND v <= ls), 6) AS bigote_inferior, round(max(v) FILTER (v >= li AND v <= ls), 6) AS bigote_superior,
  COUNT(*) FILTER (v < li OR v > ls) AS outliers, round(COUNT(*) FILTER (v < li OR v > ls) / COUNT(*)::DOUBLE * 100, 6) AS outliers_pct
FROM {origen} JOIN w USING ({claves}) GROUP BY {claves}"""


_KDE = f"""{_G},
s AS (SELECT variable, COUNT(*) AS n, stddev_samp(v) * COUNT(*)::DOUBLE ** (-0.2::DOUBLE) AS h, min(v) AS lo, max(v) AS hi FROM g GROUP BY variable),
f AS (SELECT variable, v, COUNT(*) AS k FROM g GROUP BY ALL),
r AS (SELECT s.*, punto, lo + punto * (hi - lo) / 99 AS x FROM s, (SELECT CAST(range AS INTEGER) AS punto FROM range(100)))
SELECT variable, punto, round(any_value(x), 6) AS x,
  round(SUM(k * exp(-0.5::DOUBLE * ((x - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS densidad
FROM r JOIN f USING (variable) GROUP BY variable, punto"""

_REG = """
SELECT COUNT(*) AS puntos, round(regr_slope(tasa_atencion, ingresado), 9) AS pendiente,
  round(regr_intercept(tasa_atencion, ingresado), 6) AS intercepto, round(corr(tasa_atencion, ingresado), 6) AS r,
  round(regr_r2(tasa_atencion, ingresado), 6) AS r_cuadrado, CAST(max(ingresado) AS DOUBLE) AS x_max
FROM d WHERE tasa_atencion IS NOT NULL"""

_MATERIAS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

ORACULOS = {
    "concentracion_departamental": con(
        DERIVADA,
        f"""{_DEP}
SELECT (SELECT string_agg(dpto_pjfs || ': ' || total, '; ' ORDER BY k) FROM o WHERE k <= 3) AS top_3_departamentos,
  {r6('SUM(total) FILTER (k <= 3)::DOUBLE / SUM(total)::DOUBLE * 100')} AS concentracion_top_3,
  {r6('2 * SUM(i * total)::DOUBLE / (COUNT(*) * SUM(total))::DOUBLE - (COUNT(*) + 1) / COUNT(*)::DOUBLE')} AS coeficiente_gini,
  COUNT(*) FILTER (total::DOUBLE < (SELECT quantile_cont(total::DOUBLE, 0.5) FROM dep) * 0.1::DOUBLE) AS departamentos_bajo_volumen FROM o""",
    ),
    "disparidad_departamental": con(
        DERIVADA,
        f"""{_EXTREMOS.format(k='dpto_pjfs')}
SELECT any_value(clave) FILTER (a = 1) AS departamento_mas_eficiente, {r6('any_value(tasa) FILTER (a = 1)')} AS tasa_mas_alta,
  any_value(clave) FILTER (z = 1) AS departamento_menos_eficiente, {r6('any_value(tasa) FILTER (z = 1)')} AS tasa_mas_baja,
  {r6('any_value(tasa) FILTER (a = 1) - any_value(tasa) FILTER (z = 1)')} AS brecha_eficiencia FROM r""",
    ),
    "anios_atipicos": con(
        DERIVADA,
        f""", an AS (SELECT anio, CAST(SUM(ingresado) AS BIGINT) AS casos FROM d GROUP BY anio),
st AS (SELECT avg(casos) AS m, stddev_pop(casos) AS s FROM an)
SELECT anio, casos, {r6('(casos - m) / s')} AS desviacion_estandar, CASE WHEN casos > m THEN 'Alto' ELSE 'Bajo' END AS tipo,
  abs(casos - m) > 2 * s AS es_atipico FROM an, st""",
    ),
    "sesgo_temporal": con(
        DERIVADA,
        f"""{ANUAL}
SELECT variable, round(b, 4) AS pendiente, {r6('r2')} AS r_cuadrado, {r6('p')} AS p_valor, p < 0.05 AS es_significativa,
  CASE WHEN b > 0 THEN 'Creciente' WHEN b < 0 THEN 'Decreciente' ELSE 'Estable' END AS direccion,
  {r6('sp / m')} AS coeficiente_variacion_temporal FROM tend WHERE variable = 'ingresado'""",
    ),
    "estadisticas_anuales": con(
        DERIVADA,
        "SELECT anio, "
        + ", ".join(
            f"CAST(SUM({c}) AS BIGINT) AS {c}_sum, {r3(f'avg({c})')} AS {c}_mean, {r3(f'stddev_samp({c})')} AS {c}_std"
            for c in ("ingresado", "atendido")
        )
        + f", {r3('avg(tasa_atencion)')} AS tasa_atencion_mean FROM d GROUP BY anio",
    ),
    "dominancia_materia": con(
        DERIVADA,
        f""", m AS (SELECT materia, SUM(ingresado) AS t, {r3('avg(tasa_atencion)')} AS e FROM d GROUP BY materia),
o AS (SELECT *, row_number() OVER (ORDER BY t DESC, materia) AS k, row_number() OVER (ORDER BY e DESC, materia) AS a,
        row_number() OVER (ORDER BY e, materia DESC) AS z FROM m)
SELECT any_value(materia) FILTER (k = 1) AS materia_dominante, {r6('MAX(t)::DOUBLE / SUM(t)::DOUBLE * 100')} AS participacion,
  MAX(t)::DOUBLE / SUM(t)::DOUBLE * 100 > 40 AS es_dominante,
  any_value(materia) FILTER (a = 1) AS materia_mas_eficiente, any_value(e) FILTER (a = 1) AS eficiencia_maxima,
  any_value(materia) FILTER (z = 1) AS materia_menos_eficiente, any_value(e) FILTER (z = 1) AS eficiencia_minima,
  {r6('any_value(e) FILTER (a = 1) - any_value(e) FILTER (z = 1)')} AS brecha_eficiencia FROM o""",
    ),
    "eficiencia_tipo_fiscalia": con(
        DERIVADA,
        f"""SELECT tipo_fiscalia, CAST(SUM(ingresado) AS BIGINT) AS ing_total, CAST(SUM(atendido) AS BIGINT) AS at_total,
  {r3('avg(tasa_atencion)')} AS ef_promedio, {r3('stddev_samp(tasa_atencion)')} AS ef_std, COUNT(tasa_atencion) AS registros,
  {r3('SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE')} AS ef_calculada FROM d GROUP BY tipo_fiscalia""",
    ),
    "efecto_especializacion": con(
        DERIVADA,
        f""", e AS (SELECT avg(tasa_atencion) FILTER ({_ESP}) AS a, avg(tasa_atencion) FILTER (NOT {_ESP}) AS b FROM d)
SELECT {r6('a')} AS eficiencia_con_especializacion, {r6('b')} AS eficiencia_sin_especializacion, {r6('a - b')} AS diferencia,
  a > b AS especializacion_mejora_eficiencia FROM e""",
    ),
    "anomalias": con(
        DERIVADA,
        f""", e AS (SELECT COUNT(*) FILTER (atendido > ingresado * 1.5) AS s, COUNT(*) FILTER (ingresado > 0 AND atendido = 0) AS n,
  COUNT(*) FILTER (atendido > ingresado * 1.5 OR (ingresado > 0 AND atendido = 0)) AS t, COUNT(*) AS c FROM d)
SELECT t AS total_anomalias, {r6('t / c::DOUBLE * 100')} AS porcentaje_dataset, s AS sobre_atencion_extrema,
  n AS sin_atencion_con_casos FROM e""",
    ),
    "filas_anomalas": con(
        DERIVADA,
        """SELECT anio, distrito_fiscal, materia, ingresado, atendido, atendido > ingresado * 1.5 AS sobre_atencion_extrema,
  ingresado > 0 AND atendido = 0 AS sin_atencion_con_casos FROM d
WHERE atendido > ingresado * 1.5 OR (ingresado > 0 AND atendido = 0)""",
    ),
    "outliers_iqr": con(
        DERIVADA,
        _IQR + _RESUMEN + f""", lim AS (SELECT * FROM q)
{_salida(_ETI_IQR)}""",
    ),
    "outliers_mad": con(DERIVADA, _MAD + _RESUMEN + _salida(_ETI_MAD)),
    "outliers_resumen": con(
        DERIVADA,
        _IQR + _RESUMEN
        + f", t2 AS (SELECT variable, abs(CAST(0.6745 AS DOUBLE) * (v - med) / mad) > 3.5 AS f FROM l JOIN (SELECT variable, any_value(med) AS med, quantile_cont(abs(v - med), 0.5) AS mad FROM l JOIN (SELECT variable, quantile_cont(v, 0.5) AS med FROM l GROUP BY 1) USING (variable) GROUP BY variable) USING (variable) WHERE mad > 0), t3 AS (SELECT variable, COUNT(*) AS total_valores, COUNT(*) FILTER (f) AS conteo FROM t2 GROUP BY 1)\n"
        + f"SELECT variable, 'IQR' AS metodo, conteo, {r6(_PCT)} AS porcentaje, {_ETI_IQR} AS interpretacion FROM t WHERE variable <> 'anio' "
        + f"UNION ALL SELECT variable, 'Z_Score_Modificado', conteo, {r6(_PCT)}, {_ETI_MAD} FROM t3 WHERE variable <> 'anio'",
    ),
    "outliers_contextuales": con(
        DERIVADA,
        f"""{_CTX}
SELECT k.tipo, COUNT(c.tipo) AS conteo, CASE WHEN k.tipo = 'volumen_extremo' THEN {r6('(SELECT p99 FROM u)')} END AS umbral
FROM (VALUES ('sobre_atencion_extrema'), ('volumen_extremo'), ('sin_atencion_alto_volumen')) k(tipo)
LEFT JOIN c ON c.tipo = k.tipo GROUP BY k.tipo""",
    ),
    "casos_contextuales": con(
        DERIVADA,
        f"""{_CTX}
SELECT * FROM (SELECT tipo, distrito_fiscal, materia, especializada, ingresado, atendido, {r6('tasa_atencion')} AS tasa_atencion,
  CAST(row_number() OVER (PARTITION BY tipo ORDER BY mm DESC NULLS LAST, distrito_fiscal, materia, especializada, ingresado, atendido) AS INTEGER) AS puesto
  FROM c) WHERE puesto <= 5""",
    ),
    "histograma": con(
        DERIVADA,
        f"""{_G},
s AS (SELECT variable, min(v) AS lo, max(v) AS hi, COUNT(*) AS n FROM g GROUP BY variable),
b AS (SELECT variable, CAST(least(floor((v - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS barra, COUNT(*) AS k FROM g JOIN s USING (variable) GROUP BY ALL),
m AS (SELECT s.*, CAST(range AS INTEGER) AS barra FROM s, range(50))
SELECT variable, barra, {r6('lo + barra * ((hi - lo) / 50)')} AS desde, {r6('lo + (barra + 1) * ((hi - lo) / 50)')} AS hasta,
  coalesce(k, 0) AS frecuencia, {r6('coalesce(k, 0) / (n * ((hi - lo) / 50))')} AS densidad
FROM m LEFT JOIN b USING (variable, barra)""",
    ),
    "marcadores_histograma": con(
        DERIVADA,
        f"{_G} SELECT variable, {r6('avg(v)')} AS media, {r6('quantile_cont(v, 0.5)')} AS mediana FROM g GROUP BY variable",
    ),
    "kde": con(DERIVADA, _KDE),
    "boxplot": con(DERIVADA, _G + _cajas("g", "variable")),
    "boxplot_p99": con(
        DERIVADA,
        f"""{_G}, p AS (SELECT variable, quantile_cont(v, 0.99) AS p99 FROM g GROUP BY variable),
g2 AS (SELECT variable, v FROM g JOIN p USING (variable) WHERE v <= p99 AND variable <> 'tasa_atencion')
{_cajas('g2', 'variable')}""",
    ),
    "boxplot_anual": con(
        DERIVADA,
        ", y AS (" + union("SELECT anio, '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM d", ["ingresado", "atendido"]) + ")"
        + _cajas("y", "anio, variable"),
    ),
    "forma_distribucion": con(
        DERIVADA,
        ", g AS (" + union("SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM d WHERE {c} IS NOT NULL", ["ingresado", "atendido", "tasa_atencion"]) + ")"
        + f""", mu AS (SELECT variable, avg(v) AS m, COUNT(*) AS n, COUNT(*) FILTER (v > 1.2) AS k FROM g GROUP BY variable),
mo AS (SELECT variable, any_value(n) AS n, any_value(k) AS k, SUM((v - m) ** 2) AS m2, SUM((v - m) ** 3) AS m3, SUM((v - m) ** 4) AS m4
  FROM g JOIN mu USING (variable) GROUP BY variable)
SELECT variable, {r6('(m3 / n) / ((m2 / n) * sqrt(m2 / n))')} AS asimetria, {r6('(m4 / n) / ((m2 / n) ** 2) - 3')} AS curtosis,
  CASE WHEN variable = 'tasa_atencion' THEN k END AS sobre_eficientes,
  CASE WHEN variable = 'tasa_atencion' THEN {r6('k / n::DOUBLE * 100')} END AS sobre_eficientes_pct FROM mo""",
    ),
    "participacion_materia": con(
        DERIVADA,
        f"SELECT materia, COUNT(*) AS registros, {r6('COUNT(*) / (SELECT COUNT(*) FROM d)::DOUBLE * 100')} AS porcentaje FROM d GROUP BY materia",
    ),
    "participacion_tipo_fiscalia": con(
        DERIVADA,
        f"SELECT tipo_fiscalia, COUNT(*) AS registros, {r6('COUNT(*) / (SELECT COUNT(*) FROM d)::DOUBLE * 100')} AS porcentaje FROM d GROUP BY 1",
    ),
    "top_distritos": con(
        DERIVADA,
        "SELECT distrito_fiscal, CAST(SUM(ingresado) AS BIGINT) AS ingresado FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    ),
    "tasa_departamento": con(
        DERIVADA,
        f""", t AS (SELECT dpto_pjfs, CAST(SUM(ingresado) AS BIGINT) AS ingresado, CAST(SUM(atendido) AS BIGINT) AS atendido,
  SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE AS t FROM d GROUP BY 1)
SELECT dpto_pjfs, ingresado, atendido, {r6('t')} AS tasa_atencion, CASE WHEN t < 0.8 THEN 'rojo' WHEN t < 0.95 THEN 'amarillo' ELSE 'verde' END AS banda FROM t""",
    ),
    "participacion_departamentos": con(
        DERIVADA,
        f""", t AS (SELECT dpto_pjfs, CAST(SUM(ingresado) AS BIGINT) AS ingresado FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT dpto_pjfs, ingresado, {r6('ingresado / (SELECT SUM(ingresado) FROM t)::DOUBLE * 100')} AS porcentaje FROM t""",
    ),
    "dispersion_distrito": con(
        DERIVADA,
        f"""SELECT distrito_fiscal, CAST(SUM(ingresado) AS BIGINT) AS ingresado, CAST(SUM(atendido) AS BIGINT) AS atendido,
  {r6('SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE')} AS tasa_atencion FROM d GROUP BY 1""",
    ),
    "regresion_distrito": con(
        DERIVADA,
        f""", t AS (SELECT CAST(SUM(ingresado) AS DOUBLE) AS x, SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE AS y FROM d GROUP BY distrito_fiscal)
SELECT round(regr_slope(y, x), 12) AS pendiente, {r6('regr_intercept(y, x)')} AS intercepto, {r6('corr(y, x)')} AS r,
  {r6('regr_r2(y, x)')} AS r_cuadrado, COUNT(*) AS puntos FROM t""",
    ),
    "resumen_geografico": con(
        DERIVADA,
        f""", t AS (SELECT distrito_fiscal, SUM(ingresado) AS s, SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE AS y FROM d GROUP BY 1),
e AS (SELECT dpto_pjfs, SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE AS y FROM d GROUP BY 1)
SELECT {r6('(SELECT SUM(s) FROM (SELECT s FROM t ORDER BY s DESC LIMIT 5))::DOUBLE / (SELECT SUM(s) FROM t)::DOUBLE * 100')} AS concentracion_top_5,
  arg_max(dpto_pjfs, y) AS departamento_mas_eficiente, arg_min(dpto_pjfs, y) AS departamento_menos_eficiente,
  {r6('max(y) - min(y)')} AS brecha_eficiencia, {r6('(SELECT corr(s::DOUBLE, y) FROM t)')} AS r_volumen_tasa FROM e""",
    ),
    "evolucion_anual": con(
        DERIVADA,
        f"""SELECT anio, CAST(SUM(ingresado) AS BIGINT) AS ingresado, CAST(SUM(atendido) AS BIGINT) AS atendido,
  {r6('SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE')} AS tasa_global FROM d GROUP BY anio""",
    ),
    "pivot_anio_materia": con(
        DERIVADA,
        "SELECT anio, "
        + ", ".join(f"CAST(coalesce(SUM(ingresado) FILTER (materia = '{m}'), 0) AS BIGINT) AS \"{m}\"" for m in _MATERIAS)
        + " FROM d GROUP BY anio",
    ),
    "variacion_anual": con(
        DERIVADA,
        f""", a AS (SELECT anio, SUM(ingresado)::DOUBLE AS i, SUM(atendido)::DOUBLE AS t FROM d GROUP BY anio),
b AS (SELECT anio, i, t, lag(i) OVER (ORDER BY anio) AS i0, lag(t) OVER (ORDER BY anio) AS t0 FROM a)
SELECT anio, {r6('(i - i0) / i0 * 100')} AS ingresado_pct, {r6('(t - t0) / t0 * 100')} AS atendido_pct FROM b WHERE i0 IS NOT NULL""",
    ),
    "resumen_periodo": con(
        DERIVADA,
        f""", a AS (SELECT anio, SUM(ingresado)::DOUBLE AS i, SUM(atendido)::DOUBLE AS t FROM d GROUP BY anio)
SELECT {r6('(arg_max(i, anio) - arg_min(i, anio)) / arg_min(i, anio) * 100')} AS crecimiento_total,
  {r6('arg_max(t / i, anio) - arg_min(t / i, anio)')} AS cambio_eficiencia, {r6('stddev_samp(i) / avg(i)')} AS cv_temporal FROM a""",
    ),
    "categorias_eficiencia": con(
        DERIVADA,
        f""", c AS (SELECT {TRAMO_EFICIENCIA.format(c='tasa_atencion')} AS categoria FROM d)
SELECT categoria, COUNT(*) AS registros, {r6('COUNT(*) / (SELECT COUNT(categoria) FROM c)::DOUBLE * 100')} AS porcentaje
FROM c WHERE categoria IS NOT NULL GROUP BY categoria""",
    ),
    "eficiencia_materia": con(
        DERIVADA,
        f""", g AS (SELECT materia, CAST(SUM(ingresado) AS BIGINT) AS ing_total, CAST(SUM(atendido) AS BIGINT) AS at_total,
  avg(tasa_atencion) AS m, stddev_samp(tasa_atencion) AS s, COUNT(tasa_atencion) AS registros,
  SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE AS c FROM d GROUP BY materia)
SELECT materia, ing_total, at_total, {r6('m')} AS ef_media, {r6('s')} AS ef_std, registros, {r6('c')} AS ef_calculada,
  CASE WHEN c < 0.8 THEN 'rojo' WHEN c < 1 THEN 'amarillo' ELSE 'verde' END AS banda,
  row_number() OVER (ORDER BY c DESC, materia) = 1 AS es_maxima, row_number() OVER (ORDER BY c, materia) = 1 AS es_minima FROM g""",
    ),
    "barras_tipo_fiscalia": con(
        DERIVADA,
        f"""SELECT tipo_fiscalia, {r6('SUM(atendido)::DOUBLE / SUM(ingresado)::DOUBLE')} AS tasa_atencion,
  {r6('stddev_samp(tasa_atencion)')} AS error_std FROM d GROUP BY 1""",
    ),
    "regresion_registros": con(DERIVADA, _REG),
    "recta_registros": con(
        DERIVADA,
        f""", f AS (SELECT regr_slope(tasa_atencion, ingresado) AS b, regr_intercept(tasa_atencion, ingresado) AS a,
  CAST(max(ingresado) AS DOUBLE) AS mx FROM d WHERE tasa_atencion IS NOT NULL)
SELECT CAST(range AS INTEGER) AS punto, {r6('range * mx / 99')} AS x, {r6('b * (range * mx / 99) + a')} AS y FROM f, range(100)""",
    ),
    "dispersion_registros": con(
        DERIVADA,
        """, v AS (SELECT CAST(ingresado AS DOUBLE) AS x, tasa_atencion AS y FROM d WHERE tasa_atencion IS NOT NULL),
l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
SELECT CAST(least(floor((x - x0) * 50 / (x1 - x0)), 49) AS INTEGER) AS celda_x,
  CAST(least(floor((y - y0) * 50 / (y1 - y0)), 49) AS INTEGER) AS celda_y, COUNT(*) AS registros FROM v, l GROUP BY 1, 2""",
    ),
}
