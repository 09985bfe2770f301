"""Oracle SQL of the cleaning job over the dirty form of the case table."""

from __future__ import annotations

from verificacion.base import CASOS, con

_PLANAS = [
    "periodo", "anio", "fecha_descarga", "fecha_corte", "distrito_fiscal", "tipo_fiscalia",
    "materia", "especialidad", "tipo_caso", "especializada", "ingresado", "atendido",
    "ubigeo_pjfs", "dpto_pjfs", "prov_pjfs", "dist_pjfs",
]
_TEXTO = [
    "distrito_fiscal", "tipo_fiscalia", "materia", "especialidad", "tipo_caso", "especializada",
    "dpto_pjfs", "prov_pjfs", "dist_pjfs",
]
_CRITICAS = [c for c in _PLANAS if c not in ("especializada", "ingresado", "atendido")]
_VALIDA = " AND ".join(f"{c} IS NOT NULL" for c in _CRITICAS)
_LISTA = ", ".join(_PLANAS)

_NUM = (
    "coalesce(CASE WHEN regexp_full_match({c}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
    "THEN TRY_CAST({c} AS DOUBLE) END, 0)"
)
_LIMPIO = "upper(trim({c}))"
_ESP = (
    "CASE WHEN especializada IS NULL OR upper(trim(especializada)) IN ('NAN', 'NONE', 'NULL', '', 'NA', ',,') "
    "OR regexp_full_match(trim(especializada), ',+') THEN 'NO_TIPO_ESPECIALIZADA' "
    "ELSE upper(trim(especializada)) END"
)

SUCIO = CASOS + """,
unicas AS (
  SELECT periodo, CAST(anio AS VARCHAR) AS anio,
    CASE WHEN clave_orden % 67 = 0 THEN 'sin fecha' ELSE strftime(fecha_descarga, '%d/%m/%Y') END AS fecha_descarga,
    strftime(fecha_corte, '%d/%m/%Y') AS fecha_corte,
    CASE WHEN clave_orden % 53 = 0 THEN '  ' || lower(distrito_fiscal) || ' ' ELSE distrito_fiscal END AS distrito_fiscal,
    tipo_fiscalia, materia, especialidad,
    CASE WHEN clave_orden % 101 = 0 THEN NULL ELSE tipo_caso END AS tipo_caso,
    CASE WHEN especializada <> 'NO_TIPO_ESPECIALIZADA' THEN especializada
         WHEN clave_orden % 5 = 0 THEN NULL WHEN clave_orden % 5 = 1 THEN ''
         WHEN clave_orden % 5 = 2 THEN ',,' WHEN clave_orden % 5 = 3 THEN 'na' ELSE ' None ' END AS especializada,
    CASE WHEN clave_orden % 97 = 0 THEN NULL WHEN clave_orden % 89 = 0 THEN ' '
         WHEN clave_orden % 83 = 0 THEN 'x' WHEN clave_orden % 79 = 0 THEN '-5'
         ELSE CAST(ingresado AS VARCHAR) END AS ingresado,
    CAST(CASE WHEN clave_orden % 71 = 0 THEN ingresado + 10 ELSE atendido END AS VARCHAR) AS atendido,
    CAST(ubigeo_pjfs AS VARCHAR) AS ubigeo_pjfs, dpto_pjfs, prov_pjfs, dist_pjfs, clave_orden
  FROM casos),
sucio AS (
  SELECT * EXCLUDE (clave_orden) FROM unicas
  UNION ALL SELECT * EXCLUDE (clave_orden) FROM unicas WHERE clave_orden % 61 = 0)"""

LIMPIO = SUCIO + f""",
medidas AS (
  SELECT * REPLACE ({_NUM.format(c='ingresado')} AS ingresado, {_NUM.format(c='atendido')} AS atendido),
    ({_VALIDA}) AS valida
  FROM sucio),
paso AS (SELECT DISTINCT {_LISTA} FROM medidas WHERE valida),
tipos AS (
  SELECT * REPLACE (
    CAST(try_strptime(fecha_descarga, '%d/%m/%Y') AS TIMESTAMP) AS fecha_descarga,
    CAST(try_strptime(fecha_corte, '%d/%m/%Y') AS TIMESTAMP) AS fecha_corte,
    CAST(anio AS INTEGER) AS anio, CAST(ubigeo_pjfs AS INTEGER) AS ubigeo_pjfs,
    greatest(CAST(trunc(ingresado) AS INTEGER), 0) AS ingresado,
    greatest(CAST(trunc(atendido) AS INTEGER), 0) AS atendido)
  FROM paso),
limpio AS (
  SELECT * REPLACE (
    {', '.join(f"{_ESP if c == 'especializada' else _LIMPIO.format(c=c)} AS {c}" for c in _TEXTO)},
    least(atendido, ingresado) AS atendido),
    CAST(year(fecha_descarga) AS INTEGER) AS "año_descarga",
    atendido > ingresado AS exceso
  FROM tipos)"""

_CATEGORICAS = ["distrito_fiscal", "tipo_fiscalia", "materia", "especialidad", "tipo_caso", "especializada"]


def _union(plantilla: str, columnas: list[str]) -> str:
    return "\nUNION ALL ".join(plantilla.format(c=c) for c in columnas)


_CALIDAD = f"""
, m AS (
  SELECT CAST(anio AS INTEGER) AS anio, COUNT(*) AS filas,
    COUNT(*) - COUNT(DISTINCT ({_LISTA})) AS duplicados,
    {', '.join(f'COUNT(*) FILTER ({c} IS NULL) AS n_{c}' for c in _PLANAS)}
  FROM sucio GROUP BY 1)
SELECT anio, 'filas' AS metrica, CAST(NULL AS VARCHAR) AS columna, filas AS valor, CAST(NULL AS VARCHAR) AS texto FROM m
UNION ALL SELECT anio, 'columnas', NULL, CAST(16 AS BIGINT), NULL FROM m
UNION ALL SELECT anio, 'duplicados', NULL, duplicados, NULL FROM m
UNION ALL {_union("SELECT anio, 'nulos', '{c}', CAST(n_{c} AS BIGINT), NULL FROM m", _PLANAS)}
UNION ALL {_union("SELECT anio, 'tipo', '{c}', NULL, 'string' FROM m", _PLANAS)}
"""

_TOP = f"""
, f AS ({_union("SELECT anio, '{c}' AS columna, {c} AS valor, COUNT(*) AS frecuencia FROM limpio WHERE {c} IS NOT NULL GROUP BY anio, {c}", _CATEGORICAS)}),
o AS (SELECT *, row_number() OVER (PARTITION BY anio, columna ORDER BY frecuencia DESC, valor) AS puesto FROM f)
"""

_NUMERICAS = ["anio", "ingresado", "atendido", "ubigeo_pjfs"]

_REPORTE = f"""
, cruda AS (
  SELECT CAST(anio AS INTEGER) AS anio, COUNT(*) AS filas, COUNT(DISTINCT ({_LISTA})) AS distintas,
    CAST(SUM({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in _PLANAS)}) AS BIGINT) AS nulos,
    COUNT(*) FILTER (ingresado IS NULL OR ingresado IN ('', ' ')) AS zi,
    COUNT(*) FILTER (atendido IS NULL OR atendido IN ('', ' ')) AS za,
    COUNT(*) FILTER ({_VALIDA}) AS validas
  FROM sucio GROUP BY 1),
fin AS (
  SELECT anio, COUNT(*) AS finales, COUNT(*) - COUNT(DISTINCT ({_LISTA}, "año_descarga")) AS dup,
    CAST(SUM({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in _PLANAS)} + CAST("año_descarga" IS NULL AS INTEGER)) AS BIGINT) AS nulos_f,
    COUNT(*) FILTER (exceso) AS exceso,
    COUNT(*) FILTER ("año_descarga" IS DISTINCT FROM anio + 1) AS desfase,
    COUNT(*) FILTER (ingresado < 0 OR atendido < 0) AS neg, COUNT(*) FILTER (ingresado = 0 AND atendido > 0) AS sin
  FROM limpio GROUP BY 1),
j AS (SELECT * FROM cruda JOIN fin USING (anio)),
t AS (
  SELECT anio, filas, distintas, nulos, zi, za, validas, finales, dup, nulos_f, exceso, desfase, neg, sin FROM j
  UNION ALL
  SELECT NULL, SUM(filas), SUM(distintas), SUM(nulos), SUM(zi), SUM(za), SUM(validas), SUM(finales),
    SUM(dup), SUM(nulos_f), SUM(exceso), SUM(desfase), SUM(neg), SUM(sin) FROM j)
SELECT anio, CAST(filas AS BIGINT) AS filas_originales, CAST(finales AS BIGINT) AS filas_finales,
  CAST(filas - finales AS BIGINT) AS filas_eliminadas,
  CAST(filas - validas AS BIGINT) AS filas_eliminadas_nulos,
  CAST(validas - finales AS BIGINT) AS duplicados_paso,
  CAST(finales AS DOUBLE) / CAST(filas AS DOUBLE) * 100 AS porcentaje_retencion,
  CAST(nulos - nulos_f AS BIGINT) AS nulos_detectados,
  CAST(filas - distintas - dup AS BIGINT) AS duplicados_eliminados,
  CAST(filas - nulos AS BIGINT) AS calidad_antes, CAST(finales - nulos_f AS BIGINT) AS calidad_despues,
  CAST(zi AS BIGINT) AS ceros_ingresado_convertidos, CAST(za AS BIGINT) AS ceros_atendido_convertidos,
  CAST(exceso AS BIGINT) AS casos_atendido_mayor_ingresado, CAST(desfase AS BIGINT) AS inconsistencias_fecha,
  CAST(neg AS BIGINT) AS valores_negativos, CAST(sin AS BIGINT) AS casos_atendido_sin_ingreso
FROM t"""

_OUT = """
SELECT v.anio, '{c}' AS columna, any_value(li) AS limite_inferior, any_value(ls) AS limite_superior,
  COUNT(*) FILTER ({c} < li OR {c} > ls) AS iqr_conteo, COUNT(*) FILTER (abs({c} - m) > 3 * s) AS z_conteo,
  COUNT(*) FILTER ({c} < li OR {c} > ls) / CAST(COUNT(*) AS DOUBLE) * 100 AS iqr_porcentaje,
  COUNT(*) FILTER (abs({c} - m) > 3 * s) / CAST(COUNT(*) AS DOUBLE) * 100 AS z_porcentaje
FROM limpio v JOIN (
  SELECT anio, avg({c}) AS m, stddev_pop({c}) AS s,
    quantile_cont(CAST({c} AS DOUBLE), 0.25) - CAST(1.5 AS DOUBLE) * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS li,
    quantile_cont(CAST({c} AS DOUBLE), 0.75) + CAST(1.5 AS DOUBLE) * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS ls
  FROM limpio GROUP BY anio) q ON q.anio = v.anio
GROUP BY v.anio"""

_Z = """
SELECT v.anio, '{c}' AS columna, CAST({c} AS DOUBLE) AS valor, COUNT(*) AS n,
  any_value(abs({c} - m) > 3 * s) AS es_outlier,
  any_value(round(m + 3 * sm, 6)) AS linea_superior, any_value(round(m - 3 * sm, 6)) AS linea_inferior
FROM limpio v JOIN (SELECT anio, avg({c}) AS m, stddev_pop({c}) AS s, stddev_samp({c}) AS sm
                    FROM limpio GROUP BY anio) q ON q.anio = v.anio
GROUP BY v.anio, {c}"""

ORACULOS = {
    "limpieza": con(LIMPIO, "SELECT * EXCLUDE (exceso) FROM limpio"),
    "perfil_calidad": con(SUCIO, _CALIDAD),
    "perfil_categorico": con(
        LIMPIO,
        f"""{_TOP}
SELECT anio, columna, COUNT(*) AS valores_unicos,
  any_value(valor) FILTER (puesto = 1) AS valor_mas_frecuente, MAX(frecuencia) AS frecuencia_maxima
FROM o GROUP BY anio, columna""",
    ),
    "top_valores": con(
        LIMPIO,
        f"""{_TOP} SELECT anio, columna, CAST(puesto AS INTEGER) AS puesto, valor, frecuencia
FROM o WHERE puesto <= 10""",
    ),
    "perfil_numerico": con(
        LIMPIO,
        _union(
            """SELECT anio, '{c}' AS columna, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(avg({c}), 6) AS media, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS mediana,
  round(stddev_samp({c}), 6) AS std, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, COUNT(*) FILTER ({c} = 0) AS valores_cero,
  COUNT(*) FILTER ({c} < 0) AS valores_negativos FROM limpio GROUP BY anio""",
            _NUMERICAS,
        ),
    ),
    "perfil_fechas": con(
        LIMPIO,
        _union(
            """SELECT CAST(anio AS INTEGER) AS anio, '{c}' AS columna,
  CAST(min(try_strptime({c}, '%d/%m/%Y')) AS TIMESTAMP) AS fecha_min,
  CAST(max(try_strptime({c}, '%d/%m/%Y')) AS TIMESTAMP) AS fecha_max,
  COUNT(*) FILTER (try_strptime({c}, '%d/%m/%Y') IS NULL) AS fechas_invalidas FROM sucio GROUP BY 1""",
            ["fecha_descarga", "fecha_corte"],
        ),
    ),
    "cambios_texto": con(
        LIMPIO,
        f"""
, a AS ({_union("SELECT anio, '{c}' AS columna, COUNT(DISTINCT {c}) + MAX(CAST({c} IS NULL AS INTEGER)) AS va FROM tipos GROUP BY anio", _TEXTO)}),
b AS ({_union("SELECT anio, '{c}' AS columna, COUNT(DISTINCT {c}) AS vd FROM limpio GROUP BY anio", _TEXTO)})
SELECT anio, columna, CAST(va AS BIGINT) AS valores_antes, CAST(vd AS BIGINT) AS valores_despues,
  CAST(va - vd AS BIGINT) AS reduccion FROM a JOIN b USING (anio, columna)""",
    ),
    "reporte_limpieza": con(LIMPIO, _REPORTE),
    "outliers_limpieza": con(LIMPIO, _union(_OUT, ["ingresado", "atendido"])),
    "dispersion_zscore": con(LIMPIO, _union(_Z, ["ingresado", "atendido"])),
}
