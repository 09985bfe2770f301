"""Oracle SQL of the business questions."""

from __future__ import annotations

from verificacion.base import EFICIENCIA, VISTA, VOLUMEN, con, ent, pct, prom2, razon

_ING = "CAST(SUM(casos_ingresados) AS BIGINT)"
_AT = "CAST(SUM(casos_atendidos) AS BIGINT)"
_PEN = "CAST(SUM(casos_pendientes) AS BIGINT)"
_TASA_MEDIA = f"CAST({ent('SUM(tasa_e4)', 'COUNT(*)', 1)} AS DOUBLE) / CAST(10000 AS DOUBLE)"
_TASA = "(tasa_e4 / CAST(10000 AS DOUBLE))"


def _percentil(filtro: str) -> str:
    return con(
        VISTA,
        f"""
, t AS (
  SELECT distrito_fiscal, {razon('SUM(casos_atendidos)', 'SUM(casos_ingresados)')} AS tasa_atencion
  FROM vista WHERE {filtro} GROUP BY distrito_fiscal HAVING SUM(casos_ingresados) > 0)
SELECT distrito_fiscal, tasa_atencion,
  CAST(percent_rank() OVER (ORDER BY tasa_atencion) * 100 AS INTEGER) AS percentil
FROM t""",
    )


ORACULOS = {
    "resumen_ejecutivo": con(
        VISTA,
        f"""
SELECT anio, COUNT(*) AS total_registros, {_ING} AS total_ingresados, {_AT} AS total_atendidos,
  {_PEN} AS total_pendientes, {_TASA_MEDIA} AS tasa_atencion_promedio,
  round(stddev_samp({_TASA}), 4) AS desviacion_tasa_atencion,
  COUNT(DISTINCT distrito_fiscal) AS distritos_activos, COUNT(DISTINCT materia) AS materias_activas,
  COUNT(*) FILTER ({EFICIENCIA.format(c=_TASA)} = 'Excelente') AS registros_excelentes,
  COUNT(*) FILTER ({EFICIENCIA.format(c=_TASA)} = 'Deficiente') AS registros_deficientes,
  COUNT(*) FILTER ({VOLUMEN.format(c='casos_ingresados', s='')} = 'Muy Alto') AS registros_volumen_muy_alto,
  COUNT(*) FILTER ({VOLUMEN.format(c='casos_ingresados', s='')} = 'Alto') AS registros_volumen_alto
FROM vista GROUP BY anio""",
    ),
    "performance_distrito": con(
        VISTA,
        f"""
, g AS (
  SELECT distrito_fiscal, departamento, region_geografica, anio, {_ING} AS total_ingresados,
    {_AT} AS total_atendidos, {_PEN} AS total_pendientes, COUNT(*) AS registros_distrito,
    COUNT(DISTINCT materia) AS materias_manejadas,
    COUNT(DISTINCT tipo_fiscalia) AS tipos_fiscalia_activos
  FROM vista GROUP BY ALL)
SELECT g.*, {razon('total_atendidos', 'total_ingresados')} AS tasa_atencion_distrito,
  CAST(dense_rank() OVER (PARTITION BY anio ORDER BY total_ingresados DESC) AS INTEGER) AS ranking_volumen,
  CAST(dense_rank() OVER (PARTITION BY anio ORDER BY
    CASE WHEN total_ingresados > 0 THEN CAST(total_atendidos AS DOUBLE) / CAST(total_ingresados AS DOUBLE)
         ELSE 0 END DESC) AS INTEGER) AS ranking_eficiencia
FROM g""",
    ),
    "analisis_materia": con(
        VISTA,
        f"""
, g AS (
  SELECT materia, especialidad, anio, {_ING} AS casos_ingresados, {_AT} AS casos_atendidos,
    {_PEN} AS casos_pendientes, {prom2('SUM(casos_ingresados)', 'COUNT(*)')} AS promedio_ingresados_por_registro,
    round(stddev_samp(casos_ingresados), 2) AS desviacion_ingresados,
    MAX(casos_ingresados) AS max_ingresados_por_registro,
    MIN(casos_ingresados) AS min_ingresados_por_registro, COUNT(*) AS registros,
    COUNT(DISTINCT distrito_fiscal) AS distritos_con_materia
  FROM vista GROUP BY materia, especialidad, anio)
SELECT g.*, {razon('casos_atendidos', 'casos_ingresados')} AS tasa_atencion,
  {pct('casos_ingresados', '(SUM(casos_ingresados) OVER (PARTITION BY anio))')} AS "porcentaje_casos_del_año"
FROM g""",
    ),
    "top_performers": con(
        VISTA,
        f"""
, g AS (
  SELECT distrito_fiscal, departamento, region_geografica, {_ING} AS total_ingresados,
    {_AT} AS total_atendidos, {_PEN} AS total_pendientes, COUNT(DISTINCT anio) AS "años_activos",
    round(stddev_samp({_TASA}), 4) AS consistencia_tasa,
    COUNT(DISTINCT materia) AS materias_manejadas,
    COUNT(DISTINCT especialidad) AS especialidades_manejadas, COUNT(*) AS total_registros,
    {razon('SUM(casos_atendidos)', 'SUM(casos_ingresados)')} AS tasa_atencion
  FROM vista GROUP BY distrito_fiscal, departamento, region_geografica
  HAVING SUM(casos_ingresados) >= 500)
SELECT g.*,
  CAST(dense_rank() OVER (ORDER BY tasa_atencion DESC) AS INTEGER) AS ranking_eficiencia,
  CAST(dense_rank() OVER (ORDER BY total_ingresados DESC) AS INTEGER) AS ranking_volumen,
  CAST(dense_rank() OVER (ORDER BY consistencia_tasa ASC NULLS LAST) AS INTEGER) AS ranking_consistencia,
  {EFICIENCIA.format(c='tasa_atencion')} AS clasificacion_eficiencia,
  {VOLUMEN.format(c='total_ingresados', s=' Volumen')} AS clasificacion_volumen
FROM g""",
    ),
    "evolucion_temporal": con(
        VISTA,
        f"""
, g AS (
  SELECT anio, materia, departamento, {_ING} AS ingresados, {_AT} AS atendidos, {_PEN} AS pendientes,
    COUNT(DISTINCT distrito_fiscal) AS distritos_reportando, COUNT(*) AS registros
  FROM vista GROUP BY anio, materia, departamento),
h AS (
  SELECT *, lag(ingresados) OVER (PARTITION BY materia, departamento ORDER BY anio) AS "ingresados_año_anterior"
  FROM g)
SELECT h.*, {razon('atendidos', 'ingresados')} AS tasa_atencion,
  sign(ingresados - "ingresados_año_anterior")
    * {pct('abs(ingresados - "ingresados_año_anterior")', '"ingresados_año_anterior"')}
    AS variacion_porcentual_ingresados
FROM h""",
    ),
    "fiscalias_especializadas": con(
        VISTA,
        f"""
, g AS (
  SELECT coalesce(fiscalia_especializada, 'NO ESPECIALIZADA') AS tipo_fiscalia_especializada,
    coalesce(area_especializacion, 'GENERAL') AS area, anio, materia,
    {_ING} AS casos_ingresados, {_AT} AS casos_atendidos, COUNT(*) AS registros,
    COUNT(DISTINCT distrito_fiscal) AS distritos
  FROM vista GROUP BY 1, 2, anio, materia)
SELECT g.*, {pct('casos_ingresados', '(SUM(casos_ingresados) OVER (PARTITION BY anio, materia))')} AS porcentaje_casos_materia,
  {razon('casos_atendidos', 'casos_ingresados')} AS tasa_atencion
FROM g""",
    ),
    "metricas_regionales": con(
        VISTA,
        f"""
SELECT region_geografica, departamento, anio, {_ING} AS total_ingresados, {_AT} AS total_atendidos,
  COUNT(DISTINCT distrito_fiscal) AS distritos_region, COUNT(*) AS registros_region,
  {prom2('SUM(casos_ingresados)', 'COUNT(*)')} AS promedio_ingresados_por_registro,
  {_TASA_MEDIA} AS tasa_atencion_promedio, COUNT(DISTINCT materia) AS materias_activas,
  COUNT(fiscalia_especializada) AS registros_especializados,
  COUNT(*) - COUNT(fiscalia_especializada) AS registros_generales,
  {pct('COUNT(fiscalia_especializada)', 'COUNT(*)')} AS porcentaje_especializacion
FROM vista WHERE region_geografica IS NOT NULL
GROUP BY region_geografica, departamento, anio""",
    ),
    "percentil_eficiencia": _percentil("TRUE"),
    "percentil_eficiencia_filtrado": _percentil("anio = 1998 AND materia = 'PROMO'"),
}
