"""Oracle SQL of the findings, built on the oracles of the single metrics."""

from __future__ import annotations

from verificacion.descriptiva import ORACULOS as DES
from verificacion.modelos import ORACULOS as MOD
from verificacion.patrones import ORACULOS as PAT

# Thresholds and texts of the findings, stated here for themselves so that a wrong one in the library shows.
_REGLAS = (
    ("estadisticas", "periodo", "resumen.anios", ">", 0, "años abarcados", ""),
    ("estadisticas", "registros", "resumen.total_registros", ">", 0, "registros analizados", ""),
    ("estadisticas", "tasa_global", "resumen.tasa_atencion_global", ">", 0.8, "eficiencia global alta", "eficiencia global baja"),
    ("estadisticas", "asimetria_ingresado", "numerica.ingresado.skewness", "abs>", 1, "distribución muy asimétrica, hay casos extremos", ""),
    ("estadisticas", "variabilidad_ingresado", "numerica.ingresado.coefficient_variation", ">", 1, "gran heterogeneidad entre registros", ""),
    ("estadisticas", "concentracion_ingresado", "numerica.ingresado.concentracion_top10", ">", 50, "los diez mayores concentran la mayor parte", ""),
    ("estadisticas", "ceros_ingresado", "numerica.ingresado.zeros_percentage", ">", 5, "demasiados registros en cero", ""),
    ("outliers", "iqr_moderado_ingresado", "iqr.ingresado.porcentaje", ">", 5, "presencia moderada de extremos", "pocos extremos"),
    ("outliers", "iqr_alto_ingresado", "iqr.ingresado.porcentaje", ">", 10, "presencia alta de extremos", ""),
    ("outliers", "mad_moderado_ingresado", "mad.ingresado.porcentaje", ">", 5, "algunos valores extremos", "pocos valores extremos"),
    ("outliers", "mad_alto_ingresado", "mad.ingresado.porcentaje", ">", 15, "muchos valores extremos", ""),
    ("graficos", "cola_derecha_ingresado", "forma.ingresado.asimetria", ">", 0.5, "cola a la derecha", ""),
    ("graficos", "cola_izquierda_ingresado", "forma.ingresado.asimetria", "<", -0.5, "cola a la izquierda", ""),
    ("graficos", "leptocurtica_ingresado", "forma.ingresado.curtosis", ">", 3, "más apuntada que la normal", ""),
    ("graficos", "platicurtica_ingresado", "forma.ingresado.curtosis", "<", -3, "más plana que la normal", ""),
    ("estadisticas", "asimetria_atendido", "numerica.atendido.skewness", "abs>", 1, "distribución muy asimétrica, hay casos extremos", ""),
    ("estadisticas", "variabilidad_atendido", "numerica.atendido.coefficient_variation", ">", 1, "gran heterogeneidad entre registros", ""),
    ("estadisticas", "concentracion_atendido", "numerica.atendido.concentracion_top10", ">", 50, "los diez mayores concentran la mayor parte", ""),
    ("estadisticas", "ceros_atendido", "numerica.atendido.zeros_percentage", ">", 5, "demasiados registros en cero", ""),
    ("outliers", "iqr_moderado_atendido", "iqr.atendido.porcentaje", ">", 5, "presencia moderada de extremos", "pocos extremos"),
    ("outliers", "iqr_alto_atendido", "iqr.atendido.porcentaje", ">", 10, "presencia alta de extremos", ""),
    ("outliers", "mad_moderado_atendido", "mad.atendido.porcentaje", ">", 5, "algunos valores extremos", "pocos valores extremos"),
    ("outliers", "mad_alto_atendido", "mad.atendido.porcentaje", ">", 15, "muchos valores extremos", ""),
    ("graficos", "cola_derecha_atendido", "forma.atendido.asimetria", ">", 0.5, "cola a la derecha", ""),
    ("graficos", "cola_izquierda_atendido", "forma.atendido.asimetria", "<", -0.5, "cola a la izquierda", ""),
    ("graficos", "leptocurtica_atendido", "forma.atendido.curtosis", ">", 3, "más apuntada que la normal", ""),
    ("graficos", "platicurtica_atendido", "forma.atendido.curtosis", "<", -3, "más plana que la normal", ""),
    ("graficos", "cola_derecha_tasa_atencion", "forma.tasa_atencion.asimetria", ">", 0.5, "cola a la derecha", ""),
    ("graficos", "cola_izquierda_tasa_atencion", "forma.tasa_atencion.asimetria", "<", -0.5, "cola a la izquierda", ""),
    ("graficos", "leptocurtica_tasa_atencion", "forma.tasa_atencion.curtosis", ">", 3, "más apuntada que la normal", ""),
    ("graficos", "platicurtica_tasa_atencion", "forma.tasa_atencion.curtosis", "<", -3, "más plana que la normal", ""),
    ("estadisticas", "eficiencia_perfecta", "eficiencia.casos_eficiencia_perfecta_pct", ">", 20, "posible sobre-registro o traslado de casos", ""),
    ("estadisticas", "eficiencia_baja", "eficiencia.casos_baja_eficiencia_pct", ">", 30, "posibles problemas de capacidad", ""),
    ("estadisticas", "tendencia_ingresados", "temporal.ingresado.p_valor", "<", 0.05, "tendencia significativa", ""),
    ("patrones", "gini_departamental", "geografia.coeficiente_gini", ">", 0.5, "Alta", "Moderada"),
    ("patrones", "concentracion_departamental", "geografia.concentracion_top_3", ">", 0, "parte de los tres mayores departamentos", ""),
    ("patrones", "brecha_departamental", "disparidad.brecha_eficiencia", ">", 0, "brecha de eficiencia entre departamentos", ""),
    ("patrones", "materia_dominante", "materia.participacion", ">", 40, "hay una materia dominante", "sin materia dominante"),
    ("patrones", "efecto_especializacion", "especializacion.diferencia", ">", 0, "la especialización mejora la eficiencia", "la especialización no mejora la eficiencia"),
    ("patrones", "anomalias", "anomalias.total_anomalias", ">", 0, "hay registros anómalos", ""),
    ("outliers", "sobre_atencion_extrema", "contextual.sobre_atencion_extrema.conteo", ">", 0, "posibles errores o casos de otro período", ""),
    ("outliers", "volumen_extremo", "contextual.volumen_extremo.conteo", ">", 0, "carga de trabajo excepcional", ""),
    ("outliers", "sin_atencion_alto_volumen", "contextual.sin_atencion_alto_volumen.conteo", ">", 0, "posibles problemas operativos", ""),
    ("outliers", "multivariados", "multivariado.total_outliers", ">", 0, "combinaciones atípicas de volumen y eficiencia", ""),
    ("outliers", "multivariados_pct", "multivariado.porcentaje", ">", 0, "parte de los registros", ""),
    ("graficos", "materia_mas_registros", "registros_materia.participacion", ">", 0, "materia con más registros", ""),
    ("graficos", "concentracion_diez_distritos", "volumen.concentracion_top_10", ">", 0, "parte de los diez mayores distritos", ""),
    ("graficos", "materia_mas_eficiente", "materias.ef_maxima", ">", 0, "materia más eficiente", ""),
    ("graficos", "materia_menos_eficiente", "materias.ef_minima", ">", 0, "materia menos eficiente", ""),
    ("graficos", "tasa_media", "marcadores.tasa_atencion.media", ">", 1, "por encima de la eficiencia perfecta", "por debajo de la eficiencia perfecta"),
    ("graficos", "correlacion_muy_fuerte", "correlacion.ingresado.atendido", ">", 0.8, "la atención crece con el ingreso", ""),
    ("graficos", "correlacion_fuerte", "correlacion.ingresado.atendido", ">", 0.6, "buena capacidad de respuesta", "capacidad de respuesta variable"),
    ("graficos", "saturacion", "correlacion.tasa_atencion.ingresado", "<", -0.3, "a mayor volumen, menor eficiencia", ""),
    ("graficos", "economias_escala", "correlacion.tasa_atencion.ingresado", ">", 0.3, "a mayor volumen, mayor eficiencia", ""),
    ("graficos", "concentracion_geografica", "lugar.concentracion_top_5", ">", 50, "alta concentración geográfica", ""),
    ("graficos", "volumen_eficiencia_distrito", "lugar.r_volumen_tasa", "abs>", 0.3, "el volumen se asocia con la eficiencia", ""),
    ("graficos", "crecimiento", "periodo.crecimiento_total", "abs>", 20, "fuerte cambio de la carga", ""),
    ("graficos", "cambio_eficiencia", "periodo.cambio_eficiencia", "abs>", 0.1, "cambio notable de la eficiencia", ""),
    ("graficos", "variabilidad_temporal", "periodo.cv_temporal", ">", 0.15, "alta variabilidad entre años", ""),
    ("graficos", "regresion_registros", "registros.r", "abs>", 0.2, "relación entre volumen y eficiencia", "sin relación clara"),
)

# (prefix, oracle, key column, columns); a column may be (SQL, name, SQL of the name that goes with it).
_FUENTES = [
    (
        "resumen",
        DES["resumen_general"],
        None,
        ["tasa_atencion_global", "total_registros", ("periodo_fin - periodo_inicio + 1", "anios", "NULL")],
    ),
    (
        "disparidad",
        PAT["disparidad_departamental"],
        None,
        [("brecha_eficiencia", "brecha_eficiencia", "departamento_mas_eficiente || ' / ' || departamento_menos_eficiente")],
    ),
    (
        "registros_materia",
        PAT["participacion_materia"] ,
        None,
        [("max(porcentaje)", "participacion", "first(materia ORDER BY registros DESC, materia)")],
    ),
    (
        "materias",
        PAT["eficiencia_materia"],
        None,
        [
            ("max(ef_calculada)", "ef_maxima", "first(materia ORDER BY ef_calculada DESC, materia)"),
            ("min(ef_calculada)", "ef_minima", "first(materia ORDER BY ef_calculada, materia)"),
        ],
    ),
    ("volumen", DES["metricas_volumen"], None, [("concentracion_top_10_distritos", "concentracion_top_10", "NULL")]),
    ("multivariado", MOD["outliers_multivariados"], None, ["total_outliers", "porcentaje"]),
    (
        "numerica",
        DES["perfil_eda_numerico"],
        "variable",
        ["skewness", "coefficient_variation", "concentracion_top10", "zeros_percentage"],
    ),
    (
        "eficiencia",
        DES["metricas_eficiencia"],
        None,
        ["casos_eficiencia_perfecta_pct", "casos_baja_eficiencia_pct"],
    ),
    ("temporal", DES["metricas_temporales"], "variable", ["p_valor"]),
    (
        "geografia",
        PAT["concentracion_departamental"],
        None,
        ["coeficiente_gini", "concentracion_top_3"],
    ),
    ("materia", PAT["dominancia_materia"], None, ["participacion"]),
    ("especializacion", PAT["efecto_especializacion"], None, ["diferencia"]),
    ("anomalias", PAT["anomalias"], None, ["total_anomalias"]),
    ("iqr", PAT["outliers_iqr"], "variable", ["porcentaje"]),
    ("mad", PAT["outliers_mad"], "variable", ["porcentaje"]),
    ("contextual", PAT["outliers_contextuales"], "tipo", ["conteo"]),
    ("marcadores", PAT["marcadores_histograma"], "variable", ["media"]),
    ("forma", PAT["forma_distribucion"], "variable", ["asimetria", "curtosis"]),
    ("lugar", PAT["resumen_geografico"], None, ["concentracion_top_5", "r_volumen_tasa"]),
    (
        "periodo",
        PAT["resumen_periodo"],
        None,
        ["crecimiento_total", "cambio_eficiencia", "cv_temporal"],
    ),
    ("registros", PAT["regresion_registros"], None, ["r"]),
]


def _consulta() -> str:
    ctes, partes = [], []
    for i, (prefijo, sql, clave, columnas) in enumerate(_FUENTES):
        ctes.append(f"f{i} AS ({sql})")
        raiz = f"'{prefijo}.'" if clave is None else f"'{prefijo}.' || {clave} || '.'"
        for c in columnas:
            valor, nombre, detalle = (c, c, "NULL") if isinstance(c, str) else c
            partes.append(f"SELECT {raiz} || '{nombre}' AS metrica, CAST({valor} AS DOUBLE) AS valor, CAST({detalle} AS VARCHAR) AS detalle FROM f{i}")
    ctes.append(f"fc AS ({DES['correlacion_pearson']})")
    partes.append("SELECT 'correlacion.' || var1 || '.' || var2, r, NULL FROM fc")
    valores = ", ".join(f"('{s}', '{r}', '{m}', '{o}', CAST({u} AS DOUBLE), '{si}', '{no}')" for s, r, m, o, u, si, no in _REGLAS)
    ctes.append("m AS (" + " UNION ALL ".join(partes) + ")")
    ctes.append(f"k AS (SELECT * FROM (VALUES {valores}) t(seccion, regla, metrica, operador, umbral, si, no))")
    ctes.append(
        """e AS (SELECT *, CASE operador WHEN '>' THEN valor > umbral WHEN '<' THEN valor < umbral ELSE abs(valor) > umbral END AS cumple
FROM k JOIN m USING (metrica) WHERE valor IS NOT NULL)"""
    )
    return (
        "WITH " + ",\n".join(ctes) + """
SELECT seccion, regla, metrica, operador, umbral, valor, cumple,
  CASE WHEN CASE WHEN cumple THEN si ELSE no END <> '' THEN
    metrica || ': ' || CASE WHEN cumple THEN si ELSE no END || ' (' || format('{:,.3f}', valor) || ')' || coalesce(', ' || detalle, '') END AS texto
FROM e"""
    )


ORACULOS = {"hallazgos": _consulta()}
