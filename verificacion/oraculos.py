"""All oracle SQL, keyed like the query catalogue."""

from __future__ import annotations

from verificacion import bi, descriptiva, dimensiones, hallazgos, limpieza, modelos, patrones
from verificacion.base import CASOS, PUBLICADOS

_BASE: dict[str, str] = {**bi.ORACULOS, **dimensiones.ORACULOS, **limpieza.ORACULOS, **descriptiva.ORACULOS, **patrones.ORACULOS, **hallazgos.ORACULOS, **modelos.ORACULOS}

# Queries that also run over the published names: the same SQL over the other rows.
_PUBLICADAS = (
    "dim_tipos_caso",
    "tipos_caso_por_categoria",
    "dim_fiscalias_especializadas",
    "fiscalias_por_area",
    "dim_ubicaciones",
    "ubicaciones_por_region",
    "dim_tipos_fiscalia",
    "filas_anomalas",
    "anomalias",
    "outliers_contextuales",
    "casos_contextuales",
)

ORACULOS: dict[str, str] = _BASE | {f"{n}_publicados": _BASE[n].replace(CASOS, PUBLICADOS) for n in _PUBLICADAS}
