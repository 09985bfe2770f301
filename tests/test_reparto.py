"""Reports count the distinct values of a district where its rows lie together."""

from __future__ import annotations

from functools import partial

import pytest

from balanza.operators import bi

_COLUMNAS = (
    "anio int, distrito_fiscal string, departamento string, region_geografica string, materia string, especialidad string, "
    "tipo_fiscalia string, casos_ingresados int, casos_atendidos int, casos_pendientes int, tasa_atencion double"
)
_FILAS = [
    (1990 + i % 3, f"D{i * 7919 % 40:02d}", "LIMA", "COSTA", f"M{i % 5}", f"E{i % 7}", f"F{i % 2}", 900 + i, i % 11, 900 + i - i % 11, 0.5)
    for i in range(2000)
] + [(None, None, None, None, None, None, None, 700, 1, 699, 0.0), (1990, "D01", "LIMA", "COSTA", None, None, None, 5, 5, 0, 1.0)]

# Report as a pure plan, its grouping columns, and a column that counts the distinct values of another.
_INFORMES = {
    "performance_distrito": (
        partial(bi.performance_distrito, vivo=True),
        ("distrito_fiscal", "departamento", "region_geografica", "anio"),
        "materias_manejadas",
        "materia",
    ),
    "top_performers": (
        partial(bi.top_performers, vivo=True),
        ("distrito_fiscal", "departamento", "region_geografica"),
        "especialidades_manejadas",
        "especialidad",
    ),
    "evolucion_temporal": (bi.evolucion_temporal, ("anio", "materia", "departamento"), "distritos_reportando", "distrito_fiscal"),
}


@pytest.mark.parametrize("nombre", _INFORMES)
def test_distintos_por_distrito(spark, nombre):
    informe, claves, cuenta, columna = _INFORMES[nombre]
    df = informe(spark.createDataFrame(_FILAS, _COLUMNAS).repartition(6))
    assert "REBALANCE_PARTITIONS_BY_COL" in df._jdf.queryExecution().executedPlan().toString()
    nombres = [c.split()[0] for c in _COLUMNAS.split(", ")]
    esperado: dict[tuple, set] = {}
    for f in _FILAS:
        x = dict(zip(nombres, f))
        esperado.setdefault(tuple(x[c] for c in claves), set()).update({x[columna]} - {None})
    r = {tuple(x[c] for c in claves): x[cuenta] for x in df.collect()}
    assert r == {k: len(v) for k, v in esperado.items()}
