"""The cleaning report moves whole rows once and tells what they become apart by digests."""

from __future__ import annotations

from balanza.esquema import esquema_crudo
from balanza.operators import limpieza as lim
from tests.test_limpieza import BASE


def test_filas_enteras_se_mueven_una_vez(spark):
    cambios = [
        {},
        {},
        {"distrito_fiscal": " lima "},  # equal only when clean
        {"ingresado": "10.0"},  # equal once measures are numbers
        {"ingresado": None, "atendido": "0"},
        {"ingresado": "0", "atendido": None},  # the same row after the null rules, a cell is missing elsewhere
        {"ingresado": "-0", "atendido": "x"},
        {"materia": None, "especialidad": "M"},
        {"materia": "M", "especialidad": None},  # a missing cell in another place: another row
        {"materia": "M", "especialidad": None},
    ]
    df = lim.reporte_limpieza(spark.createDataFrame([{**BASE, **c} for c in cambios], esquema_crudo()))
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    intercambios = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("distrito_fiscal" in x for x in intercambios) == 1
    r = df.filter("anio = 2019").first()
    assert (r["filas_originales"], r["filas_eliminadas_nulos"]) == (10, 3)
    # Valid after the null rules: the plain row, the one of another case and the one without cases.
    assert (r["filas_finales"], r["duplicados_paso"]) == (3, 4)
    # Copies among the raw rows: two; two valid rows are one when clean.
    assert r["duplicados_eliminados"] == 2 - 1
    assert (r["ceros_ingresado_convertidos"], r["ceros_atendido_convertidos"]) == (1, 1)


def test_huella_distingue_celdas_vacias(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", ""), ("", "a"), (None, None), ("", "")], "x string, y string")
    assert df.select(*[c.alias(n) for n, c in lim.huella(["x", "y"], "h").items()]).distinct().count() == 6
