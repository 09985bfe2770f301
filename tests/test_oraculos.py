"""Every catalogued query against independent SQL on the same tables."""

from __future__ import annotations

import pytest

from balanza.plans.catalogo import consultas
from tests.conftest import DATOS
from verificacion.comparar import comparar
from verificacion.oraculos import ORACULOS

CONSULTAS = consultas()


@pytest.mark.parametrize("nombre", sorted(ORACULOS))
def test_consulta_igual_a_sql(spark, duck, nombre):
    bien, texto = comparar(CONSULTAS[nombre](spark, DATOS), duck, ORACULOS[nombre])
    assert bien, texto


def test_catalogo_y_oraculos_coinciden():
    assert set(ORACULOS) == set(CONSULTAS)


def test_orden_de_filas_no_cambia_resultados(spark, duck):
    from pyspark.sql import functions as F

    from balanza.operators import descriptiva
    from balanza.sources.demo import casos

    df = casos(spark, DATOS, ("anio", "ingresado", "atendido"))
    a = descriptiva.perfil_numerico(df).select("variable", "median", "mode", "q75").collect()
    b = (
        descriptiva.perfil_numerico(df.orderBy(F.rand(7)))
        .select("variable", "median", "mode", "q75")
        .collect()
    )
    assert sorted(a) == sorted(b)
