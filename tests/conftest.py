from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATOS = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from verificacion.comparar import sesion

    s = sesion()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from verificacion.comparar import conexion

    return conexion(DATOS)
