"""Cleaning on literal rows and from files to reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from balanza.esquema import ANIO_DESCARGA, SENTINELA, esquema_crudo
from balanza.operators import limpieza as lim
from balanza.plans.limpieza import ejecutar_limpieza
from balanza.sources import crudo

BASE = {
    "periodo": "ENERO - DICIEMBRE",
    "anio": "2019",
    "fecha_descarga": "15/01/2020",
    "fecha_corte": "31/12/2019",
    "distrito_fiscal": "LIMA",
    "tipo_fiscalia": "PROVINCIAL",
    "materia": "PENAL",
    "especialidad": "PENAL",
    "tipo_caso": "DENUNCIA",
    "especializada": None,
    "ingresado": "10",
    "atendido": "5",
    "ubigeo_pjfs": "150101",
    "dpto_pjfs": "LIMA",
    "prov_pjfs": "LIMA",
    "dist_pjfs": "LIMA",
}


def tabla(spark, *cambios):
    return spark.createDataFrame([{**BASE, **c} for c in cambios], esquema_crudo())


def test_limites_y_sentinela(spark):
    r = lim.limpiar(
        tabla(
            spark,
            {"ingresado": "5", "atendido": "9"},
            {"ingresado": " ", "atendido": "x", "materia": "a"},
            {"ingresado": "-3", "atendido": "12.7", "materia": "b"},
        )
    ).collect()
    por = {x["materia"]: x for x in r}
    assert (por["PENAL"]["ingresado"], por["PENAL"]["atendido"]) == (5, 5)
    assert (por["A"]["ingresado"], por["A"]["atendido"]) == (0, 0)
    assert (por["B"]["ingresado"], por["B"]["atendido"]) == (0, 0)
    assert por["A"]["especializada"] == SENTINELA
    assert por["A"][ANIO_DESCARGA] == 2020


def test_duplicado_que_difiere_en_mayusculas_sobrevive(spark):
    df = tabla(spark, {}, {}, {"distrito_fiscal": "Lima"})
    limpio = lim.limpiar(df)
    assert limpio.count() == 2
    assert {r[0] for r in limpio.select("distrito_fiscal").collect()} == {"LIMA"}
    rep = lim.reporte_limpieza(df).filter("anio = 2019").first()
    assert (rep["filas_originales"], rep["filas_finales"], rep["duplicados_paso"]) == (3, 2, 1)
    # one copy in the raw rows, one among the final rows
    assert rep["duplicados_eliminados"] == 0


def test_fila_sin_columna_critica_se_elimina(spark):
    df = tabla(spark, {}, {"tipo_caso": None}, {"fecha_corte": None})
    assert lim.limpiar(df).count() == 1
    rep = lim.reporte_limpieza(df).filter("anio is null").first()
    assert rep["filas_eliminadas_nulos"] == 2
    assert rep["porcentaje_retencion"] == pytest.approx(100 / 3)


def test_desfase_incluye_fecha_ilegible(spark):
    df = tabla(spark, {}, {"fecha_descarga": "sin fecha"}, {"fecha_descarga": "15/01/2022"})
    rep = lim.reporte_limpieza(df).filter("anio = 2019").first()
    assert rep["inconsistencias_fecha"] == 2


def test_limpiar_es_idempotente(spark):
    df = tabla(spark, {}, {"distrito_fiscal": " lima ", "especializada": "na"}, {"atendido": "99"})
    una = lim.limpiar(df)
    como_texto = una.select(
        *[
            F.date_format(c, "dd/MM/yyyy").alias(c) if t.startswith("timestamp") else F.col(f"`{c}`").cast("string").alias(c)
            for c, t in una.dtypes
            if c != ANIO_DESCARGA
        ]
    )
    dos = lim.limpiar(como_texto)
    assert sorted(map(tuple, dos.collect()), key=repr) == sorted(
        map(tuple, una.dropDuplicates().collect()), key=repr
    )


def escribir(ruta, filas, columnas):
    lineas = [",".join(columnas)]
    lineas += [",".join("" if f[c] is None else f'"{f[c]}"' for c in columnas) for f in filas]
    ruta.write_text("\n".join(lineas), encoding="utf-8")


def test_de_archivos_a_reportes(spark, tmp_path):
    cols = list(BASE)
    escribir(tmp_path / "a.csv", [BASE, BASE, {**BASE, "especializada": "N/A"}], cols)
    # other column order, and one column the table does not know
    otra = {**BASE, "anio": "2020", "extra": "1", "distrito_fiscal": " cañete "}
    escribir(tmp_path / "b.csv", [otra], [*reversed(cols), "extra"])
    rutas = {2019: f"{tmp_path}/a.csv", 2020: f"{tmp_path}/b.csv", 2021: f"{tmp_path}/no_hay.csv"}
    limpio = ejecutar_limpieza(spark, rutas, f"{tmp_path}/limpio", f"{tmp_path}/rep", csv=True)
    filas = {r["anio"]: r["distrito_fiscal"] for r in limpio.collect()}
    assert filas == {2019: "LIMA", 2020: "CAÑETE"}
    assert limpio.count() == 2
    rep = [r.asDict() for r in spark.read.json(f"{tmp_path}/rep/reporte").collect()]
    total = next(r for r in rep if r["anio"] is None)
    assert (total["filas_originales"], total["filas_finales"]) == (4, 2)
    df, archivos = crudo.cargar_limpios(spark, f"{tmp_path}/limpio")
    assert df.count() == 2 and archivos
    como_csv = spark.read.option("header", True).csv(f"{tmp_path}/limpio/csv")
    assert como_csv.count() == 2


def test_limpios_anuales_en_csv(spark, tmp_path):
    limpio = [{**BASE, "fecha_descarga": "2020-01-15", "fecha_corte": "2019-12-31"}]
    for anio in ("2019", "2020"):
        escribir(tmp_path / f"casos_{anio}_limpio.csv", [{**limpio[0], "anio": anio}], list(BASE))
    df, archivos = crudo.cargar_limpios(spark, str(tmp_path))
    assert len(archivos) == 2
    assert dict(df.dtypes)["ingresado"] == "int"
    assert sorted(r["anio"] for r in df.collect()) == [2019, 2020]
    with pytest.raises(FileNotFoundError):
        crudo.cargar_limpios(spark, f"{tmp_path}/vacia")
    with pytest.raises(FileNotFoundError):
        crudo.leer_crudos(spark, {2019: f"{tmp_path}/no.csv"})


def test_tokens_faltantes(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nNA,1\nnull,2\n<NA>,3\nna,4\n", encoding="utf-8")
    r = crudo.leer_csv(spark, f"{tmp_path}/x.csv").collect()
    assert [x["a"] for x in r] == [None, None, None, "na"]


def test_json_de_reporte_guarda_nulos(spark, tmp_path):
    from balanza.sinks.salidas import escribir_json

    escribir_json(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/j")
    # Partitions without a row may leave an empty file.
    linea = "".join(f.read_text() for f in (tmp_path / "j").glob("*.json"))
    assert json.loads(linea) == {"a": 1, "b": None}


def test_csv_con_comillas_saltos_y_filas_rotas(spark, tmp_path):
    from balanza.sources import crudo

    texto = 'anio,materia,ingresado\n2019,"A ""B"", C",10\n2019,"dos\nlineas",3\n2019,corta\n2019,larga,4,5\n'
    (tmp_path / "a.csv").write_text(texto, encoding="utf-8")
    r = {x["materia"]: x["ingresado"] for x in crudo.leer_csv(spark, f"{tmp_path}/a.csv").collect()}
    assert r == {'A "B", C': "10", "dos\nlineas": "3", "corta": None, "larga": "4"}
    rotas = crudo.filas_rotas(spark, {2019: f"{tmp_path}/a.csv", 2020: f"{tmp_path}/no.csv"}).collect()
    assert [tuple(x) for x in rotas] == [(2019, 4, 2)]


def test_anuales_con_columnas_en_otro_orden(spark, tmp_path):
    from balanza.sources import crudo

    (tmp_path / "2019_limpio.csv").write_text("anio,materia,ingresado\n2019,CIVIL,10\n", encoding="utf-8")
    (tmp_path / "2020_limpio.csv").write_text("anio,ingresado,materia\n2020,30,PENAL\n", encoding="utf-8")
    df, archivos = crudo.cargar_limpios(spark, str(tmp_path))
    assert sorted((r["anio"], r["materia"], r["ingresado"]) for r in df.collect()) == [(2019, "CIVIL", 10), (2020, "PENAL", 30)]
    assert len(archivos) == 2


@pytest.fixture
def trozos_pequenos(spark):
    """Files are split every few hundred bytes."""
    claves = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    antes = {c: spark.conf.get(c, None) for c in claves}
    for c, v in claves.items():
        spark.conf.set(c, v)
    yield
    for c, v in antes.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


@pytest.mark.parametrize("salto", ["\n", "\r\n"])
def test_csv_partido_da_las_mismas_filas(spark, tmp_path, trozos_pequenos, salto):
    import csv
    import random

    from balanza.sources.registros import _lineas

    rng = random.Random(4)
    celda = lambda: "".join(rng.choice(["a", "é", ",", '"', "\n", "\n", " ", "x" * 30]) for _ in range(rng.randint(1, 12)))
    filas = [(str(i), celda(), rng.choice(["z", celda(), "\n".join("linea larga" for _ in range(80))])) for i in range(300)]
    with open(tmp_path / "a.csv", "w", encoding="utf-8", newline="") as f:
        escritor = csv.writer(f, lineterminator=salto)
        escritor.writerow(("id", "dos\npartes", "c"))
        escritor.writerows(filas)
        f.write(salto + "300,corta" + salto + "301,larga,4,5" + salto)
    ruta = f"{tmp_path}/a.csv"
    assert _lineas(spark, ruta).rdd.getNumPartitions() > 20
    df = crudo.leer_csv(spark, ruta, faltantes=(), con_rotas=True)
    assert df.columns == ["id", "dos\npartes", "c", "_rota"]
    got = {r[0]: (r[1], r[2], r[3] is not None) for r in df.collect()}
    esperado = {i: (a, b, False) for i, a, b in filas}
    assert {k: v for k, v in got.items() if k not in ("300", "301")} == esperado
    assert got["300"] == ("corta", None, True) and got["301"] == ("larga", "4", True)
    assert df.count() == 302
    assert [tuple(r) for r in crudo.filas_rotas(spark, {2019: ruta}).collect()] == [(2019, 302, 2)]


def test_comilla_suelta_o_sin_cerrar(spark, tmp_path, trozos_pequenos):
    # A quote inside a cell that is not quoted is a character; one that is never closed takes the rest of the file.
    texto = "a,b\n" + "".join(f'{i},pulgada 5" larga\n' for i in range(60)) + '60,"abierta\n61,x\n62,y\n'
    (tmp_path / "a.csv").write_text(texto, encoding="utf-8")
    filas = {r["a"]: r["b"] for r in crudo.leer_csv(spark, f"{tmp_path}/a.csv").collect()}
    assert len(filas) == 61 and filas["7"] == 'pulgada 5" larga'
    assert filas["60"].startswith("abierta") or filas["60"].startswith('"abierta')


def test_estado_tras_una_linea():
    """Against a reader that goes character by character."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from balanza.sources.registros import DENTRO, INICIO, estado_tras

    def plano(linea, estado):
        inicio, dentro, i = estado == INICIO, estado == DENTRO, 0
        while i < len(linea):
            c = linea[i]
            if dentro:
                if c == '"' and linea[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    dentro = False
            elif c == '"' and inicio:
                dentro = True
            inicio = c == "," and not dentro
            i += 1
        return DENTRO if dentro else INICIO

    @settings(max_examples=400, deadline=None)
    @given(st.text('a",', max_size=14), st.sampled_from([INICIO, DENTRO]))
    def probar(linea, estado):
        assert estado_tras(linea, estado) == plano(linea, estado)

    probar()


def test_perfil_de_calidad_dice_los_tipos(spark):
    filas = lim.perfil_calidad(lim.limpiar(tabla(spark, {}))).filter("metrica = 'tipo'").collect()
    tipos = {r["columna"]: r["texto"] for r in filas}
    assert tipos["anio"] == "int" and tipos["materia"] == "string" and tipos["fecha_corte"].startswith("timestamp")
