"""Star schema on disk, published views, constraint check."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from balanza.operators import bi, calidad, estrella
from balanza.operators.dimensiones import dim_tiempo
from balanza.operators.vista import COLUMNAS_VISTA, vista_desde_casos
from balanza.plans import almacen
from balanza.sources.demo import casos
from tests.conftest import DATOS


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    ruta = str(tmp_path_factory.mktemp("almacen"))
    almacen.cargar_almacen(casos(spark, DATOS), ruta, region=F.col("region_geografica"))
    return ruta


def test_vista_y_funcion_sql(spark, base):
    vista = almacen.abrir_almacen(spark, base)
    assert vista.columns == ["id_caso", *COLUMNAS_VISTA]
    assert vista.count() == casos(spark, DATOS, ("ingresado",)).count()
    assert vista.select("id_caso").distinct().count() == vista.count()
    almacen.publicar_vistas(vista)
    for nombre in almacen.VISTAS_BI:
        assert spark.sql(f"SELECT * FROM {nombre}").count() > 0
    for args, params in (("", ()), ("1998", (1998,)), ("1998, 'PROMO'", (1998, "PROMO"))):
        sql = spark.sql(f"SELECT * FROM calcular_percentil_eficiencia({args})").collect()
        df = bi.calcular_percentil_eficiencia(vista, *params).collect()
        assert {(r[0], float(r[1]), r[2]) for r in sql} == {(r[0], r[1], r[2]) for r in df}


def test_particion_por_anio_se_poda(spark, base):
    v = almacen.abrir_almacen(spark, base).filter("anio = 1998").groupBy("anio").count()
    plan = v._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(id_tiempo" in plan


def test_violaciones_sembradas(spark, base):
    dims, hechos = estrella.CLAVES, None
    d, hechos = almacen.salidas.leer_estrella(spark, base, list(dims))
    repetida = d["dim_materias"].limit(1).withColumn("id_materia", F.lit(999))
    d["dim_materias"] = d["dim_materias"].unionByName(repetida)
    d["dim_tipos_caso"] = d["dim_tipos_caso"].filter("id_tipo_caso > 1")
    malo = hechos.limit(3).withColumn("casos_atendidos", F.col("casos_ingresados") + 1)
    r = {
        (x["regla"], x["tabla"], x["clave"]): x["violaciones"]
        for x in calidad.violaciones(d, hechos.unionByName(malo)).collect()
    }
    h = calidad.HECHOS
    assert r["UNIQUE", "dim_materias", "materia"] == 1
    assert r["CHECK", h, "chk_casos_logicos"] == 3
    perdidas = hechos.unionByName(malo).filter("id_tipo_caso = 1").count()
    assert r["FOREIGN KEY", h, "id_tipo_caso"] == perdidas > 0
    assert r["NOT NULL", h, "id_tiempo"] == 0


def test_sentinela_como_clave_o_nulo(spark):
    df = casos(spark, DATOS)
    dims = estrella.construir_dimensiones(df)
    nulo = estrella.construir_hechos(df, dims).filter("id_fiscalia_especializada is null").count()
    fila = estrella.construir_hechos(df, dims, sentinela_a_nulo=False)
    assert nulo > 0
    assert fila.filter("id_fiscalia_especializada is null").count() == 0


def test_vista_sin_estrella_es_igual(spark, base):
    a = almacen.abrir_almacen(spark, base).select("anio", "materia", "tasa_atencion", "casos_pendientes")
    b = vista_desde_casos(casos(spark, DATOS)).select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_dias_del_anio(spark):
    df = spark.createDataFrame([(2019, "P "), (2020, "P"), (2100, "P")], "anio int, periodo string")
    r = {x["anio"]: x["total_dias"] for x in dim_tiempo(df).collect()}
    assert r == {2019: 365, 2020: 366, 2100: 365}


def test_analisis_de_dimensiones(spark, tmp_path):
    a = almacen.analizar_dimensiones(casos(spark, DATOS))
    almacen.guardar_dimensiones(a, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/materias").count() == a["materias"].count() == 6
    suma = a["tipos_caso"].agg(F.sum("porcentaje")).first()[0]
    assert suma == pytest.approx(100)


def test_retraso_salta_anios_ausentes(spark):
    filas = [(2019, "M", "D", "x", 10, 5), (2021, "M", "D", "x", 15, 5)]
    v = spark.createDataFrame(
        filas,
        "anio int, materia string, departamento string, distrito_fiscal string, "
        "casos_ingresados int, casos_atendidos int",
    ).withColumn("casos_pendientes", F.lit(0))
    r = {x["anio"]: x for x in bi.evolucion_temporal(v).collect()}
    assert r[2021]["ingresados_año_anterior"] == 10
    assert r[2021]["variacion_porcentual_ingresados"] == 50.0


def test_percentil_redondea_al_par(spark):
    filas = [("a", 100, 10), ("b", 100, 20), ("c", 100, 20), ("d", 100, 90)]
    v = spark.createDataFrame(filas, "distrito_fiscal string, casos_ingresados int, casos_atendidos int")
    r = {x["distrito_fiscal"]: x["percentil"] for x in bi.calcular_percentil_eficiencia(v).collect()}
    assert r == {"a": 0, "b": 33, "c": 33, "d": 100}


def test_dimensiones_publicadas(spark):
    from balanza.sources.referencia import dimensiones_publicadas

    d = dimensiones_publicadas(spark)
    tamanos = {k: v.count() for k, v in d.items()}
    assert tamanos == {
        "dim_ubicaciones": 34,
        "dim_distritos_fiscales": 34,
        "dim_tipos_fiscalia": 3,
        "dim_materias": 5,
        "dim_especialidades": 10,
        "dim_tipos_caso": 15,
        "dim_fiscalias_especializadas": 14,
        "dim_tiempo": 5,
    }
    regiones = {r["region_geografica"]: r["count"] for r in d["dim_ubicaciones"].groupBy("region_geografica").count().collect()}
    assert regiones == {"NORTE": 7, "CENTRO": 15, "SUR": 7, "SELVA": 5}
    noroeste = (
        d["dim_distritos_fiscales"]
        .join(d["dim_ubicaciones"], "id_ubicacion")
        .filter("distrito_fiscal = 'LIMA NOROESTE'")
        .first()
    )
    assert noroeste["departamento"] == "CALLAO"
    # a case table with these names finds all its keys
    fila = {
        "anio": 2020,
        "periodo": "ENERO - DICIEMBRE",
        "ubigeo_pjfs": 70106,
        "distrito_fiscal": "LIMA NOROESTE",
        "tipo_fiscalia": "PROVINCIAL",
        "materia": "PENAL",
        "especialidad": "PENAL",
        "tipo_caso": "DENUNCIA",
        "especializada": "TURISMO",
        "ingresado": 3,
        "atendido": 2,
        "fecha_descarga": "2021-01-31",
        "fecha_corte": "2020-12-31",
    }
    h = estrella.construir_hechos(spark.createDataFrame([fila]), d)
    v = estrella.vista_casos_completo(d, h).first()
    assert (v["region_geografica"], v["categoria_caso"], v["area_especializacion"]) == (
        "CENTRO",
        "INGRESO",
        "Turismo",
    )
    assert str(v["tasa_atencion"]) == "0.6667"


def test_hechos_conservan_filas_con_codigos_repetidos_y_tasas_altas(spark):
    import datetime as dt

    from balanza.operators import estrella

    fecha = dt.datetime(2020, 1, 31)
    base = dict(periodo="ENERO - DICIEMBRE", anio=2020, fecha_descarga=fecha, fecha_corte=fecha, distrito_fiscal="LIMA", tipo_fiscalia="SUPERIOR",
                materia="PENAL", especialidad="PENAL", tipo_caso="DENUNCIA", especializada="TURISMO", ubigeo_pjfs=150101, dpto_pjfs="LIMA", prov_pjfs="LIMA")
    filas = [{**base, "dist_pjfs": d, "ingresado": i, "atendido": a} for d, i, a in (("LIMA", 10, 5), ("CERCADO", 10, 5), ("LIMA", 1, 12))]
    esquema = ("periodo string, anio int, fecha_descarga timestamp_ntz, fecha_corte timestamp_ntz, distrito_fiscal string, tipo_fiscalia string, materia string, "
               "especialidad string, tipo_caso string, especializada string, ubigeo_pjfs int, dpto_pjfs string, prov_pjfs string, dist_pjfs string, ingresado int, atendido int")
    df = spark.createDataFrame([tuple(f[c.split()[0]] for c in esquema.split(", ")) for f in filas], esquema)
    dims = estrella.construir_dimensiones(df)
    hechos = estrella.construir_hechos(df, dims).collect()
    assert sorted((r["casos_ingresados"], r["casos_atendidos"], r["tasa_atencion"] is None) for r in hechos) == [(1, 12, True), (10, 5, False), (10, 5, False)]
    assert {r["id_distrito_fiscal"] for r in hechos} == {1}
    # LIMA has more rows than CERCADO.
    assert dims["dim_ubicaciones"].filter("distrito = 'LIMA'").first()["id_ubicacion"] == dims["dim_distritos_fiscales"].first()["id_ubicacion"]


def test_vistas_siguen_a_sus_tablas(spark, tmp_path):
    df = casos(spark, DATOS)
    ruta = str(tmp_path / "almacen")

    def registros() -> dict[str, tuple]:
        return {v: tuple(spark.table(v).agg(F.count(F.lit(1)), F.sum(c)).first()) for v, c in columnas.items()}

    columnas = {
        "v_casos_fiscales_completo": "casos_ingresados",
        "v_resumen_ejecutivo": "total_ingresados",
        "v_performance_distrito": "total_ingresados",
        "v_analisis_materia": "casos_ingresados",
        "v_top_performers": "total_ingresados",
        "v_evolucion_temporal": "ingresados",
        "v_fiscalias_especializadas": "casos_ingresados",
        "v_metricas_regionales": "total_ingresados",
    }
    almacen.publicar_vistas(almacen.cargar_almacen(df.filter("anio <= 1995"), ruta))
    antes = registros()
    vista = almacen.cargar_almacen(df, ruta)
    almacen.refrescar_vistas(spark)
    despues = registros()
    assert all(antes[v] != despues[v] for v in columnas)
    almacen.publicar_vistas(vista)
    assert registros() == despues


def claves(dims):
    """Key of each natural key, for each dimension table."""
    return {t: {tuple(r[c] for c in natural): r[k] for r in dims[t].collect()} for t, (k, natural) in estrella.CLAVES.items()}


def test_claves_que_duran_y_anios_que_se_reemplazan(spark, tmp_path):
    ruta = str(tmp_path / "almacen")
    df = casos(spark, DATOS)
    # Values of the second load that sort before all earlier ones, and another spelling of known places.
    nuevas = {c: F.concat(F.lit("AA "), c) for c in ("materia", "especialidad", "tipo_caso", "prov_pjfs")}
    despues = df.filter("anio = 1998").withColumns(nuevas)
    almacen.cargar_almacen(df.filter("anio <= 1996"), ruta)
    antes, hechos = almacen.salidas.leer_estrella(spark, ruta, list(estrella.CLAVES))
    viejas, archivos = claves(antes), set(hechos.inputFiles())
    casos_antes = {r[0] for r in hechos.select("id_caso").collect()}

    vista = almacen.agregar_anios(despues, ruta)
    dims, hechos = almacen.salidas.leer_estrella(spark, ruta, list(estrella.CLAVES))
    ahora = claves(dims)
    for t, mapa in viejas.items():
        assert {k: v for k, v in ahora[t].items() if k in mapa} == mapa
        assert sorted(ahora[t].values()) == list(range(1, len(ahora[t]) + 1))
    assert min(v for k, v in ahora["dim_materias"].items() if k[0].startswith("AA ")) == len(viejas["dim_materias"]) + 1
    # A district stays where it was, although its place now has a second spelling.
    assert set(viejas["dim_distritos_fiscales"]) <= set(ahora["dim_distritos_fiscales"])
    nuevos = {k for k in ahora["dim_distritos_fiscales"] if k not in viejas["dim_distritos_fiscales"]}
    assert not {k[0] for k in nuevos} & {k[0] for k in viejas["dim_distritos_fiscales"]}
    assert archivos <= set(hechos.inputFiles())
    assert vista.filter("anio = 1998").count() == despues.count()

    # The same year again is the same as once; a smaller one replaces it.
    filas = sorted(map(tuple, vista.drop("id_caso").collect()), key=repr)
    almacen.agregar_anios(despues, ruta)
    otra = almacen.abrir_almacen(spark, ruta)
    assert sorted(map(tuple, otra.drop("id_caso").collect()), key=repr) == filas
    almacen.agregar_anios(despues.limit(10), ruta)
    otra = almacen.abrir_almacen(spark, ruta)
    assert otra.filter("anio = 1998").count() == 10
    assert otra.select("id_caso").distinct().count() == otra.count()
    assert casos_antes <= {r[0] for r in otra.select("id_caso").collect()}
    assert claves(almacen.salidas.leer_estrella(spark, ruta, list(estrella.CLAVES))[0]) == ahora


def test_anio_con_otro_periodo_no_se_duplica(spark, tmp_path):
    ruta = str(tmp_path / "almacen")
    df = casos(spark, DATOS).filter("anio = 1996")
    almacen.cargar_almacen(df, ruta)
    v = almacen.agregar_anios(df.withColumn("periodo", F.lit("ABRIL")), ruta)
    assert v.count() == df.count() and {r[0] for r in v.select("periodo").distinct().collect()} == {"ENERO - DICIEMBRE"}


def test_filas_publicadas_primero(spark, tmp_path):
    ruta = str(tmp_path / "almacen")
    df = casos(spark, DATOS).limit(50).withColumn("materia", F.lit("PENAL"))
    almacen.cargar_almacen(df, ruta, publicadas=True)
    dims, hechos = almacen.salidas.leer_estrella(spark, ruta, list(estrella.CLAVES))
    assert {r["materia"]: r["id_materia"] for r in dims["dim_materias"].collect()}["PENAL"] == 5
    assert {r[0] for r in hechos.select("id_materia").collect()} == {5}
    assert min(r[0] for r in hechos.select("id_tipo_caso").collect()) > 15
    especializadas = dims["dim_fiscalias_especializadas"]
    assert {(r["requiere_capacitacion_especial"], r["descripcion"]) for r in especializadas.collect()} == {(True, None)}
    assert {(r["trimestre"], r["es_periodo_completo"]) for r in dims["dim_tiempo"].collect()} == {(None, True)}
    assert {"es_especializada", "gravedad_casos", "descripcion"} <= set(dims["dim_especialidades"].columns)


def test_vistas_como_tablas(spark, tmp_path):
    df = casos(spark, DATOS)
    ruta = str(tmp_path / "almacen")
    almacen.publicar_vistas(almacen.cargar_almacen(df.filter("anio <= 1997"), ruta), ruta)
    vieja = spark.table("v_performance_distrito").count()
    almacen.agregar_anios(df.filter("anio = 1998"), ruta)
    almacen.refrescar_vistas(spark, ruta, [1998])
    assert spark.table("v_performance_distrito").count() > vieja
    vista = almacen.abrir_almacen(spark, ruta)
    for nombre in almacen.VISTAS_BI:
        f = almacen.VISTAS_BI[nombre]
        tabla, directa = spark.table(nombre), f(vista)
        assert tabla.columns == directa.columns
        assert sorted(map(repr, tabla.collect())) == sorted(map(repr, directa.collect()))
    for nombre in almacen.TABLAS_BI:
        assert "Window" not in spark.table(nombre)._jdf.queryExecution().toString()


def test_ejemplos_de_violaciones(spark, base):
    dims, hechos = almacen.salidas.leer_estrella(spark, base, list(estrella.CLAVES))
    dims["dim_materias"] = dims["dim_materias"].withColumn("materia", F.when(F.col("id_materia") > 1, F.repeat("materia", F.lit(9))))
    r = {(x["regla"], x["tabla"], x["clave"]): (x["violaciones"], x["ejemplo"]) for x in calidad.violaciones(dims, hechos).collect()}
    nulas, ejemplo = r["NOT NULL", "dim_materias", "materia"]
    assert nulas == 1 and ejemplo == "||"
    largas, ejemplo = r["LONGITUD 30", "dim_materias", "materia"]
    assert largas > 0 and len(ejemplo) > 30
    malas, ejemplo = r["CHECK", calidad.HECHOS, "chk_fechas_logicas"]
    assert malas > 0 and len(ejemplo.split("|")) == 4
    assert r["CHECK", calidad.HECHOS, "chk_casos_logicos"] == (0, None)
