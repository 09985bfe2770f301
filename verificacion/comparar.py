"""Run catalogue queries and their oracle SQL side by side and report differences.

    python -m verificacion.comparar /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLAS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def sesion(nucleos: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{nucleos}]")
        .appName("balanza")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(nucleos))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def conexion(carpeta: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{carpeta}/{t}.parquet'")
    return con


def _valor(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", v)
    if isinstance(v, float):
        return ("float", repr(v + 0.0))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, dt.datetime):
        return ("ts", v.isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    return (type(v).__name__, v)


def filas(columnas, datos):
    orden = sorted(range(len(columnas)), key=lambda i: columnas[i])
    norm = [tuple(_valor(f[i]) for i in orden) for f in datos]
    return [columnas[i] for i in orden], sorted(norm, key=repr)


def comparar(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[bool, str]:
    rel = con.sql(sql)
    anchos = [c for c, t in zip(rel.columns, rel.types) if str(t).startswith(("HUGEINT", "DECIMAL"))]
    if anchos:
        return False, f"oracle columns without a plain type: {anchos}"
    cb, b = filas(rel.columns, rel.fetchall())
    ca, a = filas(df.columns, [tuple(r) for r in df.collect()])
    if ca != cb:
        return False, f"columns {set(ca) ^ set(cb)}"
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    malas = [(x, y) for x, y in zip(a, b) if x != y]
    if malas:
        x, y = malas[0]
        detalle = [(c, p, q) for c, p, q in zip(ca, x, y) if p != q]
        return False, f"{len(malas)} of {len(a)} rows differ, first {detalle} in {x}"
    return True, f"{len(a)} rows"


def main(argv: list[str]) -> int:
    from balanza.plans.catalogo import consultas
    from verificacion.oraculos import ORACULOS

    carpeta, nombres = argv[0], argv[1:]
    spark, con = sesion(), conexion(carpeta)
    todas = consultas()
    fallos = 0
    for nombre in nombres or todas:
        t0 = time.time()
        try:
            df = todas[nombre](spark, carpeta)
            if nombre in ORACULOS:
                bien, texto = comparar(df, con, ORACULOS[nombre])
            else:
                bien, texto = True, f"{len(df.collect())} rows (no oracle)"
        except Exception as e:  # noqa: BLE001 - report and go on
            bien, texto = False, f"{type(e).__name__}: {str(e)[:700]}"
        fallos += not bien
        print(f"{'ok  ' if bien else 'FAIL'} {nombre} {time.time() - t0:.2f}s {texto}", flush=True)
    print("failures:", fallos)
    return fallos


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
