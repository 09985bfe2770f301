"""Records of CSV files whose quoted cells may hold line breaks, read by many tasks.

Whether a line break ends a record depends on all the text before it.  A first pass
finds for each split of a file in which state it ends for either state it may begin
in: at the start of a record, or inside a quoted cell.  Put together in the order of
the splits, these say how each one begins, so that a second pass cuts all splits at
true record ends side by side.  Only the pieces of records that reach over a split's
end are joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INICIO, DENTRO = 0, 1

# A cell: quoted (quotes inside are doubled) with what follows up to the separator, or not quoted.
_ENTRECOMILLADA = r'"[^"]*(?:""[^"]*)*"(?!")'
_CELDA = rf'(?:{_ENTRECOMILLADA}[^,]*|(?!")[^,]*)'
_COMPLETA = re.compile(rf"{_CELDA}(?:,{_CELDA})*\Z")
_CIERRE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")[^,]*')


def estado_tras(linea: str, estado: int) -> int:
    """State after a line (without its break) that begins in ``estado``."""
    if estado == DENTRO:
        cierre = _CIERRE.match(linea)
        if not cierre:
            return DENTRO
        if cierre.end() == len(linea):
            return INICIO
        linea = linea[cierre.end() + 1 :]
    return INICIO if _COMPLETA.match(linea) else DENTRO


def _lineas(spark: SparkSession, ruta: str) -> DataFrame:
    texto = spark.read.option("lineSep", "\n").text(ruta)
    return texto.select(
        F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("bloque"), F.col("value").alias("linea")
    )


def _por_bloque(lotes: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of lines of one split, in order; a task reads its splits one after the other."""
    for lote in lotes:
        bloques, archivos = lote.column("bloque").to_numpy(), lote.column("archivo").dictionary_encode().indices.to_numpy()
        cambia = np.flatnonzero((bloques[1:] != bloques[:-1]) | (archivos[1:] != archivos[:-1])) + 1
        limites = [0, *cambia.tolist(), lote.num_rows]
        for a, b in zip(limites, limites[1:]):
            if b > a:
                yield (lote.column("archivo")[a].as_py(), int(bloques[a])), lote.column("linea").slice(a, b - a)


def _con_comillas(lineas: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(lineas, '"').to_numpy(zero_copy_only=False))


def _sin_retorno(linea: str) -> str:
    return linea[:-1] if linea.endswith("\r") else linea


def _finales(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, end state from the start of a record, end state from inside a cell)."""
    fin: dict[tuple[str, int], list[int]] = {}
    for clave, lineas in _por_bloque(lotes):
        estados = fin.setdefault(clave, [INICIO, DENTRO])
        for i in _con_comillas(lineas):
            linea = _sin_retorno(lineas[i].as_py())
            # Where both agree, they stay together.
            estados[:] = [estado_tras(linea, estados[0])] * 2 if estados[0] == estados[1] else [estado_tras(linea, e) for e in estados]
    if fin:
        archivos, bloques = zip(*fin)
        a, b = zip(*fin.values())
        columnas = [pa.array(archivos), pa.array(bloques, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
        yield pa.record_batch(columnas, ["archivo", "bloque", "desde_inicio", "desde_dentro"])


def comienzos(lineas: DataFrame) -> dict[tuple[str, int], int]:
    """State in which each split begins: one entry for each split (some 128 MB) of the files."""
    finales = lineas.mapInArrow(_finales, "archivo string, bloque long, desde_inicio int, desde_dentro int")
    salida, archivo, estado = {}, None, INICIO
    for f in sorted(finales.collect()):
        if f["archivo"] != archivo:
            archivo, estado = f["archivo"], INICIO
        salida[f["archivo"], f["bloque"]] = estado
        estado = f["desde_dentro"] if estado == DENTRO else f["desde_inicio"]
    return salida


_TROZOS = "archivo string, bloque long, clase int, texto string"
# Kinds of pieces: a record; the end of one begun in an earlier split; the beginning of one; a split inside one cell.
REGISTRO, FINAL, PRINCIPIO, MEDIO = range(4)


def _cortar(lotes: Iterator[pa.RecordBatch], estados: dict[tuple[str, int], int]) -> Iterator[pa.RecordBatch]:
    """Pieces of the splits; the first record of a file, its header, is left out."""
    clave, pendiente, estado, comienza, cabecera = None, [], INICIO, INICIO, False

    def lote(filas: list[tuple[int, str]]) -> pa.RecordBatch:
        clases, textos = zip(*filas)
        n = len(filas)
        columnas = [pa.array([clave[0]] * n), pa.array([clave[1]] * n, pa.int64()), pa.array(clases, pa.int32()), pa.array(textos, pa.string())]
        return pa.record_batch(columnas, ["archivo", "bloque", "clase", "texto"])

    def resto() -> list[tuple[int, str]]:
        if not pendiente or cabecera:
            return []
        return [(MEDIO if comienza == DENTRO else PRINCIPIO, "\n".join(pendiente))]

    for otra, lineas in _por_bloque(lotes):
        if otra != clave:
            if clave and (filas := resto()):
                yield lote(filas)
            clave, pendiente = otra, []
            estado = comienza = estados[clave]
            cabecera = clave[1] == 0
        filas: list[tuple[int, str]] = []
        textos, hecho = lineas.to_pylist(), 0

        def cerrar(hasta: int) -> None:
            """Lines up to ``hasta`` that are records of their own."""
            nonlocal hecho, cabecera, comienza
            sueltas = [_sin_retorno(t) for t in textos[hecho:hasta]]
            if cabecera and sueltas:
                sueltas, cabecera = sueltas[1:], False
            filas.extend((REGISTRO, t) for t in sueltas if t)
            if hasta > hecho:
                comienza = INICIO
            hecho = hasta

        for i in _con_comillas(lineas).tolist():
            if estado == INICIO:
                cerrar(i)
            else:
                pendiente += [_sin_retorno(t) for t in textos[hecho:i]]
            linea = _sin_retorno(textos[i])
            estado = estado_tras(linea, estado)
            pendiente.append(linea)
            hecho = i + 1
            if estado == INICIO:
                if cabecera:
                    cabecera = False
                else:
                    filas.append((FINAL if comienza == DENTRO else REGISTRO, "\n".join(pendiente)))
                pendiente, comienza = [], INICIO
        if estado == INICIO:
            cerrar(len(textos))
        else:
            pendiente += [_sin_retorno(t) for t in textos[hecho:]]
        if filas:
            yield lote(filas)
    if clave and (filas := resto()):
        yield lote(filas)


def leer_registros(spark: SparkSession, ruta: str) -> DataFrame:
    """(archivo, texto): the records of CSV files without their headers, line breaks inside cells as they are.

    A cell whose quote is never closed reaches to the end of its file.
    """
    lineas = _lineas(spark, ruta)
    estados = spark.sparkContext.broadcast(comienzos(lineas))
    trozos = lineas.mapInArrow(lambda lotes: _cortar(lotes, estados.value), _TROZOS)
    enteros = trozos.filter(F.col("clase") == REGISTRO).select("archivo", "texto")
    # At most two pieces of a split are not whole; one that is the beginning opens a record.
    orden = Window.partitionBy("archivo").orderBy("bloque", "clase")
    partidos = trozos.filter(F.col("clase") != REGISTRO).withColumn(
        "registro", F.count_if(F.col("clase") == PRINCIPIO).over(orden)
    )
    juntos = partidos.groupBy("archivo", "registro").agg(F.sort_array(F.collect_list(F.struct("bloque", "texto"))).alias("t"))
    unidos = juntos.select("archivo", F.array_join(F.col("t.texto"), "\n").alias("texto"))
    return enteros.unionByName(unidos)
