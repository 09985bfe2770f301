"""Session helpers: reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def asegurar_checkpoint(spark: SparkSession) -> None:
    """Make sure a reliable checkpoint folder is known to the context.

    The folder comes from ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    carpeta = spark.conf.get("spark.checkpoint.dir", None)
    if not carpeta:
        # "local-cluster" has executors of its own.
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        carpeta = tempfile.mkdtemp(prefix="balanza-")
    sc.setCheckpointDir(carpeta)


def carpeta_nueva(spark: SparkSession, nombre: str) -> str:
    """A new folder below the shared checkpoint folder."""
    asegurar_checkpoint(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{nombre}-{uuid.uuid4().hex}"


# Frames returned by ``cortar``, with their exact row count once it was asked for.
_FILAS: WeakKeyDictionary[DataFrame, int | None] = WeakKeyDictionary()


def cortar(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    Used where a compact aggregate feeds several branches, so that the pass over
    the row-level data runs once and survives the loss of executors.  A frame that
    was cut before is returned as it is.
    """
    if df in _FILAS:
        return df
    asegurar_checkpoint(df.sparkSession)
    cortado = df.checkpoint(eager=True)
    _FILAS[cortado] = None
    return cortado


def cortar_varios(marcos: Mapping[str, DataFrame], hilos: int = 8) -> dict[str, DataFrame]:
    """Cut several independent frames; their jobs are submitted side by side."""
    with ThreadPoolExecutor(hilos) as grupo:
        return dict(zip(marcos, grupo.map(cortar, marcos.values())))


def construir(partes: Mapping[str, Callable[[], T]], hilos: int = 8) -> dict[str, T]:
    """Call independent builders side by side: their small jobs share the cluster."""
    with ThreadPoolExecutor(hilos) as grupo:
        return dict(zip(partes, grupo.map(lambda f: f(), partes.values())))


def filas(df: DataFrame) -> int:
    """Exact row count of a frame returned by ``cortar``, counted when first asked for."""
    n = _FILAS[df]
    if n is None:
        n = _FILAS[df] = df.count()
    return n


# Largest frame, in rows, that is sent whole to every executor.
LIMITE_DIFUSION = 200_000


def difundir(d: DataFrame, columnas: Sequence[str] | None = None) -> DataFrame:
    """Broadcast (columns of) a cut frame only while its counted size is small.

    A frame that was not cut is left to Spark, which knows the size of its files.
    """
    parte = d.select(*columnas) if columnas else d
    if d not in _FILAS:
        return parte
    return F.broadcast(parte) if filas(d) <= LIMITE_DIFUSION else parte


def se_difunde(df: DataFrame) -> bool:
    """Whether Spark would broadcast this frame by its own estimate of the size."""
    limite = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limite
