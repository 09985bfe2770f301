"""The two attention rates and the metrics derived from both measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.esquema import SENTINELA
from balanza.functions.clases import SIN_ESPECIALIZACION, clase_volumen_fila


def tasa_nula(ingresado: Column, atendido: Column) -> Column:
    """Analysis form of the rate: null when nothing was filed."""
    return F.when(ingresado > 0, atendido / ingresado)


def tasa_almacen(ingresado: Column, atendido: Column) -> Column:
    """Warehouse form of the rate: four digits, 0 when nothing was filed.

    Whole-number arithmetic on longs, row by row.  A rate of 10 or more does not fit
    and is null; the constraint check counts such rows.
    """
    ing, at = ingresado.cast("long"), atendido.cast("long")
    diezmilesimos = F.call_function("div", F.lit(20_000) * at + ing, F.lit(2) * ing)
    return F.when(ing > 0, diezmilesimos / F.lit(10_000.0)).otherwise(F.lit(0.0)).try_cast("decimal(5,4)")


def derivar_metricas(df: DataFrame) -> DataFrame:
    """Add the eight derived columns used by the exploratory analysis."""
    ing, at = F.col("ingresado"), F.col("atendido")
    derivadas = {
        "tasa_atencion": tasa_nula(ing, at),
        "casos_pendientes": ing - at,
        "eficiencia_perfecta": (at >= ing).cast("int"),
        "volumen_ingresado": clase_volumen_fila(ing),
        "casos_sin_atencion": (at == 0).cast("int"),
        "casos_sin_ingreso": (ing == 0).cast("int"),
    }
    if "especializada" in df.columns:
        esp = F.col("especializada")
        derivadas["especializada_limpia"] = F.when(
            esp == SENTINELA, F.lit(SIN_ESPECIALIZACION)
        ).otherwise(esp)
        derivadas["tiene_especializacion"] = (~esp.eqNullSafe(F.lit(SENTINELA))).cast("int")
    return df.withColumns(derivadas)
