"""Time the headline queries and print one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from balanza.plans.catalogo import consultas  # noqa: E402

TITULARES = (
    "resumen_ejecutivo",
    "performance_distrito",
    "analisis_materia",
    "top_performers",
    "evolucion_temporal",
    "fiscalias_especializadas",
    "metricas_regionales",
    "percentil_eficiencia",
    "dim_especialidades",
    "dq_violaciones",
    "limpieza",
    "reporte_limpieza",
    "outliers_limpieza",
    "resumen_general",
    "perfil_eda_numerico",
    "perfil_eda_categorico",
    "metricas_temporales",
    "correlacion_pearson",
    "correlacion_spearman",
    "concentracion_departamental",
    "outliers_iqr",
    "outliers_mad",
    "histograma",
    "kde",
    "outliers_multivariados",
    "vista_completa",
    "hallazgos",
    "clusters_perfil",
)


def main() -> None:
    carpeta = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    nucleos = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{nucleos}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", nucleos)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todas = consultas()
    # One small query first, so that JVM start-up is not charged to the first headline.
    todas["evolucion_anual"](spark, carpeta).collect()
    tiempos: dict[str, float] = {}
    for nombre in TITULARES:
        t0 = time.perf_counter()
        # "noop" computes every row and column without bringing them to the driver.
        todas[nombre](spark, carpeta).write.format("noop").mode("overwrite").save()
        tiempos[nombre] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([\d.]+)", carpeta)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(tiempos.values()), 3),
                "unit": "sec",
                "queries": tiempos,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
