"""The published dimension rows: a warehouse can be opened before any case is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.esquema import SENTINELA
from balanza.functions import clases
from balanza.operators.estrella import numerar_tablas
from balanza.sesion import difundir

# ---------------------------------------------------------------------------
# The rows of each dimension.
# (district, location code, department, province, place)
DISTRITOS = (
    ("AMAZONAS", 10101, "AMAZONAS", "CHACHAPOYAS", "CHACHAPOYAS"),
    ("ANCASH", 20101, "ANCASH", "HUARAZ", "HUARAZ"),
    ("APURIMAC", 30101, "APURIMAC", "ABANCAY", "ABANCAY"),
    ("AREQUIPA", 40101, "AREQUIPA", "AREQUIPA", "AREQUIPA"),
    ("AYACUCHO", 50110, "AYACUCHO", "HUAMANGA", "SAN JUAN BAUTISTA"),
    ("CAJAMARCA", 60101, "CAJAMARCA", "CAJAMARCA", "CAJAMARCA"),
    ("CALLAO", 70101, "CALLAO", "CALLAO", "CALLAO"),
    ("CAÑETE", 150501, "LIMA", "CAÑETE", "SAN VICENTE DE CAÑETE"),
    ("CUSCO", 80108, "CUSCO", "CUSCO", "WANCHAQ"),
    ("HUANCAVELICA", 90101, "HUANCAVELICA", "HUANCAVELICA", "HUANCAVELICA"),
    ("HUANUCO", 100101, "HUANUCO", "HUANUCO", "HUANUCO"),
    ("HUAURA", 150801, "LIMA", "HUAURA", "HUACHO"),
    ("ICA", 110101, "ICA", "ICA", "ICA"),
    ("JUNIN", 120114, "JUNIN", "HUANCAYO", "EL TAMBO"),
    ("LA LIBERTAD", 130101, "LA LIBERTAD", "TRUJILLO", "TRUJILLO"),
    ("LAMBAYEQUE", 140101, "LAMBAYEQUE", "CHICLAYO", "CHICLAYO"),
    ("LIMA CENTRO", 150101, "LIMA", "LIMA", "LIMA"),
    ("LIMA ESTE", 150137, "LIMA", "LIMA", "SANTA ANITA"),
    ("LIMA NOROESTE", 70106, "CALLAO", "CALLAO", "VENTANILLA"),
    ("LIMA NORTE", 150112, "LIMA", "LIMA", "INDEPENDENCIA"),
    ("LIMA SUR", 150142, "LIMA", "LIMA", "VILLA EL SALVADOR"),
    ("LORETO", 160101, "LORETO", "MAYNAS", "IQUITOS"),
    ("MADRE DE DIOS", 170101, "MADRE DE DIOS", "TAMBOPATA", "TAMBOPATA"),
    ("MOQUEGUA", 180101, "MOQUEGUA", "MARISCAL NIETO", "MOQUEGUA"),
    ("PASCO", 190113, "PASCO", "PASCO", "YANACANCHA"),
    ("PIURA", 200101, "PIURA", "PIURA", "PIURA"),
    ("PUNO", 210101, "PUNO", "PUNO", "PUNO"),
    ("SAN MARTIN", 220101, "SAN MARTIN", "MOYOBAMBA", "MOYOBAMBA"),
    ("SANTA", 21801, "ANCASH", "SANTA", "CHIMBOTE"),
    ("SELVA CENTRAL", 120301, "JUNIN", "CHANCHAMAYO", "CHANCHAMAYO"),
    ("SULLANA", 200601, "PIURA", "SULLANA", "SULLANA"),
    ("TACNA", 230101, "TACNA", "TACNA", "TACNA"),
    ("TUMBES", 240101, "TUMBES", "TUMBES", "TUMBES"),
    ("UCAYALI", 250101, "UCAYALI", "CORONEL PORTILLO", "CALLERIA"),
)
TIPOS_FISCALIA = ("PROVINCIAL", "SUPERIOR", "SUPREMA")
MATERIAS = ("CIVIL", "CONTENCIOSO ADMINISTRATIVO", "CONTROL INTERNO", "FAMILIA", "PENAL")
ESPECIALIDADES = {
    "CIVIL": ("CIVIL",),
    "CONTENCIOSO ADMINISTRATIVO": ("CONTENCIOSO ADMINISTRATIVO",),
    "CONTROL INTERNO": ("CONTROL INTERNO",),
    "FAMILIA": (
        "ACTOS CONTRA LA LIBERTAD SEXUAL",
        "FAMILIA",
        "FAMILIA CIVIL",
        "FAMILIA PENAL",
        "FAMILIA TUTELAR",
        "VIOLENCIA FAMILIAR",
    ),
    "PENAL": ("PENAL",),
}
TIPOS_CASO = (
    "APELACION DENUNCIA",
    "APELACION EXPEDIENTE",
    "CONSULTAS",
    "CONTIENDA",
    "DENUNCIA",
    "EXCLUSION FISCAL",
    "EXPEDIENTE",
    "INCIDENTE",
    "INCIDENTE-EXPEDIENTE",
    "INVESTIGACION PREVENTIVA",
    "PROCESO CIVIL",
    "PROCESO CONTENCIOSO",
    "PROCESO FAMILIA",
    "PROCESO PENAL",
    "QUEJAS",
)
ESPECIALIZADAS = (
    "CONTRA LA CRIMINALIDAD ORGANIZADA",
    "CRIMINALIDAD ORGANIZADA",
    "DELITOS ADUANEROS Y CONTRA LA PROPIEDAD INTELECTUAL",
    "DELITOS DE CIBERDELINCUENCIA",
    "DELITOS DE CORRUPCION DE FUNCIONARIOS",
    "DELITOS DE TRAFICO ILICITO DE DROGAS",
    "DELITOS DE TRATA DE PERSONAS",
    "DELITOS TRIBUTARIOS",
    "LAVADO DE ACTIVOS Y PERDIDA DE DOMINIO",
    "MATERIA AMBIENTAL",
    SENTINELA,
    "TRANSITO Y SEGURIDAD VIAL",
    "TURISMO",
    "VIOLENCIA CONTRA LA MUJER Y LOS INTEGRANTES DEL GRUPO FAMILIAR",
)
ANIOS = (2019, 2020, 2021, 2022, 2023)
PERIODO = "ENERO - DICIEMBRE"
# ---------------------------------------------------------------------------


def dimensiones_publicadas(spark: SparkSession) -> dict[str, DataFrame]:
    """The eight dimension tables with the published rows; classes follow from the names."""

    def lista(valores, esquema: str) -> DataFrame:
        return spark.createDataFrame([(v,) for v in valores], esquema)

    lugares = spark.createDataFrame(
        list(DISTRITOS),
        "distrito_fiscal string, ubigeo_pjfs int, departamento string, provincia string, "
        "distrito string",
    )
    c = F.col
    tablas = {
        "dim_ubicaciones": lugares.drop("distrito_fiscal").withColumn(
            "region_geografica", clases.region_geografica(c("departamento"))
        ),
        "dim_tipos_fiscalia": lista(TIPOS_FISCALIA, "tipo_fiscalia string").withColumn(
            "nivel_jerarquico", clases.nivel_jerarquico(c("tipo_fiscalia"))
        ),
        "dim_materias": lista(MATERIAS, "materia string"),
        "dim_tipos_caso": lista(TIPOS_CASO, "tipo_caso string").withColumn(
            "categoria", clases.categoria_caso(c("tipo_caso"))
        ),
        "dim_fiscalias_especializadas": lista(ESPECIALIZADAS, "especializada string").withColumn(
            "area_especializacion", clases.area_especializacion(c("especializada"))
        ),
        "dim_tiempo": lista(ANIOS, "anio int").withColumns(
            {
                "periodo": F.lit(PERIODO),
                "mes_inicio": F.lit(1),
                "mes_fin": F.lit(12),
                "total_dias": F.dayofyear(F.make_date("anio", F.lit(12), F.lit(31))),
            }
        ),
    }
    dims = numerar_tablas(tablas)
    especialidades = spark.createDataFrame(
        [(e, m) for m, es in ESPECIALIDADES.items() for e in es],
        "especialidad string, materia string",
    ).join(difundir(dims["dim_materias"], ["id_materia", "materia"]), "materia")
    distritos = lugares.join(
        difundir(dims["dim_ubicaciones"], ["id_ubicacion", "ubigeo_pjfs"]), "ubigeo_pjfs"
    )
    hijas = {
        "dim_especialidades": especialidades.select("especialidad", "id_materia"),
        "dim_distritos_fiscales": distritos.select("distrito_fiscal", "id_ubicacion").distinct(),
    }
    return {**dims, **numerar_tablas(hijas)}
