"""Observations made from the driver's orders: announcements in Spanish whose wording follows from the keys.

The statement is in the SQL that Spark and DuckDB share, so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(key: str, n: int, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:n]))
    return f"(CASE ({key}) % {n} {whens} END)"


ROLES = ["Técnico Auxiliar de Informática", "Programador", "Auxiliar Administrativo", "Operador de Sistemas", "Policía Local", "Ayudantes técnicos - Opción Informática C1.2003", "Administrador de sistemas", "Conserje", "Gestión administrativa, especialidad informática", "Cuerpo de Técnicos Auxiliares de Informática (TAI)", "Analista Programador"]
ISSUERS = ["Ayuntamiento de Martos", "Junta de Andalucía. Consejería de Hacienda", "Diputación de Jaén", "Universidad de Jaén", "Ministerio de Hacienda", "Ayuntamiento de Sevilla", "Servicio Andaluz de Salud"]
SOURCES = ["boe", "boja", "bop_jaen", "iaap", "martos"]
REQUIREMENTS = [
    "Requisitos: estar en posesión del título de Bachiller o Técnico Superior.",
    "Se exige titulación universitaria de grado en ingeniería informática.",
    "Los aspirantes deberán poseer titulación universitaria y bachiller.",
    "El sistema informático de solicitudes usa aplicaciones TIC. Se valorará el título de técnico.",
    "Requisito titulación: ciclo formativo de grado superior; se exige diplomatura.",
    "",
    "Titulación requerida: licenciatura o equivalente, o formación profesional de grado superior.",
]
ACCESS = ["Acceso libre.", "Turno de promoción interna.", "Acceso libre y promoción interna.", "Las plazas no son de promoción interna; turno libre.", "", "Oposición libre."]
STEPS = ["Convocatoria de proceso selectivo.", "Lista provisional de admitidos.", "Lista definitiva de admitidos.", "Fecha de examen publicada.", "Se acuerda la suspensión.", "Nuevo plazo de solicitudes.", "Plazo de presentación abierto.", "Anulación del proceso.", "Relación de aprobados.", "Otros trámites."]
PLACES = ["Martos", "Jaén", "Granada", "Torredelcampo", ""]

SELECT = f"""
SELECT o_orderkey AS seq,
  {_case("o_custkey", 5, SOURCES)} AS source,
  'x' || CAST(o_orderkey % 977 AS STRING) AS external_id,
  'Convocatoria de ' || CAST(o_orderkey % 9 + 1 AS STRING) || ' plazas de ' || {_case("o_orderkey", 11, ROLES)} || ', año ' || CAST(2018 + o_orderkey % 9 AS STRING) AS title,
  {_case("o_custkey", 7, ISSUERS)} AS organisation,
  'Anuncio número ' || CAST(o_orderkey % 50 AS STRING) || '/' || CAST(2018 + o_orderkey % 9 AS STRING) || '. ' || {_case("o_orderkey", 10, STEPS)} AS summary,
  {_case("o_custkey + o_orderkey", 6, ACCESS)} || ' ' || {_case("o_orderkey + 3", 7, REQUIREMENTS)} || ' Ref. BOE-A-' || CAST(2018 + o_orderkey % 9 AS STRING) || '-' || CAST(o_orderkey % 700 AS STRING) || ' y BOP-2024-' || CAST(o_custkey % 90 AS STRING) AS full_text,
  {_case("o_custkey + 2", 5, PLACES)} AS locality,
  (CASE WHEN o_custkey % 3 = 0 THEN 'Jaén' ELSE '' END) AS province,
  (CASE o_orderkey % 4 WHEN 0 THEN 'C1' WHEN 1 THEN 'B' WHEN 2 THEN 'A2' ELSE '' END) AS "group",
  (CASE WHEN o_orderkey % 3 = 0 THEN 'Ciclo formativo de grado superior, familia profesional informática' ELSE '' END) AS qualification_text,
  CAST(o_orderdate AS DATE) AS publication_date,
  o_totalprice AS amount
FROM orders
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    # What follows is bound by the processor: a table of fewer files than cores is dealt out, a large one is read as it is.
    if len(orders.inputFiles()) < (cores := spark.sparkContext.defaultParallelism):
        orders = orders.repartition(cores)
    return spark.sql(SELECT.replace("FROM orders", "FROM {orders}").replace('"group"', "`group`"), orders=orders)
