"""The tree of categories: labels, parents and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, label, parent, group.
CATEGORIES = (
    ("ingresos", "Ingresos", None, "income"),
    ("ingresos.sueldo", "Sueldo", "ingresos", "income"),
    ("ingresos.honorarios", "Honorarios", "ingresos", "income"),
    ("ingresos.arriendo", "Arriendos recibidos", "ingresos", "income"),
    ("ingresos.reembolso", "Reembolsos", "ingresos", "income"),
    ("ingresos.otros", "Otros ingresos", "ingresos", "income"),
    ("vivienda", "Vivienda", None, "fixed"),
    ("vivienda.arriendo", "Arriendo / dividendo", "vivienda", "fixed"),
    ("vivienda.gastos-comunes", "Gastos comunes", "vivienda", "fixed"),
    ("servicios", "Servicios básicos", None, "fixed"),
    ("servicios.electricidad", "Electricidad", "servicios", "fixed"),
    ("servicios.agua", "Agua", "servicios", "fixed"),
    ("servicios.gas", "Gas", "servicios", "fixed"),
    ("servicios.internet", "Internet y telefonía", "servicios", "fixed"),
    ("alimentacion", "Alimentación", None, "variable"),
    ("alimentacion.supermercado", "Supermercado", "alimentacion", "variable"),
    ("alimentacion.restaurantes", "Restaurantes y cafés", "alimentacion", "variable"),
    ("alimentacion.delivery", "Delivery", "alimentacion", "variable"),
    ("transporte", "Transporte", None, "variable"),
    ("transporte.combustible", "Combustible", "transporte", "variable"),
    ("transporte.publico", "Transporte público", "transporte", "variable"),
    ("transporte.apps", "Apps de transporte", "transporte", "variable"),
    ("transporte.estacionamiento", "Estacionamiento y TAG", "transporte", "variable"),
    ("salud", "Salud", None, "fixed"),
    ("salud.farmacia", "Farmacia", "salud", "variable"),
    ("salud.prevision", "Isapre / Fonasa", "salud", "fixed"),
    ("educacion", "Educación", None, "fixed"),
    ("cuidado-personal", "Cuidado personal", None, "variable"),
    ("compras", "Compras", None, "variable"),
    ("entretenimiento", "Entretenimiento", None, "variable"),
    ("suscripciones", "Suscripciones", None, "fixed"),
    ("viajes", "Viajes", None, "variable"),
    ("mascotas", "Mascotas", None, "variable"),
    ("regalos", "Regalos y donaciones", None, "variable"),
    ("deudas", "Deudas y créditos", None, "fixed"),
    ("deudas.cuotas", "Compras en cuotas", "deudas", "fixed"),
    ("deudas.intereses", "Intereses", "deudas", "fixed"),
    ("comisiones", "Comisiones bancarias", None, "fixed"),
    ("impuestos", "Impuestos", None, "fixed"),
    ("seguros", "Seguros", None, "fixed"),
    ("ahorro", "Ahorro", None, "savings"),
    ("inversiones", "Inversiones", None, "savings"),
    ("transferencias", "Transferencias entre cuentas", None, "neutral"),
    ("pago-tarjeta", "Pago de tarjeta", None, "neutral"),
    ("sin-categoria", "Sin categoría", None, "variable"),
)
FIXED = tuple(i for i, _, _, group in CATEGORIES if group == "fixed")


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, label string, parent string, category_group string")


def is_fixed(category: Column) -> Column:
    return F.coalesce(category.isin(*FIXED), F.lit(False))


def labelled(df: DataFrame) -> DataFrame:
    """Adds label, parent, path and group; an unknown id is its own label, and variable."""
    dim = dimension(df.sparkSession)
    parents = dim.select(F.col("category").alias("parent"), F.col("label").alias("parent_label"))
    known = F.broadcast(dim.join(parents, "parent", "left"))  # some fifty rows
    label = F.coalesce("label", F.when(F.col("category").isNull() | (F.col("category") == ""), "Sin categoría").otherwise(F.col("category")))
    out = df.join(known, "category", "left").withColumn("label", label)
    path = F.when(F.col("parent_label").isNotNull(), F.concat("parent_label", F.lit(" › "), "label")).otherwise(F.col("label"))
    return out.withColumn("path", path).withColumn("category_group", F.coalesce("category_group", F.lit("variable"))).drop("parent_label")
