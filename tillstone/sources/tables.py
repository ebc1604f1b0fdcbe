"""Reading raw exports and writing small results."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers of the two exports (blanks and brackets as underscores) and the
# canonical column each one feeds.
TX_HEADERS = {
    "ID_de_transacción": "tx_id",
    "Fecha": "created_at",
    "Estado": "status",
    "Ejecutar_como": "run_as",
    "Comisión": "fee",
    "Total": "total",
    "Subtotal": "subtotal",
    "Impuesto": "tax",
    "Propina": "tip",
    "Depósitos": "deposits",
    "Correo_electrónico": "account_email",
    "Últimos_4_dígitos": "card_last4",
    "Tipo_de_tarjeta": "card_type",
    "Modo_de_captura": "capture_mode",
    "Código_de_autorización": "auth_code",
    "Tipo_de_transacción": "tx_type",
    "Método_de_pago": "pay_method",
    "Referencia": "reference",
}
LINE_HEADERS = {
    "id": "line_id",
    "ID_de_transacción": "tx_id",
    "Fecha": "sold_at",
    "Cuenta": "account",
    "Sede_Normalizada": "branch_norm",
    "Descripción": "description",
    "Tipo_de_IVA": "tax_type",
    "Forma_de_pago": "pay_form",
    "Número_de_serie_del_dispositivo": "device_serial",
    "Cantidad": "quantity",
    "precio_unitario_calculado": "unit_price",
    "Precio_Bruto": "gross",
    "Precio_Neto": "net",
    "IVA": "vat",
}


def rename_headers(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Keep the known columns under their canonical names.

    Both spellings of a header are accepted: "Precio (Bruto)" and "Precio_Bruto".
    """
    picked = []
    for field in df.schema.fields:
        plain = re.sub(r"[ ()]+", "_", field.name).strip("_")
        if plain in headers:
            picked.append(df[f"`{field.name}`"].alias(headers[plain]))
    return df.select(*picked)


def scan_table(spark: SparkSession, location: str, format: str = "parquet", **options: str) -> DataFrame:
    """A table from files, or from a database with ``format='jdbc'`` and its options.

    For a large database table give ``partitionColumn``, ``lowerBound``, ``upperBound``
    and ``numPartitions``: without them one task reads it all.
    """
    reader = spark.read.format(format).options(**options)
    return reader.option("dbtable", location).load() if format == "jdbc" else reader.load(location)


def capped_json_rows(df: DataFrame, cap: int = 50) -> DataFrame:
    """The first ``cap`` rows as JSON text, one per row; values JSON lacks become text."""
    return df.limit(cap).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
