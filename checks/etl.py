"""Cleansing, dimensions, facts, idempotent loads and diagnostics."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import (
    DIMS, FACT_LINES, FACT_TX, LINES, LINES_RAW, STAR, TX, TX_RAW, VOCAB, cents, clean_lines, clean_tables, clean_tx, money, of_both,
    of_dimension, of_lines, of_star, of_table, of_tx, plain, read, refreshed_star, sk, stored_dimensions, stored_star, two_exports, with_,
)
from tillstone.operators import load, parts, profile
from tillstone.operators.cleanse import cleanse_lines, present
from tillstone.plans import star
from tillstone.session import scratch
from tillstone.sources import testshop
from tillstone.sources.tables import LINE_HEADERS, capped_json_rows, rename_headers, scan_table


def _strict_facts(spark: SparkSession, sf: str) -> DataFrame:
    dims = stored_dimensions(spark, sf)
    return plain(star.fact_lines_strict(
        testshop.raw_lines(spark, sf), dims["dim_product"], dims["dim_branch"], dims["dim_payment"], strict=False,
        sizes=clean_lines(spark, sf),
    ))


def _fact_lines(spark: SparkSession, sf: str) -> DataFrame:
    dims = stored_dimensions(spark, sf)
    return plain(star.fact_lines(
        clean_lines(spark, sf), dims["dim_date"], dims["dim_product"], dims["dim_branch"], dims["dim_payment"], VOCAB,
    ))


def _fact_tx(spark: SparkSession, sf: str) -> DataFrame:
    dims = stored_dimensions(spark, sf)
    facts = star.fact_tx(clean_tx(spark, sf), dims["dim_date"], dims["dim_branch"], dims["dim_card"], VOCAB)
    return plain(facts.withColumn("fecha_transaccion", F.date_format("fecha_transaccion", "yyyy-MM-dd HH:mm:ss")))


def _prices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """List prices per part, and per part the greatest price it was sold at."""
    stored = read(spark, sf, "part").select("p_partkey", cents("p_retailprice").alias("price"), F.lit("list").alias("source"))
    sold = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max(cents("l_extendedprice")).alias("price")
    )
    return stored, sold.withColumn("source", F.lit("sold"))


def _dense_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Products numbered in two loads; the second leaves the keys of the first alone."""
    columns = ["description", "tax_type"]
    first, second = (e[0].select(*columns) for e in two_exports(spark, sf))
    none = spark.createDataFrame([], "description string, tax_type string, sk bigint")
    stored, path = load.dense_keys(none, first.where("description LIKE '%a%'"), columns, "sk"), scratch(spark, "dense")
    stored.write.parquet(path)
    stored = spark.read.schema(stored.schema).parquet(path)
    return stored.unionByName(load.dense_keys(stored, first.unionByName(second), columns, "sk"))


def _upsert_parts(spark: SparkSession, sf: str) -> DataFrame:
    """List prices of small parts are stored in parts; prices of sold ones come in twice, cheap sales last."""
    stored, sold = _prices(spark, sf)
    small = read(spark, sf, "part").where("p_size <= 25").select("p_partkey")
    name = f"tillstone_prices_{uuid.uuid4().hex}"
    table = parts.create(stored.join(small, "p_partkey", "left_semi"), name, "p_partkey", parts=32, buckets=4)
    parts.upsert(spark, sold, table)
    parts.upsert(spark, sold.where("price < 50000").withColumn("source", F.lit("cheap")), table)
    return plain(parts.read(spark, table))


def _insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Payment dates are stored; sale dates come in."""
    def days(column: str, source: str):
        return lambda df: df.select(F.to_date(column).alias("day"), F.lit(source).alias("source"))

    lines, tx = clean_tables(spark, sf)
    return load.insert_ignore(days("created_at", "tx")(tx).distinct(), days("sold_at", "lines")(lines), ["day"])


#: The export's headers in the order of the canonical columns; amounts spelled with blanks and brackets.
_EXPORT = {
    "line_id": "id", "tx_id": "ID de transacción", "sold_at": "Fecha", "account": "Cuenta", "branch_norm": "Sede_Normalizada",
    "description": "Descripción", "tax_type": "Tipo de IVA", "pay_form": "Forma de pago",
    "device_serial": "Número de serie del dispositivo", "quantity": "Cantidad", "unit_price": "precio_unitario_calculado",
    "gross": "Precio (Bruto)", "net": "Precio (Neto)", "vat": "IVA",
}


def spanish_export(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines under the export's own headers."""
    return testshop.raw_lines(spark, sf).select(*[F.col(ours).alias(theirs) for ours, theirs in _EXPORT.items()])


def _spanish_lines(spark: SparkSession, sf: str) -> DataFrame:
    """An export under its own headers, all of them renamed back and cleaned."""
    lines = cleanse_lines(rename_headers(spanish_export(spark, sf), LINE_HEADERS))
    def filled(c: str):
        return F.count_distinct(F.nullif(c, F.lit("")))

    return plain(lines.groupBy(F.year("sold_at").alias("anio")).agg(
        F.count("tx_id").alias("lineas"), F.sum("gross").alias("bruto"), F.sum("net").alias("neto"),
        F.count_distinct("line_id").alias("ids"), filled("account").alias("cuentas"), filled("branch_norm").alias("sedes"),
        F.count_distinct("description").alias("descripciones"), F.count("tax_type").alias("tipos_iva"),
        F.count_distinct("pay_form").alias("formas"), F.count_distinct("device_serial").alias("dispositivos"),
        F.sum("quantity").alias("cantidad"), F.sum("unit_price").alias("precio"), F.sum("vat").alias("iva"),
    ))


def _readable(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines whose amounts can be read, the only ones that a strict load takes."""
    amounts = ("quantity", "unit_price", "gross", "net", "vat")
    wanted = [F.col(c).isNull() | F.col(c).try_cast("decimal(18,4)").isNotNull() for c in amounts]
    return testshop.raw_lines(spark, sf).where(reduce(and_, wanted))


def _strict_load(spark: SparkSession, sf: str) -> DataFrame:
    dims = stored_dimensions(spark, sf)
    return plain(star.fact_lines_strict(
        _readable(spark, sf), dims["dim_product"], dims["dim_branch"], dims["dim_payment"], strict=True,
        sizes=clean_lines(spark, sf)))


def _full_reload(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table of other rows and partitions is replaced whole by the line facts."""
    facts, path = stored_star(spark, sf).fact_lines, scratch(spark, "reload")
    load.full_reload(facts.where("precio_bruto > 1000").withColumn("mes_key", F.col("mes_key") - 100), path, ("mes_key",))
    load.full_reload(facts, path, ("mes_key",))
    return plain(spark.read.schema(facts.schema).parquet(path).drop("mes_key"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sources, clean tables, dimensions and facts, as counted before and after a load."""
    lines, tx = clean_tables(spark, sf)
    sources = {"informe_ventas": testshop.raw_lines(spark, sf), "transacciones": testshop.raw_tx(spark, sf)}
    return profile.row_counts({**sources, "lines": lines, "tx": tx, **stored_star(spark, sf).tables()})


def _refreshed_tx(spark: SparkSession, sf: str) -> DataFrame:
    facts = refreshed_star(spark, sf).fact_tx
    return plain(facts.withColumn("fecha_transaccion", F.date_format("fecha_transaccion", "yyyy-MM-dd HH:mm:ss")))


_PROFILED = ("sold_at", "description", "branch_norm", "device_serial")

QUERIES = {
    "e00_cleanse_lines": lambda spark, sf: plain(present(testshop.lines(spark, sf), "tx_id", "sold_at")),
    "e00_cleanse_tx": lambda spark, sf: plain(present(testshop.tx(spark, sf), "tx_id", "created_at")),
    "e00_export_headers": _spanish_lines,
    "e01_scan_table": lambda spark, sf: scan_table(spark, f"{sf}/orders.parquet").select(
        "o_orderkey", "o_orderstatus"
    ),
    "e02_dim_date": of_both(lambda t, l: star.dim_date(l, t)),
    "e03_dim_product": of_lines(lambda l: star.dim_product(l, VOCAB)),
    "e04_dim_branch": of_lines(lambda l: star.dim_branch(l, VOCAB)),
    "e05_dim_payment": of_lines(lambda l: star.dim_payment(l, VOCAB)),
    "e06_dim_card": of_tx(lambda t: star.dim_card(t, VOCAB)),
    "e07_dim_device": of_lines(
        lambda l: star.dim_device(l, star.dim_branch(l, VOCAB), VOCAB, F.lit("2024-01-01").cast("date"))
    ),
    "e08_fact_lines_strict": _strict_facts,
    "e08_fact_lines_strict_load": _strict_load,
    "e09_fact_lines": _fact_lines,
    "e10_fact_tx": _fact_tx,
    "e09_incremental_lines": lambda spark, sf: plain(refreshed_star(spark, sf).fact_lines.drop("mes_key")),
    "e10_incremental_tx": _refreshed_tx,
    "e11_surrogate_key": of_table("part", lambda p: p.select(
        "p_partkey", load.surrogate_key(F.col("p_name"), F.col("p_brand"), F.nullif("p_type", F.lit("SMALL"))).alias("sk")
    )),
    "e11_dense_keys": _dense_keys,
    "e12_insert_ignore": _insert_ignore,
    "e13_upsert_update": lambda spark, sf: plain(load.upsert_update(*_prices(spark, sf), ["p_partkey"])),
    "e13_upsert_parts": _upsert_parts,
    "e14_full_reload": _full_reload,
    "e15_row_count_report": _counts,
    "e15_unmatched_counts": of_star(
        lambda s: profile.unmatched_counts(s.fact_lines, ["fecha_key", "producto_sk", "sede_sk", "pago_sk"])
    ),
    "e15_duplicate_keys": of_dimension("dim_product", lambda d: profile.duplicate_keys(d, "producto_sk")),
    "e15_duplicate_lines": of_lines(lambda l: profile.duplicate_keys(l, "line_id")),
    "e16_distinct_profile": of_lines(lambda l: profile.distinct_profile(l, _PROFILED)),
    "e16_distinct_texts": lambda spark, sf: profile.distinct_profile(testshop.raw_lines(spark, sf), _PROFILED),
    "e17_distinct_sample": of_lines(lambda l: profile.distinct_sample(l, "branch_norm")),
    "e18_capped_json_rows": of_lines(
        lambda l: capped_json_rows(l.select("line_id", "tx_id", "account").orderBy("line_id"))
    ),
}

_LINE_COLUMNS = "line_id, tx_id, account, branch_norm, description, tax_type, pay_form, device_serial"
_LINE_MONEY = ", ".join(f"{money(c)} AS {c}" for c in ("quantity", "unit_price", "gross", "net", "vat"))
_TX_COLUMNS = (
    "tx_id, status, run_as, account_email, card_last4, card_type, capture_mode, auth_code, tx_type, "
    "pay_method, reference, created_at"
)
_TX_MONEY = ", ".join(f"{money(c)} AS {c}" for c in ("fee", "total", "subtotal", "tax", "tip", "deposits"))
_FACT_MONEY = ", ".join(
    f"{money(c)} AS {c}" for c in ("cantidad", "precio_unitario", "precio_bruto", "precio_neto", "iva_monto")
)
_TX_FACT_MONEY = ", ".join(
    f"{money(c)} AS {c}" for c in ("monto_total", "subtotal", "impuesto", "propina", "comision", "depositos")
)

_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS tabla, COUNT(*) AS registros FROM {t}"
    for n, t in (("informe_ventas", f"({LINES_RAW}) r"), ("transacciones", f"({TX_RAW}) r"), *((n, n) for n in (
        "lines", "tx", "dim_date", "dim_product", "dim_branch", "dim_payment", "dim_card", "fact_lines", "fact_tx")))
) + """ UNION ALL SELECT 'dim_device', COUNT(DISTINCT device_serial) FROM lines
WHERE device_serial IS NOT NULL AND device_serial NOT IN ('', 'unspecified')"""


def _profile(column: str, table: str) -> str:
    return f"SELECT '{column}' AS info, COUNT(DISTINCT NULLIF(CAST({column} AS VARCHAR), '')) AS conteo FROM {table}"


def _unmatched(column: str) -> str:
    return f"SELECT '{column}' AS clave, COUNT(*) AS sin_referencia FROM fact_lines WHERE {column} IS NULL"


def _strict(where: str) -> str:
    """The line facts with plain lookups, of the lines that ``where`` takes."""
    return with_(LINES, TX, DIMS) + f"""
SELECT l.tx_id AS id_transaccion, row_number() OVER (PARTITION BY l.tx_id ORDER BY l.line_id) AS linea_ticket,
       CAST(strftime(l.sold_at, '%Y%m%d') AS INTEGER) AS fecha_key,
       (SELECT p.producto_sk FROM dim_product p WHERE p.descripcion = l.description AND p.tipo_iva = l.tax_type) AS producto_sk,
       (SELECT b.sede_sk FROM dim_branch b WHERE b.nombre_sede = l.branch_norm) AS sede_sk,
       (SELECT f.pago_sk FROM dim_payment f WHERE f.forma_pago = l.pay_form) AS pago_sk,
       {money('l.quantity')} AS cantidad, {money('COALESCE(l.unit_price, 0)')} AS precio_unitario,
       {money('COALESCE(l.gross, 0)')} AS precio_bruto, {money('COALESCE(l.net, 0)')} AS precio_neto,
       {money('COALESCE(l.vat, 0)')} AS iva_monto
FROM lines l WHERE l.tx_id IS NOT NULL AND {where}"""


ORACLE = {
    "e00_cleanse_lines": with_(LINES) + f"""
SELECT {_LINE_COLUMNS}, sold_at, day_first AS sold_day_first, {_LINE_MONEY} FROM lines
WHERE tx_id IS NOT NULL AND tx_id <> '' AND sold_at IS NOT NULL""",
    "e00_cleanse_tx": with_(TX) + f"""
SELECT {_TX_COLUMNS}, {_TX_MONEY} FROM tx
WHERE tx_id IS NOT NULL AND tx_id <> '' AND created_at IS NOT NULL""",
    "e00_export_headers": with_(LINES) + f"""
SELECT CAST(EXTRACT(YEAR FROM sold_at) AS INTEGER) AS anio, COUNT(tx_id) AS lineas, {money('SUM(gross)')} AS bruto,
       {money('SUM(net)')} AS neto, COUNT(DISTINCT line_id) AS ids, COUNT(DISTINCT NULLIF(account, '')) AS cuentas,
       COUNT(DISTINCT NULLIF(branch_norm, '')) AS sedes, COUNT(DISTINCT description) AS descripciones,
       COUNT(tax_type) AS tipos_iva, COUNT(DISTINCT pay_form) AS formas, COUNT(DISTINCT device_serial) AS dispositivos,
       {money('SUM(quantity)')} AS cantidad, {money('SUM(unit_price)')} AS precio, {money('SUM(vat)')} AS iva
FROM lines GROUP BY 1""",
    "e01_scan_table": "SELECT o_orderkey, o_orderstatus FROM orders",
    "e02_dim_date": with_(LINES, TX, DIMS) + """
SELECT fecha_key, fecha_completa,
       CAST(EXTRACT(YEAR FROM fecha_completa) AS INTEGER) AS anio,
       CAST(EXTRACT(QUARTER FROM fecha_completa) AS INTEGER) AS trimestre,
       CAST(EXTRACT(MONTH FROM fecha_completa) AS INTEGER) AS mes,
       rpad(strftime(fecha_completa, '%B'), 9, ' ') AS nombre_mes,
       CAST(EXTRACT(DAY FROM fecha_completa) AS INTEGER) AS dia_mes,
       CAST(EXTRACT(DOW FROM fecha_completa) AS INTEGER) AS dia_semana,
       rpad(strftime(fecha_completa, '%A'), 9, ' ') AS nombre_dia_semana,
       EXTRACT(DOW FROM fecha_completa) IN (0, 6) AS es_fin_semana
FROM dim_date""",
    "e03_dim_product": with_(LINES, TX, DIMS) + "SELECT * FROM dim_product",
    "e04_dim_branch": with_(LINES, TX, DIMS) + "SELECT * FROM dim_branch",
    "e05_dim_payment": with_(LINES, TX, DIMS) + "SELECT * FROM dim_payment",
    "e06_dim_card": with_(LINES, TX, DIMS) + "SELECT * FROM dim_card",
    "e07_dim_device": with_(LINES, TX, DIMS) + f"""
SELECT DISTINCT {sk('device_serial')} AS dispositivo_sk, device_serial AS numero_serie, 'SUMUP' AS marca,
       'POS' AS modelo, (SELECT MIN(sede_sk) FROM dim_branch) AS sede_sk, DATE '2024-01-01' AS fecha_instalacion
FROM lines WHERE device_serial IS NOT NULL AND device_serial NOT IN ('', 'unspecified')""",
    "e08_fact_lines_strict": _strict("TRUE"),
    "e08_fact_lines_strict_load": _strict(" AND ".join(
        f"({c} IS NOT NULL OR {c}_text IS NULL)" for c in ("quantity", "unit_price", "gross", "net", "vat"))),
    "e09_fact_lines": with_(LINES, TX, DIMS, FACT_LINES) + f"""
SELECT id_transaccion, linea_ticket, fecha_key, producto_sk, sede_sk, pago_sk, {_FACT_MONEY} FROM fact_lines""",
    "e10_fact_tx": with_(LINES, TX, DIMS, FACT_TX) + f"""
SELECT id_transaccion, fecha_key, sede_sk, tarjeta_sk, correo_electronico, codigo_autorizacion, tipo_transaccion,
       estado, metodo_pago, modo_captura, strftime(fecha_transaccion, '%Y-%m-%d %H:%M:%S') AS fecha_transaccion,
       {_TX_FACT_MONEY}, referencia FROM fact_tx""",
    "e11_surrogate_key": f"""
SELECT p_partkey, {sk('p_name', 'p_brand', "NULLIF(p_type, 'SMALL')")} AS sk FROM part""",
    "e11_dense_keys": with_(LINES, f"""p AS (
  SELECT description, tax_type, {sk('description', 'tax_type')} % {load.KEY_RANGES} AS r,
         max(CASE WHEN sold_at < TIMESTAMP '1996-06-01' AND line_id % 50 <> 0 AND description LIKE '%a%' THEN 1 ELSE 0 END) AS early
  FROM lines WHERE sold_at IS NOT NULL OR line_id % 50 = 0 GROUP BY 1, 2, 3)""") + """
SELECT description, tax_type,
       row_number() OVER (ORDER BY early DESC, r, description NULLS FIRST, tax_type NULLS FIRST) AS sk FROM p""",
    "e12_insert_ignore": with_(LINES, TX) + """
SELECT day, MAX(source) AS source
FROM (SELECT CAST(created_at AS DATE) AS day, 'tx' AS source FROM tx
      UNION SELECT CAST(sold_at AS DATE), 'lines' FROM lines) d
GROUP BY day""",
    "e13_upsert_update": """
SELECT p_partkey, CAST(COALESCE(s.price, CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS price,
       CASE WHEN s.price IS NULL THEN 'list' ELSE 'sold' END AS source
FROM part LEFT JOIN (SELECT l_partkey, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS price
                     FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey""",
    "e13_upsert_parts": """
SELECT p_partkey, CAST(COALESCE(s.price, CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS price,
       CASE WHEN s.price IS NULL THEN 'list' WHEN s.price < 50000 THEN 'cheap' ELSE 'sold' END AS source
FROM part LEFT JOIN (SELECT l_partkey, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS price
                     FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey
WHERE p_size <= 25 OR s.price IS NOT NULL""",
    "e14_full_reload": with_(LINES, TX, DIMS, FACT_LINES) + f"""
SELECT id_transaccion, linea_ticket, fecha_key, producto_sk, sede_sk, pago_sk, {_FACT_MONEY} FROM fact_lines""",
    "e15_row_count_report": with_(*STAR) + _COUNTS,
    "e15_unmatched_counts": with_(*STAR) + " UNION ALL ".join(
        _unmatched(c) for c in ("fecha_key", "producto_sk", "sede_sk", "pago_sk")
    ),
    "e15_duplicate_keys": with_(LINES, TX, DIMS) + """
SELECT producto_sk, COUNT(*) AS filas FROM dim_product GROUP BY 1 HAVING COUNT(*) > 1""",
    "e15_duplicate_lines": with_(LINES) + "SELECT line_id, COUNT(*) AS filas FROM lines GROUP BY 1 HAVING COUNT(*) > 1",
    "e16_distinct_profile": with_(LINES) + " UNION ALL ".join(_profile(c, "lines") for c in _PROFILED),
    "e16_distinct_texts": " UNION ALL ".join(_profile(c, f"({LINES_RAW}) r") for c in _PROFILED),
    "e17_distinct_sample": with_(LINES) + """
SELECT DISTINCT branch_norm FROM lines WHERE branch_norm IS NOT NULL ORDER BY 1 LIMIT 10""",
    "e18_capped_json_rows": f"""
SELECT '{{"line_id":' || line_id || ',"tx_id":' || COALESCE('"' || tx_id || '"', 'null') || ',"account":'
       || CASE WHEN account IS NULL THEN 'null' ELSE '"' || account || '"' END || '}}' AS json
FROM ({LINES_RAW}) r ORDER BY line_id LIMIT 50""",
}
ORACLE["e09_incremental_lines"] = ORACLE["e09_fact_lines"]
ORACLE["e10_incremental_tx"] = ORACLE["e10_fact_tx"]
