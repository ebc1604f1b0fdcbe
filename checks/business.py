"""Business queries against the SQL that states them directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks.base import (
    LINES, STAR, TX, VOCAB, account_case, alias_case, broad_case, clean_tables, money, of_both, of_lines, of_star, once,
    pct, per_quantity, per_unit, plain, stored_dimensions, two_exports, with_,
)
from checks.etl import spanish_export
from tillstone.operators.cleanse import cleanse_lines
from tillstone.plans import hours, loyalty, payments, products, sales, tickets
from tillstone.sources.tables import LINE_HEADERS, rename_headers


def _loyalty_view(spark: SparkSession, sf: str) -> DataFrame:
    lines, tx = clean_tables(spark, sf)
    return loyalty.loyalty_view(tx, lines, stored_dimensions(spark, sf)["dim_branch"], VOCAB)


def _top5_of_export(spark: SparkSession, sf: str) -> DataFrame:
    """The view's variant of the data: the text export under its own headers, not the typed tables."""
    lines = cleanse_lines(rename_headers(spanish_export(spark, sf), LINE_HEADERS))
    return plain(products.top_products(lines, VOCAB))


def _bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """Bitmaps of two overlapping exports, stored once."""
    return once(spark, sf, "tickets", lambda out: _filled(spark, sf, out))


def _filled(spark: SparkSession, sf: str, out: str) -> DataFrame:
    for lines, _ in two_exports(spark, sf):
        tickets.add(spark, lines, out, VOCAB)
    return tickets.read(spark, out)


QUERIES = {
    "q01_overview_tickets": of_both(lambda t, l: sales.overview_tickets(t, l, VOCAB)),
    "q02_overview_star": of_star(lambda s: sales.overview_star(s.fact_lines, s.dim_branch, s.fact_tx, VOCAB)),
    "q03_sales_by_branch": of_both(lambda t, l: sales.sales_by_branch(t, l, VOCAB)),
    "q04_tips_raw": of_both(lambda t, l: sales.tips_raw(t, l, VOCAB)),
    "q05_tips_view": of_both(lambda t, l: sales.tips_view(t, l, VOCAB)),
    "q06_peak_hours_raw": of_lines(lambda l: hours.peak_hours_raw(l, VOCAB)),
    "q07_peak_hours_view": of_lines(lambda l: hours.peak_hours_view(l, VOCAB)),
    "q07_peak_hours_bitmaps": lambda spark, sf: tickets.peak_hours(_bitmaps(spark, sf), VOCAB),
    "q07_tickets_by_month": lambda spark, sf: tickets.distinct_tickets(_bitmaps(spark, sf), ["mes_key", "sede"]),
    "q08_loyalty_raw": of_both(lambda t, l: loyalty.loyalty_raw(t, l, VOCAB)),
    "q09_loyalty_view": lambda spark, sf: plain(_loyalty_view(spark, sf)),
    "q09_loyalty_newest": lambda spark, sf: plain(loyalty.newest(_loyalty_view(spark, sf))),
    "q10_purchase_behavior_raw": of_both(lambda t, l: sales.purchase_behavior(t, l, VOCAB)),
    "q11_purchase_behavior_view": of_both(
        lambda t, l: sales.purchase_behavior(t, l, VOCAB, keep_unnamed=True)
    ),
    "q12_top5_products_raw": of_lines(lambda l: products.top_products(l, VOCAB)),
    "q13_top5_products_view": _top5_of_export,
    "q14_payment_mix_raw": of_both(lambda t, l: payments.payment_mix_raw(t, l, VOCAB)),
    "q15_payment_mix_view": of_both(lambda t, l: payments.payment_mix_view(t, l, VOCAB)),
    "q16_hourly_sales_raw": of_both(lambda t, l: hours.hourly_sales(t, l, VOCAB)),
    "q17_hourly_sales_view": of_both(lambda t, l: hours.hourly_sales(t, l, VOCAB, text_amounts=True)),
    "q18_products_share_raw": of_lines(lambda l: products.products_share_raw(l, VOCAB)),
    "q19_products_share_star": of_star(
        lambda s: products.products_share_star(s.fact_lines, s.dim_product, VOCAB)
    ),
    "q20_busy_hours_raw": of_lines(lambda l: hours.busy_hours(l, VOCAB)),
    "q21_busy_hours_view": of_lines(lambda l: hours.busy_hours(l, VOCAB, drop_blank_keys=True)),
    "e19_dates_to_iso": of_lines(lambda l: hours.dates_to_iso(hours.busy_hours(l, VOCAB))),
}

_NO_TIPS = "description NOT ILIKE '%tip%' AND description NOT ILIKE '%gratuity%'"
_NO_MANUAL = "description NOT ILIKE '%tip%' AND description NOT ILIKE '%custom amount%'"
_SETTLED = "status IN ('successful', 'paid')"

_OVERVIEW = f"""
SELECT CASE WHEN is_total = 1 THEN '>> TOTAL CONSOLIDADO <<' ELSE cuenta END AS cuenta, transacciones,
       {money('gross')} AS venta_bruta, {money('fee')} AS comisiones_sumup,
       {money('gross - fee')} AS liquido_a_recibir, {per_unit('gross', 'transacciones')} AS ticket_promedio,
       {money('net - fee')} AS margen_operativo_real
FROM rolled"""

_TIP_COLUMNS = f"""
SELECT sede_unificada, n AS transacciones_totales, n_tip AS transacciones_con_propina,
       {pct('n_tip', 'n')} AS tasa_conversion_propina_pct,
       {money('tips')} AS propinas_totales, {per_unit('tips', 'n_tip')} AS propina_promedio
FROM parts"""

_LOYALTY = f"""
SELECT nombre_sede, mes_operacion,
       COUNT(DISTINCT CASE WHEN days = 1 THEN card END) AS clientes_un_solo_dia,
       COUNT(DISTINCT CASE WHEN days = 2 THEN card END) AS clientes_recurrentes_2_veces,
       COUNT(DISTINCT CASE WHEN days > 2 THEN card END) AS clientes_fans_3_o_mas,
       {pct('COUNT(DISTINCT CASE WHEN days >= 2 THEN card END)', 'COUNT(DISTINCT card)')} AS tasa_fidelidad_mes_pct
FROM (SELECT nombre_sede, strftime(day, '%Y-%m') AS mes_operacion, card, COUNT(DISTINCT day) AS days
      FROM visits GROUP BY 1, 2, 3) m
GROUP BY 1, 2"""

_BEHAVIOR = f"""
SELECT sede_unificada,
       COUNT(CASE WHEN items = 1 THEN 1 END) AS ventas_solitarias,
       COUNT(CASE WHEN items > 1 THEN 1 END) AS ventas_con_acompanamiento,
       {pct('COUNT(CASE WHEN items > 1 THEN 1 END)', 'COUNT(*)')} AS tasa_de_sugestion_exito_pct,
       {per_unit('SUM(CASE WHEN items = 1 THEN amount END)', 'COUNT(CASE WHEN items = 1 THEN 1 END)')} AS ticket_promedio_solo,
       {per_unit('SUM(CASE WHEN items > 1 THEN amount END)', 'COUNT(CASE WHEN items > 1 THEN 1 END)')} AS ticket_promedio_acompanado
FROM baskets GROUP BY 1"""


def _baskets(name: str) -> str:
    return f"""baskets AS (
  SELECT {alias_case()} AS sede_unificada, t.tx_id, COUNT(*) AS items, SUM(gross) AS amount
  FROM tx t JOIN lines l ON t.tx_id = l.tx_id
  WHERE status = 'successful' AND lower({name}) NOT IN ('tip', 'custom amount') AND gross > 0
  GROUP BY 1, 2)"""


def _behavior(name: str) -> str:
    return with_(LINES, TX, _baskets(name)) + _BEHAVIOR


#: The money behind the averages of the view.
BASKET_SUMS = with_(LINES, TX, _baskets("COALESCE(description, '')")) + f"""
SELECT sede_unificada, {money('SUM(CASE WHEN items = 1 THEN amount END)')} AS monto_solo,
       {money('SUM(CASE WHEN items > 1 THEN amount END)')} AS monto_acompanado FROM baskets GROUP BY 1"""


TOP5 = with_(LINES) + f"""
SELECT sede_unificada, producto, {money('revenue')} AS ingresos_producto, CAST(ranking AS INTEGER) AS ranking
FROM (SELECT *, row_number() OVER (PARTITION BY sede_unificada ORDER BY revenue DESC, producto) AS ranking
      FROM (SELECT {alias_case()} AS sede_unificada, description AS producto, SUM(gross) AS revenue
            FROM lines WHERE {_NO_MANUAL} AND gross > 0 GROUP BY 1, 2) p) r
WHERE ranking <= 5"""


def _mix(payments_where: str, order: str, debit: str, credit: str, described: str, zero: bool) -> str:
    no_tips = f"{described} NOT ILIKE '%tip%' AND {described} NOT ILIKE '%gratuity%'"
    ctes = (
        LINES, TX,
        f"""payments AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY {order}, fee DESC NULLS LAST) AS rn
                 FROM tx WHERE {payments_where}) p WHERE rn = 1)""",
        f"tickets AS (SELECT tx_id, SUM(gross) AS gross FROM lines WHERE {no_tips} AND gross > 0 GROUP BY 1)",
        f"""rolled AS (
  SELECT medio, GROUPING(medio) AS is_total, COUNT(*) AS n, SUM(gross) AS gross, SUM(fee) AS fee
  FROM (SELECT CASE WHEN {debit} THEN 'Débito' WHEN {credit} THEN 'Crédito' ELSE 'Efectivo' END AS medio,
               t.gross, COALESCE(p.fee, 0) AS fee
        FROM tickets t JOIN payments p ON t.tx_id = p.tx_id) c
  GROUP BY ROLLUP(medio))""",
    )

    def guard(expression: str) -> str:
        return f"COALESCE({expression}, 0)" if zero else expression

    return with_(*ctes) + f"""
SELECT CASE WHEN r.is_total = 1 THEN 'TOTAL GENERAL' ELSE r.medio END AS medio_de_pago,
       r.n AS total_transacciones, {guard(pct('r.n', 't.n'))} AS participacion_transacciones_pct,
       {money('r.gross')} AS ventas_totales, {guard(pct('r.gross', 't.gross'))} AS participacion_ventas_pct,
       {money('r.fee')} AS comision_total, {guard(pct('r.fee', 'r.gross'))} AS tasa_comision_pct
FROM rolled r CROSS JOIN (SELECT * FROM rolled WHERE is_total = 1) t"""


def _hourly(total: str, fee: str, lines_where: str, otherwise: str) -> str:
    return with_(LINES, TX) + f"""
SELECT s.sede, CAST(t.hora AS INTEGER) AS hora, COUNT(*) AS transacciones, {money('SUM(t.total)')} AS ventas_brutas
FROM (SELECT DISTINCT tx_id, {total} AS total, {fee} AS fee, EXTRACT(HOUR FROM created_at) AS hora
      FROM tx WHERE status = 'successful' AND created_at IS NOT NULL) t
JOIN (SELECT DISTINCT tx_id, {alias_case(otherwise)} AS sede FROM lines WHERE {lines_where}) s ON t.tx_id = s.tx_id
GROUP BY 1, 2"""


def _distinct_when(condition: str, name: str) -> str:
    return f"COUNT(DISTINCT CASE WHEN {condition} THEN tx_id END) AS {name}"


def _busy(where: str, day: str = "CAST(sold_at AS DATE)") -> str:
    return with_(LINES) + f"""
SELECT {day} AS dia,
       CASE EXTRACT(DOW FROM sold_at) WHEN 1 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miércoles'
            WHEN 4 THEN 'Jueves' WHEN 5 THEN 'Viernes' WHEN 6 THEN 'Sábado' WHEN 0 THEN 'Domingo' END AS dia_semana,
       CAST(EXTRACT(HOUR FROM sold_at) AS INTEGER) AS hora_del_dia,
       {_distinct_when("account IN ('north', 'north@shop.example')", 'north')},
       {_distinct_when("account IN ('South', 'south@shop.example')", 'south')},
       {_distinct_when("account IN ('East', 'east@shop.example')", 'east')}
FROM lines WHERE {_NO_MANUAL} AND day_first AND sold_at IS NOT NULL AND {where}
GROUP BY 1, 2, 3"""


# The capitalised name: cut into letter-or-digit runs and other runs.
_INITCAP = (
    r"array_to_string(list_transform(regexp_extract_all(lower(description), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'), "
    "lambda x: upper(x[1]) || x[2:]), '')"
)

_LOYALTY_VIEW = with_(
    LINES, TX,
    "names AS (SELECT DISTINCT branch_norm AS nombre FROM lines "
    "WHERE branch_norm IS NOT NULL AND branch_norm NOT IN ('', 'unspecified'))",
    """visits AS (
  SELECT CASE WHEN account_email ILIKE '%north%' THEN 'North' WHEN account_email ILIKE '%south%' THEN 'South'
              WHEN account_email ILIKE '%east%' THEN 'East' WHEN account_email ILIKE '%west%hall%' THEN 'West Hall'
              ELSE COALESCE(n.nombre, 'No Identificada') END AS nombre_sede,
         card_last4 AS card, CAST(created_at AS DATE) AS day
  FROM tx t LEFT JOIN lines l ON t.tx_id = l.tx_id LEFT JOIN names n ON n.nombre = l.branch_norm
  WHERE lower(COALESCE(status, '')) = 'successful' AND card_last4 IS NOT NULL AND card_last4 <> ''
    AND created_at IS NOT NULL)""",
) + _LOYALTY

ORACLE = {
    "q01_overview_tickets": with_(
        LINES, TX,
        f"fees AS (SELECT tx_id, MAX(fee) AS fee FROM tx WHERE {_SETTLED} GROUP BY 1)",
        f"""tickets AS (SELECT tx_id, MAX({account_case('Sede No Identificada')}) AS sede,
  SUM(gross) AS gross, SUM(net) AS net FROM lines WHERE {_NO_TIPS} AND gross > 0 GROUP BY 1)""",
        """rolled AS (SELECT sede AS cuenta, GROUPING(sede) AS is_total, COUNT(t.tx_id) AS transacciones,
  SUM(gross) AS gross, SUM(net) AS net, SUM(fee) AS fee
  FROM tickets t JOIN fees f ON t.tx_id = f.tx_id GROUP BY ROLLUP(sede))""",
    ) + _OVERVIEW,
    "q02_overview_star": with_(
        *STAR,
        """rolled AS (SELECT b.nombre_sede AS cuenta, GROUPING(b.nombre_sede) AS is_total,
  COUNT(DISTINCT v.id_transaccion) AS transacciones, SUM(v.precio_bruto) AS gross,
  SUM(v.precio_neto) AS net, COALESCE(SUM(t.comision), 0) AS fee
  FROM fact_lines v JOIN dim_branch b ON v.sede_sk = b.sede_sk
  LEFT JOIN fact_tx t ON v.id_transaccion = t.id_transaccion GROUP BY ROLLUP(b.nombre_sede))""",
    ) + _OVERVIEW,
    "q03_sales_by_branch": with_(
        LINES, TX,
        f"""rolled AS (SELECT sede, GROUPING(sede) AS is_total, SUM(gross) AS gross, COUNT(DISTINCT tx_id) AS n
  FROM (SELECT {account_case('Desconocido')} AS sede, tx_id, gross FROM lines
        WHERE tx_id IN (SELECT tx_id FROM tx WHERE {_SETTLED})
          AND description NOT ILIKE 'tip' AND description NOT ILIKE 'gratuity' AND gross > 0) s
  GROUP BY ROLLUP(sede))""",
    ) + f"""
SELECT CASE WHEN is_total = 1 THEN 'TOTAL GENERAL' ELSE sede END AS cuenta, {money('gross')} AS ventas_totales,
       n AS transacciones, {per_unit('gross', 'n')} AS ticket_promedio FROM rolled""",
    "q04_tips_raw": with_(
        LINES, TX,
        f"""base AS (SELECT DISTINCT t.tx_id, {alias_case()} AS sede FROM tx t JOIN lines l ON t.tx_id = l.tx_id
  WHERE status = 'successful')""",
        "tips AS (SELECT tx_id, SUM(net) AS tip FROM lines WHERE lower(description) = 'tip' GROUP BY 1)",
        """parts AS (SELECT b.sede AS sede_unificada, COUNT(DISTINCT b.tx_id) AS n, COUNT(DISTINCT p.tx_id) AS n_tip,
  SUM(p.tip) AS tips FROM base b LEFT JOIN tips p ON b.tx_id = p.tx_id GROUP BY 1)""",
    ) + _TIP_COLUMNS,
    "q05_tips_view": with_(
        LINES, TX,
        f"""tips AS (SELECT tx_id, {broad_case('branch_norm', "COALESCE(branch_norm, 'Sede No Identificada')")} AS sede,
  COALESCE(net, 0) AS tip FROM lines
  WHERE lower(trim(description)) = 'tip' AND tx_id IS NOT NULL AND tx_id <> '')""",
        f"""paid AS (SELECT DISTINCT tx_id, {broad_case("lower(COALESCE(account_email, ''))", "'Sede No Identificada'")} AS sede
  FROM tx WHERE lower(COALESCE(status, '')) = 'successful' AND tx_id IS NOT NULL AND tx_id <> '')""",
        """parts AS (SELECT COALESCE(t.sede, p.sede) AS sede_unificada, COUNT(DISTINCT p.tx_id) AS n,
  COUNT(DISTINCT t.tx_id) AS n_tip, COALESCE(SUM(t.tip), 0) AS tips
  FROM paid p LEFT JOIN tips t ON p.tx_id = t.tx_id GROUP BY 1)""",
    ) + _TIP_COLUMNS,
    "q06_peak_hours_raw": with_(LINES) + f"""
SELECT CAST(EXTRACT(HOUR FROM sold_at) AS INTEGER) AS hora_del_dia,
       {_distinct_when("account IN ('north', 'north@shop.example')", 'sede_north')},
       {_distinct_when("account IN ('South', 'south@shop.example')", 'sede_south')},
       {_distinct_when("account IN ('East', 'east@shop.example')", 'sede_east')}
FROM lines WHERE {_NO_MANUAL} AND regexp_matches(sold_text, '^\\d{{2}}-\\d{{2}}-\\d{{4}}, \\d{{2}}:\\d{{2}}')
GROUP BY 1""",
    "q07_peak_hours_view": with_(LINES) + f"""
SELECT CAST(EXTRACT(HOUR FROM sold_at) AS INTEGER) AS hora_del_dia,
       {_distinct_when("branch_norm ILIKE '%north%'", 'sede_north')},
       {_distinct_when("branch_norm ILIKE '%south%'", 'sede_south')},
       {_distinct_when("branch_norm ILIKE '%east%'", 'sede_east')},
       {_distinct_when("branch_norm ILIKE '%west%hall%'", 'sede_west_hall')},
       COUNT(DISTINCT tx_id) AS total_transacciones
FROM lines WHERE {_NO_MANUAL} AND sold_at IS NOT NULL AND gross > 0 GROUP BY 1""",
    "q07_tickets_by_month": with_(LINES) + f"""
SELECT CAST(EXTRACT(YEAR FROM sold_at) * 100 + EXTRACT(MONTH FROM sold_at) AS INTEGER) AS mes_key, sede, COUNT(DISTINCT tx_id) AS tickets
FROM lines JOIN (VALUES ('total', '%'), ('north', '%north%'), ('south', '%south%'), ('east', '%east%'), ('west_hall', '%west%hall%')) b(sede, fits)
  ON sede = 'total' OR branch_norm ILIKE fits
WHERE {_NO_MANUAL} AND sold_at IS NOT NULL AND gross > 0 AND tx_id IS NOT NULL GROUP BY 1, 2""",
    "q08_loyalty_raw": with_(
        LINES, TX,
        f"""visits AS (SELECT {alias_case()} AS nombre_sede, card_last4 AS card, CAST(created_at AS DATE) AS day
  FROM tx t JOIN (SELECT DISTINCT tx_id, account FROM lines) l ON t.tx_id = l.tx_id
  WHERE status = 'successful' AND card_last4 IS NOT NULL)""",
    ) + _LOYALTY,
    "q09_loyalty_view": _LOYALTY_VIEW,
    "q09_loyalty_newest": _LOYALTY_VIEW + " ORDER BY mes_operacion DESC, nombre_sede LIMIT 20",
    "q10_purchase_behavior_raw": _behavior("description"),
    "q11_purchase_behavior_view": _behavior("COALESCE(description, '')"),
    "q12_top5_products_raw": TOP5,
    "q13_top5_products_view": TOP5,
    "q14_payment_mix_raw": _mix(
        _SETTLED, "run_as NULLS LAST", "p.run_as = 'DEBIT'", "p.run_as = 'CREDIT'", "description", False
    ),
    "q15_payment_mix_view": _mix(
        "lower(COALESCE(status, '')) IN ('successful', 'paid') AND tx_id IS NOT NULL AND tx_id <> ''",
        "run_as NULLS LAST",
        "upper(COALESCE(p.run_as, '')) IN ('DEBIT', 'DEBITO')",
        "upper(COALESCE(p.run_as, '')) IN ('CREDIT', 'CREDITO')",
        "lower(COALESCE(description, ''))", True,
    ),
    "q16_hourly_sales_raw": _hourly("total", "fee", "TRUE", "trim(account)"),
    "q17_hourly_sales_view": _hourly(
        "COALESCE(total, 0)", "COALESCE(fee, 0)", "tx_id IS NOT NULL AND tx_id <> ''",
        "trim(COALESCE(account, ''))",
    ),
    "q18_products_share_raw": with_(
        LINES,
        f"""totals AS (SELECT SUM(gross) AS money, COUNT(DISTINCT tx_id) AS tickets FROM lines
  WHERE {_NO_TIPS} AND gross > 0)""",
        f"""base AS (SELECT CASE WHEN description IS NULL OR trim(description) = '' THEN 'Producto Sin Nombre'
       ELSE trim({_INITCAP}) END AS producto, quantity, gross, tx_id
  FROM lines WHERE {_NO_TIPS} AND description NOT ILIKE '%custom amount%' AND gross > 0)""",
        """grouped AS (SELECT producto, SUM(quantity) AS units, SUM(gross) AS gross, COUNT(DISTINCT tx_id) AS n
  FROM base GROUP BY 1 ORDER BY gross DESC, lower(producto) LIMIT 50)""",
    ) + f"""
SELECT producto, {money('units')} AS unidades_vendidas, {money('gross')} AS ventas_brutas,
       {per_quantity('gross', 'units', 0)} AS precio_promedio,
       {pct('gross', 't.money')} AS share_ventas_pct, {pct('n', 't.tickets')} AS tasa_penetracion_pct
FROM grouped CROSS JOIN totals t""",
    "q19_products_share_star": with_(
        *STAR,
        """totals AS (SELECT SUM(precio_bruto) AS money, COUNT(DISTINCT id_transaccion) AS tickets
  FROM fact_lines WHERE precio_bruto > 0)""",
        """grouped AS (SELECT p.descripcion AS producto, p.categoria, SUM(v.cantidad) AS units,
  SUM(v.precio_bruto) AS gross, COUNT(DISTINCT v.id_transaccion) AS n
  FROM fact_lines v JOIN dim_product p ON v.producto_sk = p.producto_sk
  WHERE v.precio_bruto > 0 AND p.descripcion NOT ILIKE '%tip%' AND p.descripcion NOT ILIKE '%gratuity%'
    AND p.descripcion NOT ILIKE '%custom amount%'
  GROUP BY 1, 2 ORDER BY gross DESC, producto LIMIT 100)""",
    ) + f"""
SELECT producto, categoria, {money('units')} AS unidades_vendidas, {money('gross')} AS ventas_brutas,
       CASE WHEN units > 0 THEN {per_quantity('gross', 'units', 2)} ELSE 0 END AS precio_promedio_unitario,
       CASE WHEN COALESCE(t.money, 1) > 0 THEN {pct('gross', 't.money')} ELSE 0 END AS share_ventas_pct,
       CASE WHEN COALESCE(t.tickets, 1) > 0 THEN {pct('n', 't.tickets')} ELSE 0 END AS tasa_penetracion_pct,
       n AS tickets_unicos
FROM grouped CROSS JOIN totals t""",
    "q20_busy_hours_raw": _busy("TRUE"),
    "q21_busy_hours_view": _busy("tx_id IS NOT NULL AND tx_id <> ''"),
    "e19_dates_to_iso": _busy("TRUE", "strftime(sold_at, '%Y-%m-%d')"),
}
ORACLE["q07_peak_hours_bitmaps"] = ORACLE["q07_peak_hours_view"]
