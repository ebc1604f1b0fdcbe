"""The star schema: dimensions, facts and the job that builds and refreshes them.

Dimension builders return the incoming rows; ``operators.load.insert_ignore`` merges them
into a stored dimension, so every load is idempotent. Order of a load: dimensions, facts,
views.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.functions import branch as branches
from tillstone.functions import dates
from tillstone.functions.money import or_zero
from tillstone.functions.text import keyword_category
from tillstone.operators import load, lookup
from tillstone.operators.cleanse import cleanse_lines, cleanse_tx, present
from tillstone.operators.numbering import number_lines
from tillstone.operators.profile import duplicate_keys
from tillstone.vocab import Vocabulary

NATURAL_KEYS = {
    "dim_date": ("fecha_key",),
    "dim_product": ("descripcion", "tipo_iva"),
    "dim_branch": ("nombre_sede",),
    "dim_payment": ("forma_pago",),
    "dim_card": ("tipo_tarjeta", "ultimos_4_digitos"),
    "dim_device": ("numero_serie",),
}


@dataclass(frozen=True)
class Star:
    dim_date: DataFrame
    dim_product: DataFrame
    dim_branch: DataFrame
    dim_payment: DataFrame
    dim_card: DataFrame
    dim_device: DataFrame
    fact_lines: DataFrame
    fact_tx: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# --- dimensions --------------------------------------------------------------------------


def dim_date(lines: DataFrame, tx: DataFrame) -> DataFrame:
    """Every date on which either table has a row."""
    sold = lines.select(F.to_date("sold_at").alias("fecha_completa")).distinct()
    paid = tx.select(F.to_date("created_at").alias("fecha_completa")).distinct()
    day = F.col("fecha_completa")
    return (
        sold.union(paid)
        .distinct()
        .filter(day.isNotNull())
        .select(
            dates.date_key(day).alias("fecha_key"),
            "fecha_completa",
            F.year(day).alias("anio"),
            F.quarter(day).alias("trimestre"),
            F.month(day).alias("mes"),
            dates.padded_name(day, "MMMM").alias("nombre_mes"),
            F.dayofmonth(day).alias("dia_mes"),
            dates.day_of_week(day).alias("dia_semana"),
            dates.padded_name(day, "EEEE").alias("nombre_dia_semana"),
            dates.is_weekend(day).alias("es_fin_semana"),
        )
    )


def dim_product(lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct (description, tax type) with a keyword category."""
    pairs = present(lines, "description").select(
        F.col("description").alias("descripcion"), F.col("tax_type").alias("tipo_iva")
    ).distinct()
    name = F.col("descripcion")
    return pairs.select(
        load.surrogate_key(name, F.col("tipo_iva")).alias("producto_sk"),
        "descripcion",
        "tipo_iva",
        keyword_category(name, vocab.product_categories, vocab.other_product).alias("categoria"),
    )


def _specified(lines: DataFrame, column: str, vocab: Vocabulary) -> DataFrame:
    return present(lines, column).filter(F.col(column) != vocab.unspecified).select(column).distinct()


def dim_branch(lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct branches; the sentinel for an unspecified branch is left out."""
    name = F.col("branch_norm")
    return _specified(lines, "branch_norm", vocab).select(
        load.surrogate_key(name).alias("sede_sk"),
        name.alias("nombre_sede"),
        F.lit(vocab.region).alias("region"),
        F.lit(vocab.city).alias("ciudad"),
    )


def dim_payment(lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct payment forms with a keyword category."""
    form = F.col("pay_form")
    return _specified(lines, "pay_form", vocab).select(
        load.surrogate_key(form).alias("pago_sk"),
        form.alias("forma_pago"),
        keyword_category(form, vocab.payment_categories, vocab.other_payment).alias("categoria_pago"),
        form.alias("descripcion"),
    )


def dim_card(tx: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct cards. A card seen under several capture modes keeps the smallest."""
    missing = F.lit(vocab.missing)
    card_type = F.coalesce("card_type", missing)
    cards = tx.filter(F.col("card_type").isNotNull() | F.col("card_last4").isNotNull()).select(
        card_type.alias("tipo_tarjeta"),
        F.left(F.trim(F.coalesce("card_last4", F.lit(""))), F.lit(4)).alias("ultimos_4_digitos"),
        card_type.alias("marca_tarjeta"),
        F.coalesce("capture_mode", missing).alias("modo_captura"),
    ).distinct()
    unique = load.first_per_key(cards, NATURAL_KEYS["dim_card"])
    key = load.surrogate_key(*[F.col(c) for c in NATURAL_KEYS["dim_card"]])
    return unique.select(key.alias("tarjeta_sk"), *cards.columns)


def any_branch(branch_dim: DataFrame) -> DataFrame:
    """One row: the smallest branch key, for tables that only need some branch."""
    return branch_dim.agg(F.min("sede_sk").alias("sede_sk"))


def dim_device(
    lines: DataFrame, branch_dim: DataFrame, vocab: Vocabulary, installed: Column | None = None
) -> DataFrame:
    """Distinct device serials, installed today unless ``installed`` says otherwise."""
    serial = F.col("device_serial")
    devices = _specified(lines, "device_serial", vocab).select(
        load.surrogate_key(serial).alias("dispositivo_sk"),
        serial.alias("numero_serie"),
        F.lit(vocab.device_brand).alias("marca"),
        F.lit(vocab.device_model).alias("modelo"),
        (F.current_date() if installed is None else installed).alias("fecha_instalacion"),
    )
    return lookup.with_single_row(devices, any_branch(branch_dim))


# --- facts -------------------------------------------------------------------------------

_FACT_LINES = (
    "id_transaccion", "linea_ticket", "fecha_key", "producto_sk", "sede_sk", "pago_sk",
    "cantidad", "precio_unitario", "precio_bruto", "precio_neto", "iva_monto",
)


def keyed_lines(
    lines: DataFrame,
    date_dim: DataFrame,
    product_dim: DataFrame,
    branch_dim: DataFrame,
    payment_dim: DataFrame,
    vocab: Vocabulary,
) -> DataFrame:
    """Lines with their measures, dimension keys and what the keys were looked up by
    (``busca_...``); an unmatched lookup leaves a NULL key.

    Two lookups miss on purpose, as in the source: a line without a tax type looks for the
    missing-value word while the dimension stores NULL, and a branch is looked up under
    its short label while the dimension stores the raw text.
    """
    kept = present(lines, "tx_id", "sold_at").withColumns({
        "cantidad": or_zero(F.col("quantity").cast("decimal(10,2)"), "decimal(10,2)"),
        **{
            target: or_zero(F.col(source).cast("decimal(12,2)"), "decimal(12,2)")
            for target, source in (
                ("precio_unitario", "unit_price"), ("precio_bruto", "gross"),
                ("precio_neto", "net"), ("iva_monto", "vat"),
            )
        },
        "busca_descripcion": F.col("description"),
        "busca_tipo_iva": F.coalesce("tax_type", F.lit(vocab.missing)),
        "busca_sede": branches.dimension_name(F.col("branch_norm"), vocab),
        "busca_pago": F.col("pay_form"),
    })
    # Lookups first: the shuffle of the line numbering then carries keys, not texts.
    keyed = lookup.first_match(kept, date_dim, {"fecha_completa": F.to_date("sold_at")}, "fecha_key")
    return looked_up(keyed, product_dim, branch_dim, payment_dim)


def looked_up(lines: DataFrame, product_dim: DataFrame, branch_dim: DataFrame, payment_dim: DataFrame) -> DataFrame:
    """Adds the product, branch and payment keys by the ``busca_...`` columns."""
    keyed = lookup.first_match(
        lines, product_dim,
        {"descripcion": F.col("busca_descripcion"), "tipo_iva": F.col("busca_tipo_iva")}, "producto_sk",
    )
    keyed = lookup.first_match(keyed, branch_dim, {"nombre_sede": F.col("busca_sede")}, "sede_sk")
    return lookup.first_match(keyed, payment_dim, {"forma_pago": F.col("busca_pago")}, "pago_sk")


def fact_lines(
    lines: DataFrame,
    date_dim: DataFrame,
    product_dim: DataFrame,
    branch_dim: DataFrame,
    payment_dim: DataFrame,
    vocab: Vocabulary,
) -> DataFrame:
    """Line fact with first-match lookups; an unmatched lookup leaves a NULL key. A row that
    the export holds twice, line id included, counts once."""
    keyed = keyed_lines(lines, date_dim, product_dim, branch_dim, payment_dim, vocab)
    sizes = present(lines, "tx_id", "sold_at").select("tx_id", "line_id")
    return _numbered(keyed, sizes, distinct=True)


def _numbered(keyed: DataFrame, sizes: DataFrame, distinct: bool = False) -> DataFrame:
    """The line fact of keyed lines; the ticket travels once."""
    narrow = keyed.select("tx_id", "line_id", *[c for c in _FACT_LINES if c not in ("id_transaccion", "linea_ticket")])
    return number_lines(narrow, sizes=sizes, distinct=distinct).withColumnRenamed("tx_id", "id_transaccion").select(*_FACT_LINES)


def fact_lines_strict(
    raw_lines: DataFrame,
    product_dim: DataFrame,
    branch_dim: DataFrame,
    payment_dim: DataFrame,
    strict: bool = True,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Line fact from raw text with plain lookups that must match at most one row.

    With ``strict``, blank or unreadable amounts fail the job; otherwise they count as
    zero. Lookups compare raw values, so a missing tax type never matches. ``sizes`` are the same lines as a
    table that is cheaper to count tickets in than ``raw_lines``, such as the clean one.
    """
    def amount(name: str) -> Column:
        text = F.coalesce(name, F.lit("0"))
        return text.cast("decimal(18,4)") if strict else or_zero(text.try_cast("decimal(18,4)"))

    quantity = F.col("quantity")
    measured = raw_lines.filter(F.col("tx_id").isNotNull()).withColumns({
        "fecha_key": dates.date_key(F.to_date(dates.parse_sold_at(F.col("sold_at")))),
        "cantidad": quantity.cast("decimal(18,4)") if strict else quantity.try_cast("decimal(18,4)"),
        "precio_unitario": amount("unit_price"),
        "precio_bruto": amount("gross"),
        "precio_neto": amount("net"),
        "iva_monto": amount("vat"),
    })
    keyed = lookup.only_match(
        measured, product_dim,
        {"descripcion": F.col("description"), "tipo_iva": F.col("tax_type")}, "producto_sk",
    )
    keyed = lookup.only_match(keyed, branch_dim, {"nombre_sede": F.col("branch_norm")}, "sede_sk")
    keyed = lookup.only_match(keyed, payment_dim, {"forma_pago": F.col("pay_form")}, "pago_sk")
    counted = raw_lines if sizes is None else sizes
    return _numbered(keyed, counted.filter(F.col("tx_id").isNotNull()).select("tx_id", "line_id"))


_FACT_TX = (
    "id_transaccion", "fecha_key", "sede_sk", "tarjeta_sk", "correo_electronico",
    "codigo_autorizacion", "tipo_transaccion", "estado", "metodo_pago", "modo_captura",
    "fecha_transaccion", "monto_total", "subtotal", "impuesto", "propina", "comision",
    "depositos", "referencia",
)


def payment_rows(tx: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Payments under the fact's names, with the card they are looked up by (``busca_...``), several rows to an id."""
    return present(tx, "tx_id", "created_at").select(
        F.col("tx_id").alias("id_transaccion"),
        F.col("created_at").cast("timestamp").alias("fecha_transaccion"),
        F.col("account_email").alias("correo_electronico"),
        F.col("auth_code").alias("codigo_autorizacion"),
        F.col("tx_type").alias("tipo_transaccion"),
        F.col("status").alias("estado"),
        F.col("pay_method").alias("metodo_pago"),
        F.col("capture_mode").alias("modo_captura"),
        *[
            or_zero(F.col(source).cast("decimal(12,2)"), "decimal(12,2)").alias(target)
            for target, source in (
                ("monto_total", "total"), ("subtotal", "subtotal"), ("impuesto", "tax"),
                ("propina", "tip"), ("comision", "fee"), ("depositos", "deposits"),
            )
        ],
        F.col("reference").alias("referencia"),
        F.to_date("created_at").alias("busca_dia"),
        F.coalesce("card_type", F.lit(vocab.missing)).alias("busca_tipo_tarjeta"),
        F.coalesce("card_last4", F.lit("")).alias("busca_digitos"),
    )


def keyed_payments(payments: DataFrame, date_dim: DataFrame, card_dim: DataFrame) -> DataFrame:
    """Adds the date and card keys by the ``busca_...`` columns."""
    keyed = lookup.first_match(payments, date_dim, {"fecha_completa": F.col("busca_dia")}, "fecha_key")
    return lookup.first_match(
        keyed, card_dim,
        {"tipo_tarjeta": F.col("busca_tipo_tarjeta"), "ultimos_4_digitos": F.col("busca_digitos")}, "tarjeta_sk",
    )


def fact_tx(
    tx: DataFrame, date_dim: DataFrame, branch_dim: DataFrame, card_dim: DataFrame, vocab: Vocabulary
) -> DataFrame:
    """One row per payment id: the earliest row, then the smallest by the other columns."""
    unique = load.first_per_key(payment_rows(tx, vocab), ["id_transaccion"])
    keyed = keyed_payments(unique, date_dim, card_dim)
    return lookup.with_single_row(keyed, any_branch(branch_dim)).select(*_FACT_TX)


# --- jobs --------------------------------------------------------------------------------


def star_of(lines: DataFrame, tx: DataFrame, vocab: Vocabulary) -> Star:
    """The whole star as one lazy plan, nothing written."""
    branch_dim = dim_branch(lines, vocab)
    date_dim, product_dim = dim_date(lines, tx), dim_product(lines, vocab)
    payment_dim, card_dim = dim_payment(lines, vocab), dim_card(tx, vocab)
    return Star(
        dim_date=date_dim,
        dim_product=product_dim,
        dim_branch=branch_dim,
        dim_payment=payment_dim,
        dim_card=card_dim,
        dim_device=dim_device(lines, branch_dim, vocab),
        fact_lines=fact_lines(lines, date_dim, product_dim, branch_dim, payment_dim, vocab),
        fact_tx=fact_tx(tx, date_dim, branch_dim, card_dim, vocab),
    )


def read_star(spark: SparkSession, root: str) -> Star:
    return Star(**{f.name: spark.read.parquet(f"{root}/{f.name}") for f in fields(Star)})


def _stored(spark: SparkSession, df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    load.full_reload(df, path, by)
    return spark.read.parquet(path)


def store_clean(
    spark: SparkSession, raw_lines: DataFrame, raw_tx: DataFrame, out: str
) -> tuple[DataFrame, DataFrame]:
    """Clean both exports once and store them typed under ``out``; returns (lines, tx).
    Queries over the stored tables push their filters and columns into the scan."""
    return store_lines(spark, raw_lines, out), store_tx(spark, raw_tx, out)


def store_lines(spark: SparkSession, raw_lines: DataFrame, out: str) -> DataFrame:
    return _stored(spark, cleanse_lines(raw_lines), f"{out}/lines")


def store_tx(spark: SparkSession, raw_tx: DataFrame, out: str) -> DataFrame:
    return _stored(spark, cleanse_tx(raw_tx), f"{out}/tx")


def build_star(
    spark: SparkSession,
    lines: DataFrame,
    tx: DataFrame,
    out: str,
    vocab: Vocabulary,
    previous: str | None = None,
) -> Star:
    """Load and store the whole star under ``out`` from the clean tables.

    ``previous`` names an earlier build: its dimension rows are kept and only new ones
    added. ``out`` must be another folder. Facts are reloaded in full, line facts
    partitioned by month. Each table is read back before the next step uses it, so no
    step recomputes an earlier one.
    """
    dims = build_dimensions(spark, lines, tx, out, vocab, previous)
    return build_facts(spark, lines, tx, dims, out, vocab)


def build_dimensions(
    spark: SparkSession, lines: DataFrame, tx: DataFrame, out: str, vocab: Vocabulary, previous: str | None = None,
) -> dict[str, DataFrame]:
    """The first half of ``build_star``: the stored dimensions by name."""
    if previous is not None and previous.rstrip("/") == out.rstrip("/"):
        raise ValueError("write a new build to a folder of its own")

    def merged(name: str, incoming: DataFrame) -> DataFrame:
        if previous is not None:
            incoming = load.insert_ignore(
                spark.read.parquet(f"{previous}/{name}"), incoming, NATURAL_KEYS[name]
            )
        table = _stored(spark, incoming, f"{out}/{name}")
        key = table.columns[0]  # a surrogate key is a hash: two rows with one must not pass unseen
        if not duplicate_keys(table, key).isEmpty():
            raise ValueError(f"{name}.{key} is not unique")
        return table

    dims = {
        "dim_date": merged("dim_date", dim_date(lines, tx)),
        "dim_product": merged("dim_product", dim_product(lines, vocab)),
        "dim_branch": merged("dim_branch", dim_branch(lines, vocab)),
        "dim_payment": merged("dim_payment", dim_payment(lines, vocab)),
        "dim_card": merged("dim_card", dim_card(tx, vocab)),
    }
    dims["dim_device"] = merged("dim_device", dim_device(lines, dims["dim_branch"], vocab))
    return dims


def build_facts(
    spark: SparkSession, lines: DataFrame, tx: DataFrame, dims: dict[str, DataFrame], out: str, vocab: Vocabulary,
) -> Star:
    """The second half: both facts, keyed by stored dimensions."""
    line_facts = fact_lines(
        lines, dims["dim_date"], dims["dim_product"], dims["dim_branch"], dims["dim_payment"], vocab)
    month = F.floor(F.col("fecha_key") / 100).cast("int").alias("mes_key")
    # A rebalance brings a month's rows together, so that tasks do not each write a small
    # file per month; AQE splits a month too large for one task.
    by_month = line_facts.select("*", month).hint("rebalance", "mes_key")
    tx_facts = fact_tx(tx, dims["dim_date"], dims["dim_branch"], dims["dim_card"], vocab)
    return Star(
        **dims,
        fact_lines=_stored(spark, by_month, f"{out}/fact_lines", ("mes_key",)),
        fact_tx=_stored(spark, tx_facts, f"{out}/fact_tx"),
    )
