"""Tiny hand-made frames."""

from decimal import Decimal

from tillstone.operators.cleanse import cleanse_lines, cleanse_tx

LINE_COLUMNS = ["line_id", "tx_id", "account", "branch_norm", "description", "tax_type", "quantity", "gross", "net", "sold_at"]
TX_COLUMNS = ["tx_id", "status", "run_as", "fee", "total", "account_email", "card_last4", "created_at"]


def lines(spark, *rows):
    """Rows of (tx_id, account, description, gross) plus optional keyword overrides."""
    full = []
    for i, row in enumerate(rows):
        base = {
            "line_id": i + 1, "branch_norm": None, "tax_type": "A", "quantity": "1",
            "sold_at": "05-03-2024, 10:30", **row,
        }
        base.setdefault("net", base["gross"])
        full.append(tuple(base.get(c) for c in LINE_COLUMNS))
    schema = ", ".join(f"{c} {'bigint' if c == 'line_id' else 'string'}" for c in LINE_COLUMNS)
    return cleanse_lines(spark.createDataFrame(full, schema))


def tx(spark, *rows):
    full = [
        tuple({"status": "successful", "created_at": "2024-03-05 10:30:00", **row}.get(c) for c in TX_COLUMNS)
        for row in rows
    ]
    return cleanse_tx(spark.createDataFrame(full, ", ".join(f"{c} string" for c in TX_COLUMNS)))


def line(tx_id, account="north", description="tea", gross="10", **more):
    return {"tx_id": tx_id, "account": account, "description": description, "gross": gross, **more}


def pay(tx_id, **more):
    return {"tx_id": tx_id, **more}


def rows(df, *columns):
    """Rows as tuples in result order, decimals as floats."""
    picked = df.select(*columns) if columns else df
    return [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in picked.collect()]
