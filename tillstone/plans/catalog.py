"""Views under schemas, in the session catalog, so that every session on it finds them.

A view's rows are stored as a table of the ``tienda`` schema and the view selects from it: readers
get a stored result, and a view can be moved to another schema without its data. Temporary
views of the session, such as a user's own ``tx``, are left alone. How long the catalog lives is up to it:
with a metastore behind it the views outlive the application.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from tillstone.plans.semantic import RENAMED_VIEWS, VIEWS, Shop
from tillstone.session import scratch

STORE, OLD_SCHEMA, SCHEMA = "tienda", "bi", "semantic"


def quoted(*parts: str) -> str:
    """A qualified name, safe to place in a statement."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _exists(spark: SparkSession, schema: str, name: str) -> bool:
    return spark.catalog.databaseExists(schema) and spark.catalog.tableExists(quoted(schema, name))


def store_table(spark: SparkSession, name: str, rows: DataFrame, folder: str | None = None) -> None:
    """``rows`` as the table ``tienda.name`` in a new folder; a reader of the table before keeps its files."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(STORE)}")
    path = f"{folder or scratch(spark, 'catalog')}/{name}"
    rows.write.parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS {quoted(STORE, name)}")  # its files stay: the table does not own them
    spark.catalog.createTable(quoted(STORE, name), path, "parquet", rows.schema)


def create_view(spark: SparkSession, schema: str, name: str, text: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(schema)}")
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(schema, name)} AS {text}")


def publish(spark: SparkSession, shop: Shop, old_names: bool = False, only: Collection[str] | None = None) -> list[str]:
    """Stores the views (or ``only`` those named) and publishes them; gives their qualified names.

    They go to ``semantic``, or with ``old_names`` the six that were moved go to ``bi`` under their earlier
    names. Repeating it replaces them.
    """
    names = {new: old for old, new in RENAMED_VIEWS.items()}
    done = []
    for name in VIEWS if only is None else only:
        schema, own = (OLD_SCHEMA, names[name]) if old_names and name in names else (SCHEMA, name)
        store_table(spark, name, VIEWS[name](shop))
        create_view(spark, schema, own, f"SELECT * FROM {quoted(STORE, name)}")
        done.append(f"{schema}.{own}")
    return done


def view_text(spark: SparkSession, schema: str, name: str) -> str:
    """The statement a view was created with."""
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(schema, name)}").collect()}
    return facts["View Text"]


def migrate(spark: SparkSession) -> list[str]:
    """Moves every earlier view that exists from ``bi`` to its name in ``semantic``.

    The new view is there before the old one goes, so readers find one of them at any time; a move that
    was broken off is finished by the next.
    """
    moved = []
    for old, new in RENAMED_VIEWS.items():
        if _exists(spark, OLD_SCHEMA, old):
            create_view(spark, SCHEMA, new, view_text(spark, OLD_SCHEMA, old))
            spark.sql(f"DROP VIEW {quoted(OLD_SCHEMA, old)}")
            moved.append(f"{SCHEMA}.{new}")
    return moved


def drop_view(spark: SparkSession, name: str, schema: str = SCHEMA) -> bool:
    """Drops a view if it exists; tells whether it did. The stored rows stay."""
    there = _exists(spark, schema, name)
    if there:
        spark.sql(f"DROP VIEW {quoted(schema, name)}")
    return there


def describe(spark: SparkSession) -> DataFrame:
    """(tabla, columna, tipo) of every published view, by its qualified name."""
    schemas = [s for s in (OLD_SCHEMA, SCHEMA) if spark.catalog.databaseExists(s)]
    rows = [
        (f"{schema}.{view.name}", column.name, column.dataType)
        for schema in schemas for view in spark.catalog.listTables(schema) if not view.isTemporary
        for column in spark.catalog.listColumns(quoted(schema, view.name))
    ]
    return spark.createDataFrame(rows, "tabla string, columna string, tipo string")
