"""Business vocabulary: every word, label and branch rule the queries depend on.

Queries never hard-code a status, an exclusion word or a branch name. They take a
``Vocabulary``. The defaults are the Spanish words of the point-of-sale exports; a
shop adds its own branches (and overrides words) with ``dataclasses.replace`` or
``Vocabulary(...)``.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass


@dataclass(frozen=True)
class Branch:
    """One branch and the ways raw data spells it.

    aliases       exact account texts (dashboard queries on raw accounts)
    account_like  case-insensitive LIKE patterns on the account text
    broad_like    patterns on the normalised branch text or e-mail, any may match
    narrow_like   stricter patterns used by the peak-hour and loyalty views
    """

    label: str
    aliases: tuple[str, ...] = ()
    account_like: tuple[str, ...] = ()
    broad_like: tuple[str, ...] = ()
    narrow_like: tuple[str, ...] = ()

    @property
    def slug(self) -> str:
        """Column-name form of the label: lower case ASCII, underscores."""
        ascii_text = unicodedata.normalize("NFKD", self.label).encode("ascii", "ignore").decode()
        return re.sub(r"[^a-z0-9]+", "_", ascii_text.lower()).strip("_")


@dataclass(frozen=True)
class Vocabulary:
    branches: tuple[Branch, ...] = ()

    # Words found in the exports.
    success: str = "Exitosa"
    paid: str = "Pagado"
    tip: str = "tip"
    tip_words: tuple[str, ...] = ("tip", "propina")
    manual_amount: str = "importe personalizado"
    unspecified: str = "no_especificado"
    debit_words: tuple[str, ...] = ("DEBIT", "DEBITO")
    credit_words: tuple[str, ...] = ("CREDIT", "CREDITO")

    # Labels that appear in results.
    branch_prefix: str = "Sede "
    overview_total: str = ">> TOTAL CONSOLIDADO <<"
    general_total: str = "TOTAL GENERAL"
    unknown_branch: str = "Sede No Identificada"
    unidentified: str = "No Identificada"
    unknown_sales_branch: str = "Desconocido"
    unnamed_product: str = "Producto Sin Nombre"
    debit: str = "Débito"
    credit: str = "Crédito"
    cash: str = "Efectivo"
    missing: str = "NO_ESPECIFICADO"
    # Sunday first.
    weekdays: tuple[str, ...] = (
        "Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado",
    )

    # Constants and keyword categories of the dimensions, first match wins.
    region: str = "CHILE"
    city: str = "SANTIAGO"
    device_brand: str = "SUMUP"
    device_model: str = "POS"
    product_categories: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("CAFÉ", ("café", "coffee")),
        ("PASTELES", ("tarta", "pastel")),
        ("SANDWICH", ("sandwich", "sándwich")),
    )
    other_product: str = "OTROS"
    payment_categories: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("TARJETA", ("tarjeta", "crédito", "débito")),
        ("EFECTIVO", ("efectivo",)),
        ("TRANSFERENCIA", ("transferencia",)),
    )
    other_payment: str = "OTRO"

    @property
    def counter_branches(self) -> tuple[Branch, ...]:
        """Branches known by exact account aliases (the raw-account dashboards)."""
        return tuple(b for b in self.branches if b.aliases)
