"""Amounts of money held in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.text import _col

# What counts as an amount in running text.
AMOUNT = r"(\$?\s*[0-9][0-9,\.]{2,})"
DOLLAR_AMOUNT = r"\$\s?([0-9][0-9,\.]+)"

# Locales that write 1.234,56; all others are read as 1,234.56.
COMMA_DECIMAL = ("pt-BR", "es-CL", "fr-CA")


def _decimal(text: Column) -> Column:
    return F.regexp_replace(text, r"[\$,\s]", "").try_cast("decimal(18,2)")


def extract_amount(c: Column | str, which: str = "marked", pattern: str = AMOUNT) -> Column:
    """An amount in a text, NULL when there is none.

    which: "marked" takes the largest amount with a currency mark, and without any
    mark the first amount, so that a year beside an amount is not taken for one;
    "first" and "max" go by place and by size alone. Commas are group separators and
    a point is the decimal mark.
    """
    if which == "first":
        return _decimal(F.regexp_extract(_col(c), pattern, 1))
    found = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(1))
    if which == "max":
        return F.array_max(F.transform(found, _decimal))
    if which == "marked":
        marked = F.transform(F.filter(found, lambda x: F.contains(x, F.lit("$"))), _decimal)
        return F.coalesce(F.array_max(marked), _decimal(F.regexp_extract(_col(c), pattern, 1)))
    raise ValueError(f"which must be 'marked', 'first' or 'max', not {which!r}")


def normalize_money(c: Column | str, locale: str = "en-US", places: int = 2) -> Column:
    """A single amount as written in the locale, rounded half up."""
    digits = F.regexp_replace(_col(c), r"[^0-9,.\-]", "")
    if locale in COMMA_DECIMAL:
        digits = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    else:
        digits = F.replace(digits, F.lit(","), F.lit(""))
    return F.round(digits.try_cast("decimal(18,4)"), places).cast(f"decimal(18,{places})")
