"""The catalogue read: optional filters, then an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from harrow.operators.filters import drop_blank, facet_filter, search_literal, search_pattern
from harrow.operators.sorting import sort_catalog

SEARCHED = ("program_name", "description", "key_objectives", "focus")


def catalog_query(
    df: DataFrame,
    country: str | None = None,
    search: str | None = None,
    columns: Sequence[str] = SEARCHED,
    facet: str = "country",
    wildcards: bool = False,
    order_by: str | Sequence[str] = "country",
) -> DataFrame:
    """Rows of one facet value (or all) whose searched columns hold the text, in order.

    wildcards=True reads % and _ in the text as in LIKE. order_by is a sort
    mode of the catalogue, or the columns of a total order.
    """
    find = search_pattern if wildcards else search_literal
    out = find(facet_filter(df, facet, country), search, columns)
    return sort_catalog(out, order_by) if isinstance(order_by, str) else out.orderBy(*order_by)


def browse(df: DataFrame, country: str | None, search: str | None, order_by: str, locale=True):
    """The reader's view: nameless programs are left out, the order is locale-aware."""
    named = drop_blank(df, "program_name", trimmed=False)
    found = search_literal(facet_filter(named, "country", country), search, SEARCHED)
    return sort_catalog(found, order_by, locale=locale, mode="text")
