"""Catalogue order and page slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.dates import parse_date
from harrow.operators.columns import deadline_column
from harrow.operators.windows import sliced

# Pages that end within this many rows are taken from the front of the order.
FRONT = 10_000


def _by(c: Column, locale: bool) -> Column:
    return F.collate(c, "UNICODE") if locale else c


def sort_catalog(
    df: DataFrame, by: str = "country", locale: bool = False, key: str = "id", mode: str = "date"
) -> DataFrame:
    """country, name or deadline order; any other word promises no order.

    locale=True orders text as readers expect instead of by code point.
    Deadline order puts rows without one last; mode="text" compares the text
    as written, the default compares the dates read from it.
    """
    country, name = _by(F.col("country"), locale), _by(F.col("program_name"), locale)
    if by == "country":
        return df.orderBy(country, name, key)
    if by == "name":
        return df.orderBy(name, key)
    if by == "deadline":
        text = deadline_column()
        if mode == "text":
            return df.orderBy(_by(text, locale).asc_nulls_last(), key)
        return df.orderBy(
            text.isNull(), parse_date(text).asc_nulls_last(), text.asc_nulls_last(), key
        )
    return df


def page(
    df: DataFrame,
    order: Sequence[str],
    start: int,
    rows: int,
    slices: int | None = None,
    front: int = FRONT,
) -> DataFrame:
    """A page by position. The order must be total.

    A page that ends within `front` rows is the top of each task's rows. A deeper
    one is found by the sizes of the slices of a range partitioning: only the slices that hold
    it are sorted, each in its own task.
    """
    if start + rows <= front:
        return df.orderBy(*order).offset(start).limit(rows)
    table = sliced(df, order[0], order[1:], slices)
    sizes = table.groupBy("_s").count().orderBy("_s").collect()  # a row per slice
    before, base = 0, {}
    for r in sizes:
        if before < start + rows and before + r["count"] > start:
            base[r["_s"]] = before
        before += r["count"]
    held = table.filter(F.col("_s").isin(list(base)))
    first = F.lit(0).cast("bigint")
    for s, n in base.items():
        first = F.when(F.col("_s") == s, F.lit(n).cast("bigint")).otherwise(first)
    place = first + F.row_number().over(Window.partitionBy("_s").orderBy(*order)) - 1
    wanted = held.withColumn("_at", place).filter((F.col("_at") >= start) & (F.col("_at") < start + rows))
    return wanted.drop("_s", "_at").orderBy(*order)


def page_after(df: DataFrame, key: str, last, rows: int) -> DataFrame:
    """The next page by key: deep pages cost no more than the first."""
    ahead = df if last is None else df.filter(F.col(key) > last)
    return ahead.orderBy(key).limit(rows)
