"""Row filters and search predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.text import contains_any, filled, has_text, split_list


def _any(conditions: Sequence[Column]) -> Column:
    return F.coalesce(
        reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions]), F.lit(False)
    )


def facet_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Equality; no value or 'all' means no filter."""
    return df if value in (None, "", "all") else df.filter(F.col(column) == value)


def matches_pattern(query: str, columns: Sequence[str]) -> Column:
    """Case-insensitive LIKE '%query%' on any column: % and _ in the query are wildcards."""
    pattern = "%" + query.replace("\\", "\\\\") + "%"
    return _any([F.col(c).ilike(pattern) for c in columns])


def matches_literal(query: str, columns: Sequence[str]) -> Column:
    """Case-insensitive containment of the query as it stands, in any column."""
    folded = F.lower(F.lit(query))
    return _any([F.contains(F.lower(F.col(c)), folded) for c in columns])


def search_pattern(df: DataFrame, query: str | None, columns: Sequence[str]) -> DataFrame:
    return df.filter(matches_pattern(query, columns)) if query else df


def search_literal(df: DataFrame, query: str | None, columns: Sequence[str]) -> DataFrame:
    return df.filter(matches_literal(query, columns)) if query else df


def drop_blank(df: DataFrame, column: str, trimmed: bool = True) -> DataFrame:
    """Rows whose value is filled, after trimming unless trimmed=False."""
    return df.filter(has_text(column) if trimmed else filled(column))


def filter_any_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(_any([filled(c) for c in columns]))


def get_by_id(df: DataFrame, column: str, value) -> DataFrame:
    """The row with this key, or no row."""
    return df.filter(F.col(column) == value).limit(1)


def children_of(df: DataFrame, parent, order: Sequence[str], column: str = "program_id"):
    """The children of one parent, ordered."""
    return df.filter(F.col(column) == parent).orderBy(*order)


def include_any(df: DataFrame, columns: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Rows where any column contains any of the terms, ignoring case."""
    return df.filter(_any([contains_any(c, list(terms)) for c in columns]))


def filter_in(df: DataFrame, column: str, spec: str | None) -> DataFrame:
    """'a|b|c' keeps rows holding one of the values; works on array columns too."""
    if not spec:
        return df
    values = [v.strip() for v in spec.split("|") if v.strip()]
    if isinstance(df.schema[column].dataType, T.ArrayType):
        wanted = F.array(*[F.lit(v) for v in values])
        return df.filter(F.coalesce(F.arrays_overlap(F.col(column), wanted), F.lit(False)))
    return df.filter(F.col(column).isin(*values))


def where_all(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Every rule must hold; a rule is {'field': name, 'eq'|'gt'|'ge'|'lt'|'le': value}."""
    ops = {
        "eq": lambda c, v: c == v,
        "gt": lambda c, v: c > v,
        "ge": lambda c, v: c >= v,
        "lt": lambda c, v: c < v,
        "le": lambda c, v: c <= v,
    }
    out = df
    for rule in rules:
        for name, value in rule.items():
            if name != "field":
                out = out.filter(ops[name](F.col(rule["field"]), value))
    return out


def open_funded(df: DataFrame, status: str = "status", amount: str = "funding_amount") -> DataFrame:
    """Open status text and a positive amount."""
    is_open = F.col(status).rlike(r"(?i)open|opportunit(y|ies) open")
    return df.filter(is_open & (F.coalesce(F.col(amount), F.lit(0)) > 0))


def over_threshold(
    df: DataFrame,
    value: str | None = None,
    minimum=None,
    day: str | None = None,
    as_of: str | None = None,
    within_days: int | None = None,
) -> DataFrame:
    """Value at or above a minimum and/or a day at most within_days away (and not past).

    The days are two bounds on the column itself, which the scan can use.
    """
    out = df
    if value is not None and minimum is not None:
        out = out.filter(F.col(value) >= minimum)
    if day is not None and within_days is not None:
        kind = df.schema[day].dataType
        first = F.lit(as_of).cast("date")
        end = F.date_add(first, within_days + 1)
        out = out.filter((F.col(day) >= first.cast(kind)) & (F.col(day) < end.cast(kind)))
    return out


def facet_in_list(df: DataFrame, column: str, value: str, separator: str = ";") -> DataFrame:
    """Rows whose delimiter-packed list holds the value."""
    return df.filter(F.array_contains(split_list(column, separator), value))


def is_scorable() -> Column:
    return filled("operation") & filled("scale") & filled("location") & filled("practice")


def is_complete() -> Column:
    return is_scorable() & filled("land_control") & filled("compliance_id")
