"""Counts, profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import filled


def stats_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most first; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def count_where(df: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = df if condition is None else df.filter(condition)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def fill_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Total rows and filled rows per column, in one pass."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(filled(c)).alias(f"with_{c}") for c in columns],
    )


def import_summary(df: DataFrame, column: str = "source_sheet") -> DataFrame:
    """Rows per sheet and a grand total, which carries the name '(total)'."""
    return (
        df.rollup(column)
        .agg(F.count(F.lit(1)).alias("imported"), F.grouping(column).alias("is_total"))
        .withColumn(column, F.when(F.col("is_total") == 1, "(total)").otherwise(F.col(column)))
        .select(column, "imported")
    )


def link_summary(linked: DataFrame) -> DataFrame:
    return linked.groupBy("match_kind").agg(F.count(F.lit(1)).alias("documents"))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def as_map(df: DataFrame, key: str, value: str, parts: int = 1) -> DataFrame:
    """A result such as counts per territory as maps; keys are unique.

    Gives one row, or as many as the caller asks for by parts: keys are dealt to
    them by hash. An empty result gives one empty map.
    """
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("as_map")
    if parts == 1:
        return df.select(key, value).agg(entries)
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")).agg(entries).select("as_map")


def shown_of_total(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(
        F.count_if(F.coalesce(condition, F.lit(False))).alias("shown"),
        F.count(F.lit(1)).alias("total"),
    )


def sheet_profile(df: DataFrame, sheet: str = "source_sheet") -> DataFrame:
    """Per sheet: row count and the names of the columns holding any value."""
    columns = [c for c in df.columns if c != sheet]
    held = [F.when(F.max(filled(F.col(f"`{c}`"))), F.lit(c)) for c in columns]
    return df.groupBy(sheet).agg(
        F.count(F.lit(1)).alias("rows"), F.array_compact(F.array(*held)).alias("columns")
    )


def crawl_metrics(log: DataFrame) -> DataFrame:
    """Fetch log totals: overall, by status and by domain in one pass.

    Input: domain, status, failed (boolean), latency_ms (integer). Latency sums
    are kept as integers, so the mean does not depend on the row order.
    """
    measures = [
        F.count(F.lit(1)).alias("calls"),
        F.count_if("failed").alias("errors"),
        F.sum(F.col("latency_ms").cast("bigint")).alias("latency_total"),
        F.count("latency_ms").alias("latency_n"),
    ]
    grouped = log.groupingSets(
        [[], [F.col("status")], [F.col("domain")]], "status", "domain"
    ).agg(
        F.grouping("status").alias("gs"), F.grouping("domain").alias("gd"), *measures
    )
    scope = (
        F.when(F.col("gs") + F.col("gd") == 2, "all")
        .when(F.col("gs") == 0, "status")
        .otherwise("domain")
    )
    return grouped.select(
        scope.alias("scope"),
        F.when(F.col("gs") == 0, F.col("status"))
        .when(F.col("gd") == 0, F.col("domain"))
        .alias("value"),
        "calls",
        "errors",
        F.when(F.col("latency_n") > 0, F.round(F.col("latency_total") / F.col("latency_n"), 3))
        .alias("mean_latency_ms"),
    )
