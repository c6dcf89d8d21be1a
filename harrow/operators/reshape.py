"""Unions, attribute sweep and pivot, list reshaping, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import filled, split_list


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Sheets or territories in one table; columns a sheet lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sweep_attributes(df: DataFrame, key: str, core: Sequence[str]) -> DataFrame:
    """Every filled value outside the core columns as (program_id, attr_key, attr_value)."""
    rest = [c for c in df.columns if c not in core and c != key]
    long = df.select(
        F.col(key).cast("string").alias("program_id"),
        *[F.col(f"`{c}`").cast("string").alias(c) for c in rest],
    ).unpivot(["program_id"], rest, "attr_key", "attr_value")
    return long.filter(filled("attr_value"))


def pivot_attributes(attributes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per program with one column per listed key; the smallest value of repeats."""
    picks = [
        F.min(F.when(F.col("attr_key") == k, F.col("attr_value"))).alias(k) for k in keys
    ]
    return attributes.groupBy("program_id").agg(*picks)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key tuple, the first in the given total order."""
    names = df.columns
    first = [F.col(o) if isinstance(o, str) else o for o in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*first)).alias("_r"))
    return best.select("_r.*")


def reconcile(active: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key sets compared both ways: side is 'both', 'active_only' or 'allowed_only'."""
    a = active.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = allowed.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b"))
    sides = a.unionByName(b).groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    side = (
        F.when((F.col("a") == 1) & (F.col("b") == 1), "both")
        .when(F.col("a") == 1, "active_only")
        .otherwise("allowed_only")
    )
    return sides.select(*keys, side.alias("side"))


def number_items(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """List entries as numbered rows, from 1."""
    return df.select(*keep, F.posexplode(column).alias("pos", "item")).select(
        *keep, (F.col("pos") + 1).alias("number"), "item"
    )


def split_lists(df: DataFrame, columns: Sequence[str], separator: str = ";") -> DataFrame:
    """Delimiter-packed texts as arrays of trimmed, non-blank parts."""
    return df.withColumns({c: split_list(c, separator) for c in columns})
