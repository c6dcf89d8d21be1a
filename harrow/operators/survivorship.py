"""One record per merged cluster: which value of each field survives.

The rule names come with no formal meaning; the meanings adopted here are in
RULES' docstrings below. All rules are order-free aggregates with a total
order, so results do not depend on partitioning, and a large cluster is
reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.text import strip_html
from harrow.functions.urls import path_depth

LAST_RANK = 1_000_000


def source_rank(source: str, precedence: Sequence[str]) -> Column:
    """Position in the precedence list; sources outside it come last."""
    pairs = F.create_map(*[x for i, s in enumerate(precedence) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(F.element_at(pairs, F.col(source)), F.lit(LAST_RANK))


class Order:
    """The columns that rank records of a cluster: source rank, publish time, record id."""

    def __init__(self, rank: str, time: str, record: str):
        self.rank, self.time, self.record = F.col(rank), F.col(time), F.col(record)
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        # Missing times sort last in both directions.
        self.newest = F.struct(micros.isNull().alias("n"), F.coalesce(-micros, F.lit(0)).alias("t"))
        self.oldest = F.struct(micros.isNull().alias("n"), F.coalesce(micros, F.lit(0)).alias("t"))


def _best(value: Column, usable: Column, *place: Column) -> Column:
    """The usable value whose place comes first."""
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(place)])
    return F.min_by(value, F.when(usable, order))


def latest_by_precedence(v: Column, ok: Column, o: Order) -> Column:
    """Best-ranked source having a value; the newest in it."""
    return _best(v, ok, o.rank, o.newest, o.record)


def earliest_by_precedence(v: Column, ok: Column, o: Order) -> Column:
    """Smallest value inside the best-ranked source having one."""
    return _best(v, ok, o.rank, v, o.record)


def max_by_precedence(v: Column, ok: Column, o: Order) -> Column:
    """Largest value inside the best-ranked source having one."""
    return _best(v, ok, o.rank, -v, o.record)


def first_by_precedence(v: Column, ok: Column, o: Order) -> Column:
    """First filled value by source order, then by record id."""
    return _best(v, ok, o.rank, o.record)


def longest_by_precedence(v: Column, ok: Column, o: Order) -> Column:
    """Longest text of the best-ranked source having one."""
    return _best(v, ok, o.rank, -F.length(v), v)


def richest_html_by_precedence(v: Column, ok: Column, o: Order) -> Column:
    """Text with the most visible characters, best source first."""
    return _best(v, ok, o.rank, -F.length(strip_html(v)), o.record)


def earliest_non_null(v: Column, ok: Column, o: Order) -> Column:
    """Smallest value over all sources."""
    return F.min(F.when(ok, v))


def latest_crawl(v: Column, ok: Column, o: Order) -> Column:
    """Largest value over all sources."""
    return F.max(F.when(ok, v))


def prefer_deepest_path(v: Column, ok: Column, o: Order) -> Column:
    """URL with the most path segments, then the longest, then the first in text order."""
    return _best(v, ok, -F.coalesce(path_depth(v), F.lit(0)), -F.length(v), v)


def latest_by_date(v: Column, ok: Column, o: Order) -> Column:
    """Newest published value, whatever the source."""
    return _best(v, ok, o.newest, o.rank, o.record)


def max_by_date(v: Column, ok: Column, o: Order) -> Column:
    """Value of the newest record having one; the largest among equal times."""
    return _best(v, ok, o.newest, -v, o.record)


def richest_html_by_date(v: Column, ok: Column, o: Order) -> Column:
    """Newest text having one; the most visible characters among equal times."""
    return _best(v, ok, o.newest, -F.length(strip_html(v)), o.record)


RULES: dict[str, Callable] = {
    "latest_by_precedence": latest_by_precedence,
    "earliest_by_precedence": earliest_by_precedence,
    "max_by_precedence": max_by_precedence,
    "first_non_null_by_precedence": first_by_precedence,
    "longest_by_precedence": longest_by_precedence,
    "richest_html_by_precedence": richest_html_by_precedence,
    "earliest_non_null": earliest_non_null,
    "latest_crawl": latest_crawl,
    "prefer_deepest_path": prefer_deepest_path,
    "latest_by_date": latest_by_date,
    "max_by_date": max_by_date,
    "richest_html_by_date": richest_html_by_date,
}


def _usable(df: DataFrame, field: str) -> Column:
    c = F.col(field)
    if isinstance(df.schema[field].dataType, T.StringType):
        return F.coalesce(c, F.lit("")) != ""
    return c.isNotNull()


def union_values(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, value): the distinct entries of a list field per cluster."""
    return df.select(key, F.explode(field).alias("value")).filter("value IS NOT NULL").distinct()


def union_rows(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, value): the distinct entries of several list fields, a row each.

    Entries are made distinct in each task before they travel, and a cluster's rows
    spread by value, so a cluster may hold any share of all records.
    """
    pairs = [
        F.transform(F.col(c), lambda v, c=c: F.struct(F.lit(c).alias("field"), v.cast("string").alias("value")))
        for c in fields
    ]
    if not pairs:
        return df.select(key, F.lit("").alias("field"), F.lit("").alias("value")).limit(0)
    entries = F.concat(*[F.coalesce(p, F.array().cast("array<struct<field:string,value:string>>")) for p in pairs])
    each = df.select(key, F.explode(entries).alias("_e")).select(key, "_e.field", "_e.value")
    return each.filter("value IS NOT NULL").distinct()


def survive(
    df: DataFrame,
    key: str,
    rules: Mapping[str, str | Sequence[str]],
    rank: str = "rank",
    time: str = "published_at",
    record: str = "record_id",
    source: str = "source",
) -> DataFrame:
    """One row per key with every field by its rule.

    A rule is a name from RULES, 'union_unique' for list fields, or a list of
    sources: the first of them that has a value gives it (its earliest
    published one), and sources outside the list give nothing.
    """
    o = Order(rank, time, record)
    plain, unions = [], []
    for field, rule in rules.items():
        v, ok = F.col(field), _usable(df, field)
        if rule == "union_unique":
            unions.append(field)
        elif isinstance(rule, str):
            plain.append(RULES[rule](v, ok, o).alias(field))
        else:
            own = source_rank(source, rule)
            plain.append(_best(v, ok & (own < LAST_RANK), own, o.oldest, o.record).alias(field))
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_records"), *plain)
    for field in unions:
        values = (
            union_values(df, key, field)
            .groupBy(F.col(key).alias("_k"))
            .agg(F.array_sort(F.collect_list("value")).alias(field))
        )
        empty = F.array().cast(df.schema[field].dataType)
        out = (
            out.join(values, F.col(key) == F.col("_k"), "left")
            .drop("_k")
            .withColumn(field, F.coalesce(field, empty))
        )
    return out.select(key, "n_records", *rules)


def url_alternates(df: DataFrame, key: str, raw: str, canonical: str) -> DataFrame:
    """(key, alternate): the distinct raw URLs of a cluster other than its canonical one."""
    return (
        df.filter(F.col(raw).isNotNull() & ~F.col(raw).eqNullSafe(F.col(canonical)))
        .select(key, F.col(raw).alias("alternate"))
        .distinct()
    )
