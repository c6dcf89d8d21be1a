"""Latest versions, history and rolling measures.

Keep-latest operators are grouped min_by/max_by rather than ranked windows:
partial aggregation reduces a hot key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import blank_to_null
from harrow.session import cut_lineage


def _newest_first(times: Sequence[str], tie: str) -> Column:
    """Ordering struct: later times first, NULL times last, then the smallest tie value."""
    parts = []
    for t in times:
        micros = F.unix_micros(F.col(t).cast("timestamp"))
        parts += [F.col(t).isNull(), F.coalesce(-micros, F.lit(0))]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)], F.col(tie).alias("tie"))


def keep_latest(df: DataFrame, key: str, times: Sequence[str], tie: str) -> DataFrame:
    """The newest row per key; the key must not be NULL (see keys.link_key)."""
    best = df.groupBy(key).agg(
        F.min_by(F.struct(*df.columns), _newest_first(times, tie)).alias("_r")
    )
    return best.select("_r.*")


def collapse_by(df: DataFrame, second: str, times: Sequence[str], tie: str) -> DataFrame:
    """The newest row per secondary id; rows without one are all kept."""
    has = blank_to_null(second).isNotNull()
    return df.filter(~has).unionByName(
        keep_latest(df.filter(has), second, times, tie).select(*df.columns)
    )


def mark_superseded(df: DataFrame, key: str, times: Sequence[str], row_id: str) -> DataFrame:
    """Every row with the id of the newest row of its key; NULL on the newest itself."""
    newest = df.groupBy(key).agg(
        F.min_by(row_id, _newest_first(times, row_id)).alias("_newest")
    )
    by = F.when(F.col(row_id) != F.col("_newest"), F.col("_newest"))
    return df.join(newest, key, "left").withColumn("superseded_by", by).drop("_newest")


def sliced(df: DataFrame, key: str, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """The rows with _s, the number of their slice: a written table.

    The table is cut into slices of about equal depth along (key, order): Spark
    samples the keys with the whole order and splits between them. A key with many
    rows lies in many slices, also when all its rows fall on one day or have no
    time; small keys share one. Slices of a key ascend with its order, NULL first.
    """
    along = [key, *order]
    ranged = df.repartitionByRange(slices, *along) if slices else df.repartitionByRange(*along)
    # written, so that every reader sees the same cuts
    return cut_lineage(ranged.withColumn("_s", F.spark_partition_id()))


def _same_slice(key: str) -> Column:
    return F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_ks"))


def with_previous(
    df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], slices: int | None = None
) -> DataFrame:
    """Adds prev: struct(fields) of the row before within the key, NULL for the first row.

    Equal to lag() over the key, but no task needs a whole key: rows are ranked
    per key and slice, and each slice takes over the last row of the nearest
    earlier one. The order must be total. slices: how many, by default as many as
    shuffle partitions.
    """
    cut = sliced(df, key, order, slices)
    row, place = F.struct(*fields), F.struct(*order)
    last = cut.groupBy(key, "_s").agg(F.max_by(row, place).alias("_last"))
    carry = last.select(
        F.col(key).alias("_k"),
        F.col("_s").alias("_ks"),
        F.lag("_last").over(Window.partitionBy(key).orderBy("_s")).alias("_carry"),
    )
    w = Window.partitionBy(key, "_s").orderBy(*order)
    ranked = cut.withColumns({"_prev": F.lag(row).over(w), "_n": F.row_number().over(w)})
    prev = F.when(F.col("_n") > 1, F.col("_prev")).otherwise(F.col("_carry"))
    return (
        ranked.join(carry, _same_slice(key), "left")
        .withColumn("prev", prev)
        .drop("_s", "_prev", "_n", "_k", "_ks", "_carry")
    )


def diff_history(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    fields: Sequence[str],
    slices: int | None = None,
) -> DataFrame:
    """One row per changed field between consecutive versions of a key.

    A change from or to NULL counts. The first version has nothing to differ from.
    """
    needed = df.select(*dict.fromkeys([key, *order, *fields]))
    seen = with_previous(needed, key, order, fields, slices).filter("prev IS NOT NULL")
    changes = F.array(
        *[
            F.when(
                ~F.col(f).eqNullSafe(F.col(f"prev.{f}")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"prev.{f}").cast("string").alias("old_value"),
                    F.col(f).cast("string").alias("new_value"),
                ),
            )
            for f in fields
        ]
    )
    long = seen.select(key, *order, F.explode(F.array_compact(changes)).alias("c"))
    return long.select(key, *order, "c.field", "c.old_value", "c.new_value")


def text_changed(current: Column, previous: Column, threshold: int) -> Column:
    """Whether two texts differ by at least threshold characters of edit distance.

    Cheap bounds decide most pairs; the bounded distance stops at the threshold
    and gives -1 beyond it.
    """
    return (
        F.when(current == previous, False)
        .when(F.abs(F.length(current) - F.length(previous)) >= threshold, True)
        .when(F.greatest(F.length(current), F.length(previous)) < threshold, False)
        .otherwise(F.levenshtein(current, previous, threshold - 1) == -1)
    )


def changed_snapshots(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    text: str,
    threshold: int = 200,
    slices: int | None = None,
) -> DataFrame:
    """Snapshots whose whole text differs from the one before by at least threshold characters.

    First snapshots are not reported; NULL text counts as empty.
    """
    seen = with_previous(df, key, order, [text], slices).filter("prev IS NOT NULL")
    empty = F.lit("")
    changed = text_changed(
        F.coalesce(F.col(text), empty), F.coalesce(F.col(f"prev.{text}"), empty), threshold
    )
    return seen.filter(changed).drop("prev")


def rolling_failure_rate(
    log: DataFrame,
    key: str,
    order: Sequence[str],
    failed: str,
    calls: int = 20,
    slices: int | None = None,
) -> DataFrame:
    """Share of failures in the last calls of each key, the current one included.

    Works per key and slice like with_previous; a slice takes over the last
    calls-1 outcomes from before it, which is a short array.
    """
    flag = F.coalesce(F.col(failed).cast("int"), F.lit(0))
    cut = sliced(log, key, order, slices).withColumn("_f", flag)
    newest = Window.partitionBy(key, "_s").orderBy(*[F.col(o).desc() for o in order])
    last = (
        cut.select(key, "_s", "_f", F.row_number().over(newest).alias("_d"))
        .filter(F.col("_d") < calls)
        .groupBy(key, "_s")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("_d")).alias("d"), "_f"))).alias("_l"))
    )
    before = Window.partitionBy(key).orderBy("_s").rowsBetween(-(calls - 1), -1)
    carry = last.select(
        F.col(key).alias("_k"),
        F.col("_s").alias("_ks"),
        F.flatten(F.collect_list(F.col("_l._f")).over(before)).alias("_carry"),
    )
    w = Window.partitionBy(key, "_s").orderBy(*order)
    recent = w.rowsBetween(-(calls - 1), 0)
    ranked = cut.withColumns(
        {"_in": F.sum("_f").over(recent), "_got": F.count(F.lit(1)).over(recent).cast("int")}
    )
    take = F.least(F.lit(calls) - F.col("_got"), F.size("_carry"))
    earlier = F.aggregate(
        F.slice("_carry", F.size("_carry") - take + 1, take), F.lit(0), lambda a, f: a + f
    )
    rate = (F.col("_in") + earlier) / (F.col("_got") + take)
    return (
        ranked.join(carry, _same_slice(key), "left")
        .withColumn("failure_rate", F.round(rate, 6))
        .drop("_s", "_f", "_in", "_got", "_k", "_ks", "_carry")
    )


def preview(df: DataFrame, group: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= n)


def with_payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """The whole row as JSON text."""
    return df.withColumn(column, F.to_json(F.struct(*df.columns)))


def retain(df: DataFrame, time: str, as_of: str, days: int = 365) -> DataFrame:
    """History rows from midnight the given days before as_of. The bound has the column's own type,
    so it is pushed into the scan.
    """
    start = F.lit(as_of).cast("date") - F.expr(f"INTERVAL {days} DAYS")
    return df.filter(F.col(time) >= start.cast(df.schema[time].dataType))
