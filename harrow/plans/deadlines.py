"""The deadline calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import dates
from harrow.functions.text import type_label
from harrow.operators.columns import deadline_column
from harrow.operators.filters import filter_any_filled


def deadline_calendar(
    df: DataFrame, as_of: str, horizon_days: int | None = None, slashes: str = "dmy"
) -> DataFrame:
    """Programs with any deadline text, by days remaining; unreadable dates come last.

    Days are counted from as_of to the date read from the text. horizon_days
    keeps only dates from as_of up to that many days ahead.
    """
    listed = filter_any_filled(df, ["closing_date", "application_deadline"]).select(
        "id",
        F.col("program_name").alias("program"),
        type_label(F.lit("signup")).alias("type"),
        deadline_column("TBD").alias("date"),
        F.col("country").alias("location"),
    )
    timed = listed.withColumn(
        "days_until", dates.days_until(dates.parse_date("date", slashes), as_of)
    )
    if horizon_days is not None:
        timed = timed.filter(F.col("days_until").between(0, horizon_days))
    return timed.withColumns(
        {
            "status": dates.deadline_status("days_until"),
            "severity": dates.deadline_severity("days_until"),
            "urgent": dates.is_urgent("days_until"),
            "can_remind": dates.can_remind("days_until"),
            "remaining": dates.remaining_text("days_until"),
        }
    ).orderBy(F.col("days_until").asc_nulls_last(), "id")
