"""Eligibility in bulk, and the submission pack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import first_filled
from harrow.operators.filters import is_complete, is_scorable
from harrow.operators.joins import rule_by_prefix
from harrow.vocab import CAP_RANGE, CHECKLIST, COST_SHARE, ELIGIBLE_VERDICT, NOT_PROVIDED


def check_eligibility(forms: DataFrame) -> DataFrame:
    """Form rows with verdict, program, rule type, next date, cost share, cap and checklist.

    A form with operation, scale, location and practice is likely eligible,
    any other unclear, with no program. matched is false when the location fell
    to the default program. can_submit needs all six fields.
    """
    looked_up = rule_by_prefix(forms, "location")
    ok = is_scorable()
    return looked_up.withColumns(
        {
            "eligible": F.when(ok, ELIGIBLE_VERDICT).otherwise("unclear"),
            **{c: F.when(ok, F.col(c)) for c in ("program", "rule_type", "next_date")},
            "matched": ok & F.coalesce("matched", F.lit(False)),
            "cost_share": F.when(ok, F.lit(COST_SHARE)),
            "cap": F.when(ok, F.lit(CAP_RANGE)),
            "checklist": F.when(ok, F.array(*[F.lit(c) for c in CHECKLIST])),
            "can_submit": is_complete(),
        }
    )


def submission_pack(forms: DataFrame, results: DataFrame, key: str = "form_id") -> DataFrame:
    """One nested pack per form that has a result."""
    form = forms.alias("f")
    result = results.alias("r")
    joined = form.join(result, F.col(f"f.{key}") == F.col(f"r.{key}"))
    return joined.select(
        F.col(f"f.{key}").alias(key),
        first_filled("f.farmer_name", default=NOT_PROVIDED).alias("farmer_name"),
        first_filled("f.contact", default=NOT_PROVIDED).alias("contact"),
        F.col("f.location").alias("location"),
        F.col("f.operation").alias("operation"),
        F.col("f.practice").alias("practice"),
        F.col("r.program").alias("program"),
        F.col("r.rule_type").alias("rule_type"),
        F.col("r.next_date").alias("next_date"),
        F.struct("r.cost_share", "r.cap", "r.eligible").alias("eligibility_details"),
        F.col("r.checklist").alias("checklist"),
    )
