"""Column mapping and projections."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.keys import stable_key
from harrow.functions.text import blank_to_null, filled, first_filled, first_filled_labelled
from harrow.functions.text import language_suffix
from harrow.vocab import CARD_DEFAULTS, DOC_TYPE_LABELS


def normalize_header(name: str) -> str:
    """Header spelling: every Unicode hyphen becomes '-', spaces collapse, case folds."""
    dashed = re.sub("[‐‑‒–—―]", "-", name)
    return re.sub(r"\s+", " ", dashed).strip().lower()


def unify_headers(df: DataFrame) -> DataFrame:
    """All columns renamed to their normal spelling; equal spellings fall back left to right."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(normalize_header(c), []).append(c)
    return df.select(
        *[
            (F.col(f"`{cs[0]}`") if len(cs) == 1 else first_filled(*[F.col(f"`{c}`") for c in cs]))
            .alias(name)
            for name, cs in groups.items()
        ]
    )


def map_headers(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]],
    default: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Targets filled from their first filled source header; absent headers count as blank.

    Headers are compared by normal spelling. One header may feed several targets.
    """
    have: dict[str, list[str]] = {}
    for c in df.columns:
        have.setdefault(normalize_header(c), []).append(c)

    def target(headers: Sequence[str]) -> Column:
        found = list(dict.fromkeys(c for h in headers for c in have.get(normalize_header(h), [])))
        if not found:
            return F.lit(default).cast("string")
        return first_filled(*[F.col(f"`{c}`") for c in found], default=default)

    return df.select(
        *[F.col(f"`{c}`") for c in keep], *[target(hs).alias(t) for t, hs in aliases.items()]
    )


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def with_load_columns(df: DataFrame, loaded_at: str, key: Sequence[str]) -> DataFrame:
    """A stable id from the business columns and the three load times as one given instant."""
    at = F.lit(loaded_at).cast("timestamp")
    return df.withColumns(
        {"id": stable_key(*key), "imported_at": at, "created_at": at, "updated_at": at}
    )


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def project_schema(df: DataFrame, spec: Mapping[str, Column]) -> DataFrame:
    """Exactly the named output columns, each from its expression."""
    return df.select(*[c.alias(name) for name, c in spec.items()])


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """target -> source renames; columns that are not named stay as they are."""
    return df.withColumnsRenamed({src: target for target, src in names.items()})


def blanks_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: blank_to_null(c) for c in columns})


def label_lookup(column: str, labels: Mapping[str, str]) -> Column:
    """The label of a code, or the code itself when there is none."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.col(column)), F.col(column))


def doc_caption(doc_type: str = "doc_type", language: str = "language") -> Column:
    """Document type label with the language mark when it is not English."""
    label = F.coalesce(label_lookup(doc_type, DOC_TYPE_LABELS), F.lit(""))
    return F.concat(label, language_suffix(language))


def resolve_doc_target(slug: str = "file_slug", url: str = "source_url") -> Column:
    """struct(kind, href): a hosted file wins over a URL; NULL when neither is filled."""
    return F.when(
        filled(slug),
        F.struct(
            F.lit("download").alias("kind"), F.concat(F.lit("/pdfs/"), F.col(slug)).alias("href")
        ),
    ).when(filled(url), F.struct(F.lit("view").alias("kind"), F.col(url).alias("href")))


def hosted_path(file_name: str = "file_name", folder: str = "canada") -> Column:
    return F.concat(F.lit(folder + "/"), F.col(file_name))


def deadline_column(default: str | None = None) -> Column:
    return first_filled("closing_date", "application_deadline", default=default)


def objectives_column() -> Column:
    return first_filled_labelled({"Key Objectives": "key_objectives", "Focus": "focus"})


def eligibility_column() -> Column:
    return first_filled("eligibility_cutoffs", "cutoffs_caps", "acreage_production_limit")


def budget_limited() -> Column:
    return filled("budget_exhaustion_marker")


def practice_cards(df: DataFrame, n: int = 12, order: Sequence[str] = ("country", "program_name", "id")):
    """The first n programs of the ordered catalogue as cards."""
    d = CARD_DEFAULTS

    def present(*values: Column) -> Column:
        return F.filter(F.array(*values), lambda v: v != "")

    top = df.orderBy(*order).limit(n)
    return top.select(
        "id",
        F.col("program_name").alias("title"),
        F.col("country").alias("category"),
        first_filled("funding_amount", default=d["cost_share"]).alias("cost_share"),
        first_filled("payment_cap", default=d["cap_range"]).alias("cap_range"),
        deadline_column(d["payoff_period"]).alias("payoff_period"),
        present(
            F.lit(d["benefit_1"]),
            first_filled("key_objectives", "focus", default=d["benefit_2"]),
            first_filled("administered", default=d["benefit_3"]),
        ).alias("benefits"),
        present(
            F.lit(d["note_1"]),
            first_filled("eligibility_cutoffs", default=d["note_2"]),
            first_filled("additional_information", default=d["note_3"]),
        ).alias("verification_notes"),
    )
