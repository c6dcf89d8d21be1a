"""Loading sheet exports into the catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.keys import stable_key
from harrow.functions.text import blank_to_null
from harrow.operators.columns import map_headers, with_constants, with_load_columns
from harrow.operators.quality import (
    in_vocabulary,
    required,
    required_any,
    split_valid,
    validate,
)
from harrow.vocab import (
    FUNDING_TYPES,
    JURISDICTION_LEVELS,
    PROGRAM_COLUMNS,
    REQUIRED_PROGRAM_COLUMNS,
    STATUSES,
)


def import_rows(
    rows: DataFrame,
    headers: Mapping[str, Sequence[str]],
    loaded_at: str,
    keep: Sequence[str] = (),
    trimmed: bool = True,
    **constants,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) catalogue rows from one header dialect.

    Blank cells become NULL. keep names columns the rows already have under
    their target name (country, source_sheet), constants sets them instead.
    The id follows from the business columns, so loading twice gives equal rows.
    Rows without a program name are rejected with that reason; a name of spaces
    alone is none, except in the dialects that do not trim (trimmed=False).
    """
    mapped = with_constants(map_headers(rows, headers, keep=keep), **constants)
    missing = [c for c in PROGRAM_COLUMNS if c not in mapped.columns]
    full = mapped.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else mapped
    loaded = with_load_columns(full.select(*PROGRAM_COLUMNS), loaded_at, PROGRAM_COLUMNS)
    ordered = loaded.select("id", *PROGRAM_COLUMNS, "imported_at", "created_at", "updated_at")
    return split_valid(ordered, required(["program_name"], trimmed))


def import_canonical(
    programs: DataFrame, docs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(programs, rejected programs, docs, rejected docs) of a canonical template.

    Programs need their five required fields, docs a file name or a source URL.
    Docs get a stable doc_id; programs get the text their word search uses.
    """
    good, bad = split_valid(programs, required(REQUIRED_PROGRAM_COLUMNS))
    search = F.concat_ws(
        " ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "program_summary", "tags")]
    )
    place = F.coalesce(blank_to_null("source_url"), blank_to_null("file_name"))
    keyed = docs.withColumn("doc_id", stable_key("program_id", "display_name", place))
    good_docs, bad_docs = split_valid(keyed, required_any(["file_name", "source_url"]))
    return good.withColumn("search_text", search), bad, good_docs, bad_docs


def audit_canonical(programs: DataFrame) -> DataFrame:
    """Programs whose level, status or funding type is no word of its vocabulary, with reasons."""
    words = {
        "jurisdiction_level": JURISDICTION_LEVELS,
        "status": STATUSES,
        "funding_type": FUNDING_TYPES,
    }
    return validate(programs, in_vocabulary(words)).filter(F.size("failed_rules") > 0)
