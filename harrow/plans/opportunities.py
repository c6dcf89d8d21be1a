"""From feed and page records to open opportunities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.dates import extract_date_text, to_iso_date
from harrow.functions.keys import link_key
from harrow.functions.money import DOLLAR_AMOUNT, extract_amount
from harrow.functions.text import first_filled
from harrow.functions.urls import canonical_url
from harrow.operators.columns import project_schema
from harrow.operators.filters import open_funded, where_all
from harrow.operators.reshape import union_sources
from harrow.operators.rules import infer_sector, infer_status
from harrow.operators.windows import collapse_by, keep_latest

# Defaults of the projected record.
DEFAULT_PROGRAM = "MPI/Ministerial"
DEFAULT_PUBLISHER = "MPI/ NZ Government"


def opportunities(frames: Sequence[DataFrame]) -> DataFrame:
    """Open, funded agriculture records from raw items.

    Items have title, text, link, source, program, publisher, published_at and
    discovered_at. A sector named by a program pattern or the title words, a
    status and an amount are read from the text; records without them are out.
    """
    raw = union_sources(frames)
    read = raw.withColumns(
        {
            "sector": F.coalesce(
                F.when(F.col("title").rlike("(?i)Primary Sector Growth Fund|PSGF"), "agriculture"),
                infer_sector("title"),
            ),
            "status": infer_status("text"),
            "funding_amount_nzd": extract_amount("text", "max", DOLLAR_AMOUNT),
            "deadline_text": extract_date_text("text"),
        }
    )
    kept = where_all(
        read,
        [
            {"field": "sector", "eq": "agriculture"},
            {"field": "status", "eq": "open"},
            {"field": "funding_amount_nzd", "gt": 0},
        ],
    )
    return project_schema(
        kept,
        {
            "id": F.sha1(F.coalesce(canonical_url("link"), F.col("title"))),
            "title": F.col("title"),
            "source": F.col("source"),
            "program": first_filled("program", default=DEFAULT_PROGRAM),
            "sector": F.col("sector"),
            "status": F.col("status"),
            "funding_amount_nzd": F.col("funding_amount_nzd"),
            "deadline": F.coalesce(to_iso_date("deadline_text"), F.col("deadline_text")),
            "link": F.col("link"),
            "publisher": first_filled("publisher", default=DEFAULT_PUBLISHER),
            "published_at": F.coalesce("published_at", "discovered_at"),
        },
    )


def open_latest(df: DataFrame, sector: str = "agriculture", which: str = "marked") -> DataFrame:
    """The newest record per logical key in a sector, open and funded.

    Input columns: id, title, source, sector, program, agency, link,
    published_at, close_date (timestamps), status, funding_text, rfx_id.
    """
    wanted = df.filter(F.lower("sector") == sector).withColumns(
        {
            "logical_key": link_key("rfx_id", "link", "id"),
            "funding_amount": extract_amount("funding_text", which),
        }
    )
    latest = keep_latest(wanted, "logical_key", ["published_at", "close_date"], "id")
    collapsed = collapse_by(latest, "rfx_id", ["published_at"], "id")
    return project_schema(
        open_funded(collapsed),
        {
            "id_key": F.col("logical_key"),
            **{
                c: F.col(c)
                for c in (
                    "title", "source", "agency", "program", "link", "published_at",
                    "close_date", "status", "funding_amount",
                )
            },
        },
    )
