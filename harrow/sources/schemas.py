"""Declared schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from harrow.vocab import PROGRAM_COLUMNS


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PROGRAMS = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + _strings(*PROGRAM_COLUMNS).fields
    + [T.StructField(n, T.TimestampType()) for n in ("imported_at", "created_at", "updated_at")]
)

ATTRIBUTES = _strings("program_id", "attr_key", "attr_value")

PROGRAM_DOCS = T.StructType(
    _strings(
        "doc_id", "program_id", "doc_type", "display_name", "file_slug", "source_url",
        "language", "effective_date", "sha256", "notes",
    ).fields
    + [T.StructField("created_at", T.TimestampType())]
)

MANIFEST = _strings(
    "program_id", "program_title", "province_or_state", "country", "doc_type", "display_name",
    "file_name", "language", "effective_date", "source_url", "notes",
)

FEED_ITEM = _strings("title", "link", "pubDate", "category", "guid", "summary")

OPPORTUNITY = T.StructType(
    _strings(
        "id", "number", "title", "agencyName", "agencyCode", "openDate", "closeDate",
        "oppStatus", "docType", "category", "agencyContact", "postDate", "archiveDate",
        "description", "opportunityCategory",
    ).fields
    + [
        T.StructField(n, T.ArrayType(T.StringType()))
        for n in ("alnist", "cfdaList", "eligibilities", "applicantTypes")
    ]
    + [
        T.StructField("estimatedFunding", T.DecimalType(18, 2)),
        T.StructField("expectedNumberOfAwards", T.IntegerType()),
    ]
)

CANONICAL_PROGRAMS = T.StructType(
    _strings(
        "program_id", "title", "country", "jurisdiction_level", "province_or_territory", "status",
    ).fields
    + [T.StructField("last_reviewed_utc", T.TimestampType())]
    + _strings(
        "reviewed_by", "evidence_url", "program_summary", "eligibility_summary",
        "eligible_farm_types", "eligible_commodities", "eligible_regions", "special_categories",
        "funding_type", "max_amount",
    ).fields
    + [
        T.StructField("cost_share_pct", T.DecimalType(18, 2)),
        T.StructField("reimbursement_pct", T.DecimalType(18, 2)),
        T.StructField("eligible_expense_categories", T.StringType()),
        T.StructField("is_rolling", T.BooleanType()),
        T.StructField("open_date", T.DateType()),
        T.StructField("close_date", T.DateType()),
    ]
    + _strings(
        "application_process_summary", "required_documents_summary", "official_link",
        "contact_email", "contact_phone", "tags", "notes_admin",
    ).fields
)

CANONICAL_DOCS = T.StructType(
    _strings(
        "program_id", "doc_id", "doc_type", "display_name", "file_name", "source_url", "language",
    ).fields
    + [T.StructField("effective_date", T.DateType())]
    + _strings("sha256", "province_or_territory", "country", "notes").fields
)

OPEN_OPPORTUNITY = T.StructType(
    _strings("id", "title", "source", "program", "sector", "status").fields
    + [T.StructField("funding_amount_nzd", T.DoubleType())]
    + _strings("deadline", "link", "publisher", "published_at").fields
)

PROGRAM_WITH_AMOUNT = T.StructType(
    _strings("name", "jurisdiction", "source").fields
    + [
        T.StructField(
            "amount",
            T.StructType(
                [
                    T.StructField("min_aud", T.DoubleType()),
                    T.StructField("max_aud", T.DoubleType()),
                    T.StructField("notes", T.StringType()),
                ]
            ),
        ),
        T.StructField("eligible_applicants", T.ArrayType(T.StringType())),
        T.StructField("citations", T.ArrayType(T.StringType())),
    ]
)

# What valid records hold, for quality.spec_rules.
OPEN_OPPORTUNITY_SPEC = {
    "properties": {
        "source": {"enum": ["rss", "page"]},
        "sector": {"const": "agriculture"},
        "status": {"enum": ["open"]},
        "funding_amount_nzd": {"minimum": 0},
    },
    "required": ["id", "title", "sector", "status", "funding_amount_nzd", "link"],
}

PROGRAM_WITH_AMOUNT_SPEC = {
    "required": ["name", "jurisdiction", "source", "amount", "eligible_applicants", "citations"],
}
