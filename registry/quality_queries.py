"""Ingest by header dialect, validation rules and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import columns as cols
from harrow.operators import quality
from harrow.plans.ingest import audit_canonical, import_canonical, import_rows
from harrow.sources.readers import load
from harrow.vocab import (
    ALL_SHEETS_HEADERS,
    CA_DEADLINES_HEADERS,
    CA_ORIGINAL_HEADERS,
    DOC_TYPE_LABELS,
    TERRITORY_HEADERS,
)
from registry.bindings import PROGRAM_DOCS, PROGRAMS, cte, frame
from registry.core import filled, first_filled, micros, query, stable_key, trim

LOADED = "2025-10-12 00:00:00"

# Sheet rows with the spellings of the territory workbook.
_TERRITORY_ROWS = """
SELECT country AS `Territory`, CASE WHEN key_objectives = '' THEN '' ELSE program_name END AS `Subsidy Program`, program_name AS `Program`,
  description AS `Description`, '' AS `Hyperlink`, hyperlink AS `Link`, payment_cap AS `Payment Caps`, cutoffs_caps AS `Payment/Funding Cap`,
  NULL AS `Eligibility Cut-Offs`, eligibility_cutoffs AS `Eligibility Cut‑Offs`, closing_date AS `Closing Date/Deadline`,
  application_deadline AS `Application/Enrollment Deadline` FROM ({programs})
"""


def _territory_rows(spark, d):
    programs = frame(spark, d, PROGRAMS)
    return programs.select(
        F.col("country").alias("Territory"),
        F.when(F.col("key_objectives") == "", "").otherwise(F.col("program_name")).alias("Subsidy Program"),
        F.col("program_name").alias("Program"),
        F.col("description").alias("Description"),
        F.lit("").alias("Hyperlink"),
        F.col("hyperlink").alias("Link"),
        F.col("payment_cap").alias("Payment Caps"),
        F.col("cutoffs_caps").alias("Payment/Funding Cap"),
        F.lit(None).cast("string").alias("Eligibility Cut-Offs"),
        F.col("eligibility_cutoffs").alias("Eligibility Cut‑Offs"),
        F.col("closing_date").alias("Closing Date/Deadline"),
        F.col("application_deadline").alias("Application/Enrollment Deadline"),
        F.col("country").alias("country"),
        F.col("source_sheet").alias("source_sheet"),
    )


_TERRITORY_SQL = f"""{cte(programs=PROGRAMS)}, m AS (SELECT country, source_sheet,
   coalesce(nullif(CASE WHEN key_objectives = '' THEN '' ELSE program_name END, ''), nullif(program_name, '')) AS program_name,
   nullif(description, '') AS description, nullif(hyperlink, '') AS hyperlink, {first_filled('payment_cap', 'cutoffs_caps')} AS payment_cap,
   nullif(eligibility_cutoffs, '') AS eligibility_cutoffs, nullif(closing_date, '') AS closing_date,
   nullif(application_deadline, '') AS application_deadline FROM programs)
"""
_SHOWN = (
    "country", "source_sheet", "program_name", "description", "hyperlink", "payment_cap",
    "eligibility_cutoffs", "closing_date", "application_deadline",
)
_ID_SQL = stable_key(
    "country", "program_name", "description", "hyperlink", "''", "payment_cap", "''", "''", "''", "''",
    "eligibility_cutoffs", "''", "closing_date", "application_deadline", "''", "''", "''", "''", "''", "source_sheet",
)


@query(
    "import_territory_rows",
    f"""{_TERRITORY_SQL} SELECT {_ID_SQL} AS id, {', '.join(_SHOWN)}, epoch_us(TIMESTAMP '{LOADED}') AS imported_at FROM m WHERE {filled(trim('program_name'))}""",
)
def import_territory_rows(spark, d):
    good, _ = import_rows(
        _territory_rows(spark, d), TERRITORY_HEADERS, LOADED, keep=["country", "source_sheet"]
    )
    return good.select("id", *_SHOWN, micros("imported_at").alias("imported_at"))


@query(
    "rejected_territory_rows",
    f"""{_TERRITORY_SQL} SELECT description, 'missing program_name' AS reasons FROM m WHERE NOT {filled(trim('program_name'))}""",
)
def rejected_territory_rows(spark, d):
    _, bad = import_rows(
        _territory_rows(spark, d), TERRITORY_HEADERS, LOADED, keep=["country", "source_sheet"]
    )
    return bad.select("description", F.array_join("failed_rules", "; ").alias("reasons"))


@query(
    "import_all_sheets_rows",
    f"""{cte(programs=PROGRAMS)} SELECT 'CA' AS country, source_sheet, program_name, nullif(focus, '') AS focus, nullif(funding_amount, '') AS funding_amount
        FROM programs WHERE {filled('program_name')}""",
)
def import_all_sheets_rows(spark, d):
    rows = frame(spark, d, PROGRAMS).select(
        F.lit(None).cast("string").alias("Program Name"),
        "program_name",
        F.lit("").alias("Focus"),
        F.col("focus").alias("focus_"),
        F.col("funding_amount").alias("Funding Amount"),
        "source_sheet",
    )
    rows = rows.withColumnRenamed("focus_", "Focus ")
    aliases = {**ALL_SHEETS_HEADERS, "focus": ("Focus", "Focus ")}
    good, _ = import_rows(cols.unify_headers(rows), aliases, LOADED, keep=["source_sheet"], trimmed=False, country="CA")
    return good.select("country", "source_sheet", "program_name", "focus", "funding_amount")


@query(
    "import_deadline_dialect",
    f"""{cte(programs=PROGRAMS)} SELECT program_name, nullif(closing_date, '') AS closing_date, nullif(closing_date, '') AS application_deadline,
        nullif(cutoffs_caps, '') AS eligibility_cutoffs, 'CA' AS source_sheet FROM programs WHERE {filled(trim('program_name'))}""",
)
def import_deadline_dialect(spark, d):
    rows = frame(spark, d, PROGRAMS).select(
        F.col("program_name").alias("Subsidy Program"),
        F.col("closing_date").alias("Deadlines"),
        F.col("cutoffs_caps").alias("Eligibility"),
    )
    good, _ = import_rows(rows, CA_DEADLINES_HEADERS, LOADED, country="CA", source_sheet="CA")
    return good.select(
        "program_name", "closing_date", "application_deadline", "eligibility_cutoffs", "source_sheet"
    )


@query(
    "import_original_dialect",
    f"""{cte(programs=PROGRAMS)} SELECT program_name, nullif(closing_date, '') AS closing_date, CAST(NULL AS VARCHAR) AS application_deadline
        FROM programs WHERE {filled('program_name')}""",
)
def import_original_dialect(spark, d):
    rows = frame(spark, d, PROGRAMS).select(
        F.col("program_name").alias("Subsidy Program"),
        F.col("closing_date").alias("Closing Date/Deadline"),
    )
    good, _ = import_rows(rows, CA_ORIGINAL_HEADERS, LOADED, trimmed=False, country="CA", source_sheet="CA")
    return good.select("program_name", "closing_date", "application_deadline")


# Template rows: one program per customer, one document per order.
_TEMPLATE = """
SELECT concat('CA-', cast(c_custkey AS STRING)) AS program_id, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_name END AS title,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'CA' END AS country, 'Federal' AS jurisdiction_level,
  CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'BC' END AS province_or_territory,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'https://example.org' END AS official_link, c_mktsegment AS program_summary,
  CASE WHEN c_custkey % 2 = 0 THEN 'water; fencing' END AS tags FROM {customer}
"""
_TEMPLATE_DOCS = """
SELECT concat('CA-', cast(o_custkey AS STRING)) AS program_id, o_orderpriority AS display_name,
  CASE WHEN o_orderkey % 3 = 0 THEN concat(cast(o_orderkey AS STRING), '.pdf') ELSE '' END AS file_name,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('https://example.org/', cast(o_orderkey AS STRING)) END AS source_url FROM {orders}
"""
_NEEDED = ("title", "country", "jurisdiction_level", "province_or_territory", "official_link")
_BROKEN = (
    "concat_ws('; ', "
    + ", ".join(f"CASE WHEN NOT {filled(trim(c))} THEN 'missing {c}' END" for c in _NEEDED)
    + ")"
)


@query(
    "canonical_programs",
    f"""{cte(t=_TEMPLATE)}, v AS (SELECT *, {_BROKEN} AS reasons FROM t) SELECT program_id, reasons,
        CASE WHEN reasons = '' THEN title || ' ' || program_summary || ' ' || coalesce(tags, '') END AS search_text FROM v""",
)
def canonical_programs(spark, d):
    good, bad, _, _ = import_canonical(frame(spark, d, _TEMPLATE), frame(spark, d, _TEMPLATE_DOCS))
    kept = good.select("program_id", F.lit("").alias("reasons"), "search_text")
    return kept.unionByName(
        bad.select("program_id", F.array_join("failed_rules", "; ").alias("reasons")),
        allowMissingColumns=True,
    )


@query(
    "canonical_docs",
    f"""{cte(t=_TEMPLATE_DOCS)} SELECT program_id, {stable_key('program_id', 'display_name', "coalesce(nullif(source_url, ''), nullif(file_name, ''))")} AS doc_id
        FROM t WHERE {filled('file_name')} OR {filled('source_url')}""",
)
def canonical_docs(spark, d):
    _, _, good, _ = import_canonical(frame(spark, d, _TEMPLATE), frame(spark, d, _TEMPLATE_DOCS))
    return good.select("program_id", "doc_id")


@query(
    "rejected_canonical_docs",
    f"""{cte(t=_TEMPLATE_DOCS)} SELECT program_id, 'missing file_name or source_url' AS reasons FROM t
        WHERE NOT ({filled('file_name')} OR {filled('source_url')})""",
)
def rejected_canonical_docs(spark, d):
    _, _, _, bad = import_canonical(frame(spark, d, _TEMPLATE), frame(spark, d, _TEMPLATE_DOCS))
    return bad.select("program_id", F.array_join("failed_rules", "; ").alias("reasons"))


_LEVELS = """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Federal' WHEN 1 THEN 'Provincial' WHEN 2 THEN 'federal' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'Local' END AS jurisdiction_level,
  CASE c_custkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'rolling' WHEN 2 THEN 'Open' WHEN 3 THEN 'unknown' ELSE 'closed' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN 'grant' WHEN 1 THEN 'gift' WHEN 2 THEN 'cost_share' ELSE 'other' END AS funding_type FROM {customer}
"""


@query(
    "canonical_vocabulary",
    f"""{cte(t=_LEVELS)}, v AS (SELECT c_custkey, concat_ws('; ', CASE WHEN jurisdiction_level = 'federal' THEN 'jurisdiction_level not in vocabulary' END,
          CASE WHEN status = 'Open' THEN 'status not in vocabulary' END, CASE WHEN funding_type = 'gift' THEN 'funding_type not in vocabulary' END) AS reasons FROM t)
        SELECT * FROM v WHERE reasons <> ''""",
)
def canonical_vocabulary(spark, d):
    found = audit_canonical(frame(spark, d, _LEVELS))
    return found.select("c_custkey", F.array_join("failed_rules", "; ").alias("reasons"))


# A record specification of the kind the validator takes.
SPEC = {
    "properties": {
        "source": {"enum": ["src1", "src2", "src3", "src4", "src5", "src6", "src7"]},
        "lang": {"const": "en"},
        "n_chars": {"minimum": 500},
    },
    "required": ["text", "source"],
}


@query(
    "validate_spec",
    f"""SELECT doc_id, concat_ws('; ', CASE WHEN NOT {filled(trim('text'))} THEN 'missing text' END,
        CASE WHEN source NOT IN ('src1','src2','src3','src4','src5','src6','src7') THEN 'source not in vocabulary' END,
        CASE WHEN lang <> 'en' THEN 'lang is not en' END, CASE WHEN n_chars < 500 THEN 'n_chars below 500' END) AS reasons FROM documents""",
)
def validate_spec(spark, d):
    checked = quality.validate(load(spark, d, "documents"), quality.spec_rules(SPEC))
    return checked.select("doc_id", F.array_join("failed_rules", "; ").alias("reasons"))


@query(
    "orphan_documents",
    f"""{cte(programs=PROGRAMS, program_docs=PROGRAM_DOCS)} SELECT doc_id, program_id FROM program_docs WHERE program_id NOT IN (SELECT id FROM programs WHERE country < 'NATION_2')""",
)
def orphan_documents(spark, d):
    parents = frame(spark, d, PROGRAMS).filter("country < 'NATION_2'")
    return quality.orphans(frame(spark, d, PROGRAM_DOCS), parents, "program_id", "id").select(
        "doc_id", "program_id"
    )


@query(
    "unlabelled_documents",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unlabelled_documents(spark, d):
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    return quality.orphans(docs, labels, "doc_id", "doc_id").select("doc_id")


@query(
    "cascade_lines",
    "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
)
def cascade_lines(spark, d):
    done = load(spark, d, "orders").filter("o_orderstatus = 'F'")
    kept = quality.cascade(load(spark, d, "lineitem"), done, "l_orderkey", "o_orderkey")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, d):
    return quality.duplicate_keys(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_texts",
    "SELECT sha256(text) AS text_hash, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_texts(spark, d):
    hashed = load(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash"))
    return quality.duplicate_keys(hashed, ["text_hash"])


@query(
    "out_of_vocab",
    f"""{cte(program_docs=PROGRAM_DOCS)} SELECT doc_id, doc_type FROM program_docs WHERE doc_type NOT IN
        ('guideline','application_form','faq','checklist','terms','webpage','quick_guide','reference')""",
)
def out_of_vocab(spark, d):
    docs = frame(spark, d, PROGRAM_DOCS)
    return quality.out_of_vocab(docs, "doc_type", list(DOC_TYPE_LABELS)).select("doc_id", "doc_type")


# Document paths, good and bad, one per order.
_PATHS = """
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN concat('canada/', k, '.pdf') WHEN 1 THEN concat('canada/', k, '.PDF')
  WHEN 2 THEN concat('../pdfs-old/', k, '.pdf') WHEN 3 THEN concat('%2e%2e/', k, '.pdf') WHEN 4 THEN concat('canada/', k, '.txt')
  WHEN 5 THEN concat('canada/%zz', k, '.pdf') WHEN 6 THEN concat('canada/x/../', k, '.pdf') WHEN 7 THEN concat('/canada/./', k, '.pdf')
  WHEN 8 THEN concat('canada/a%20b+', k, '.pdf') ELSE concat('canada/../../x/', k, '.pdf') END AS file_slug
FROM (SELECT o_orderkey, cast(o_orderkey AS STRING) AS k FROM {orders})
"""
_FILES = """
SELECT CASE o_orderkey % 10 WHEN 1 THEN concat('canada/', cast(o_orderkey AS STRING), '.PDF') WHEN 8 THEN concat('canada/a b+', cast(o_orderkey AS STRING), '.pdf')
  ELSE concat('canada/', cast(o_orderkey AS STRING), '.pdf') END AS path FROM {orders} WHERE o_orderstatus <> 'F'
"""


@query(
    "audit_doc_paths",
    f"""{cte(p=_PATHS)} SELECT o.o_orderkey, CASE o.o_orderkey % 10 WHEN 5 THEN NULL WHEN 0 THEN file_slug WHEN 1 THEN file_slug WHEN 4 THEN file_slug
          WHEN 2 THEN 'pdfs-old/' || o.o_orderkey || '.pdf' WHEN 3 THEN o.o_orderkey || '.pdf' WHEN 8 THEN 'canada/a b+' || o.o_orderkey || '.pdf'
          WHEN 9 THEN 'x/' || o.o_orderkey || '.pdf' ELSE 'canada/' || o.o_orderkey || '.pdf' END AS resolved_path,
        CASE WHEN o.o_orderkey % 10 = 5 THEN 'bad_encoding' WHEN o.o_orderkey % 10 = 4 THEN 'not_pdf' WHEN o.o_orderkey % 10 IN (2, 3, 9) THEN 'outside_root'
             WHEN o_orderstatus = 'F' THEN 'missing' ELSE 'ok' END AS path_status FROM orders o JOIN p USING (o_orderkey)""",
)
def audit_doc_paths(spark, d):
    audited = quality.audit_doc_paths(frame(spark, d, _PATHS), frame(spark, d, _FILES))
    return audited.select("o_orderkey", "resolved_path", "path_status")
