"""Catalogue-shaped tables derived from the given tables.

Each is one SQL text that reads the same in Spark and in the oracle, so both
sides start from equal rows. Table names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from harrow.sources.readers import load

PROGRAM_ID = "concat('P', lpad(cast({} AS STRING), 9, '0'))"

# One program per part.
PROGRAMS = f"""
SELECT {PROGRAM_ID.format('p_partkey')} AS id,
       n_name AS country,
       CASE WHEN p_partkey % 97 = 0 THEN '   '
            WHEN p_partkey % 89 = 0 THEN ''
            ELSE concat(p_name, ' ', p_brand) END AS program_name,
       concat(p_type, ' support for ', p_name) AS description,
       CASE WHEN p_partkey % 5 = 0 THEN NULL
            ELSE concat('https://www.example.org/programs/', cast(p_partkey AS STRING)) END AS hyperlink,
       CASE WHEN p_size % 6 = 0 THEN ''
            ELSE concat('Up to $', cast(cast(p_retailprice AS DECIMAL(18,2)) AS STRING)) END AS funding_amount,
       CASE WHEN p_size % 7 = 0 THEN NULL
            ELSE concat('$', cast(p_size AS STRING), ',000') END AS payment_cap,
       CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_type END AS key_objectives,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS focus,
       CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('Office ', p_brand) END AS administered,
       CASE WHEN p_size % 2 = 0 THEN concat(cast(p_size AS STRING), ' ha') END AS acreage_production_limit,
       CASE WHEN p_size % 10 = 1 THEN concat('Size ', cast(p_size AS STRING)) ELSE '' END AS eligibility_cutoffs,
       CASE WHEN p_size % 10 = 2 THEN concat('Cap ', cast(p_size AS STRING)) END AS cutoffs_caps,
       CASE p_partkey % 5
            WHEN 0 THEN cast(date '2025-01-01' + cast(p_partkey % 400 AS INT) AS STRING)
            WHEN 1 THEN 'Rolling applications'
            WHEN 2 THEN ''
            WHEN 3 THEN concat(substr(cast(date '2025-03-01' + cast(p_partkey % 90 AS INT) AS STRING), 9, 2), '/',
                               substr(cast(date '2025-03-01' + cast(p_partkey % 90 AS INT) AS STRING), 6, 2), '/2025')
            END AS closing_date,
       CASE WHEN p_partkey % 3 = 0 THEN cast(date '2025-02-01' + cast(p_partkey % 200 AS INT) AS STRING)
            WHEN p_partkey % 3 = 1 THEN '' END AS application_deadline,
       CASE WHEN p_partkey % 11 = 0 THEN 'Budget limited' ELSE '' END AS budget_exhaustion_marker,
       CASE WHEN p_size > 40 THEN concat('Notes on ', p_name) END AS additional_information,
       p_type AS source_sheet
FROM {{part}} JOIN {{nation}} ON p_partkey % 25 = n_nationkey
"""

# One document per order, attached to the program with the customer's number.
PROGRAM_DOCS = f"""
SELECT cast(o_orderkey AS STRING) AS doc_id,
       {PROGRAM_ID.format('o_custkey')} AS program_id,
       CASE o_orderkey % 9
            WHEN 0 THEN 'guideline' WHEN 1 THEN 'application_form' WHEN 2 THEN 'faq'
            WHEN 3 THEN 'checklist' WHEN 4 THEN 'terms' WHEN 5 THEN 'webpage'
            WHEN 6 THEN 'quick_guide' WHEN 7 THEN 'reference' ELSE 'portal' END AS doc_type,
       concat('Document ', o_orderpriority) AS display_name,
       CASE WHEN o_orderstatus = 'O' THEN concat('canada/', cast(o_orderkey AS STRING), '.pdf')
            WHEN o_orderstatus = 'P' THEN '' END AS file_slug,
       CASE WHEN o_orderkey % 4 < 3 THEN concat('https://example.org/d/', cast(o_orderkey AS STRING)) END AS source_url,
       CASE o_orderkey % 5 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' WHEN 2 THEN '' WHEN 3 THEN 'es' END AS language
FROM {{orders}}
"""

# One eligibility form per customer.
FORMS = """
SELECT c_custkey AS form_id,
       CASE WHEN c_custkey % 10 = 0 THEN c_name END AS farmer_name,
       CASE WHEN c_custkey % 10 = 1 THEN '' ELSE concat('c', cast(c_custkey AS STRING), '@example.org') END AS contact,
       CASE c_custkey % 7 WHEN 0 THEN 'cow-calf' WHEN 1 THEN 'dairy' WHEN 2 THEN 'sheep'
            WHEN 3 THEN 'goats' WHEN 4 THEN 'horses' WHEN 5 THEN 'specialty-crops' ELSE '' END AS operation,
       CASE c_custkey % 5 WHEN 0 THEN '1-50' WHEN 1 THEN '51-200' WHEN 2 THEN '201-500'
            WHEN 3 THEN '500+' ELSE '9-9' END AS scale,
       CASE c_nationkey WHEN 0 THEN 'canada-bc' WHEN 1 THEN 'australia-nsw' WHEN 2 THEN 'newzealand-otago'
            WHEN 3 THEN 'brazil-south' WHEN 4 THEN 'chile-north' WHEN 5 THEN 'us-iowa' WHEN 6 THEN NULL
            ELSE concat('region-', cast(c_nationkey AS STRING)) END AS location,
       lower(c_mktsegment) AS practice,
       CASE WHEN c_acctbal > 0 THEN 'own' END AS land_control,
       CASE WHEN c_custkey % 2 = 0 THEN concat('ID', cast(c_custkey AS STRING)) ELSE '' END AS compliance_id
FROM {customer}
"""

# Records with a number, a link and a funding text, one per order.
RECORDS = """
SELECT cast(o_orderkey AS STRING) AS id,
       concat(o_orderpriority, ' round') AS title,
       CASE WHEN o_orderkey % 2 = 0 THEN 'rss' ELSE 'page' END AS source,
       CASE WHEN o_orderkey % 10 = 0 THEN 'Forestry' ELSE 'Agriculture' END AS sector,
       concat('Program ', cast(o_custkey AS STRING)) AS program,
       'Agency' AS agency,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            ELSE concat('https://Example.org/Items/', cast(o_custkey AS STRING), '?ref=', cast(o_orderkey AS STRING)) END AS link,
       o_orderdate AS published_at,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS close_date,
       CASE o_orderstatus WHEN 'O' THEN 'Opportunity OPEN' WHEN 'P' THEN 'Open' ELSE 'Closed' END AS status,
       CASE WHEN o_orderkey % 6 = 0 THEN 'no amount given'
            ELSE concat('from $1,000 up to $', cast(cast(o_totalprice AS DECIMAL(18,2)) AS STRING)) END AS funding_text,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('RFX', cast(o_custkey % 500 AS STRING)) END AS rfx_id
FROM {orders}
"""

# A fetch log, one call per event.
CALLS = """
SELECT event_id, ts, concat('host', cast(user_id % 20 AS STRING)) AS domain, user_id,
       CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status,
       event_type = 'error' AS failed,
       cast(floor(value) AS BIGINT) AS latency_ms
FROM {events}
"""

_TABLES = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The derived table as a DataFrame."""
    names = set(_TABLES.findall(sql))
    return spark.sql(sql, **{n: load(spark, folder, n) for n in names})


def cte(**tables: str) -> str:
    """WITH clause giving the derived tables their names in an oracle."""
    parts = [f"{name} AS ({_TABLES.sub(lambda m: m[1], sql)})" for name, sql in tables.items()]
    return "WITH " + ",\n".join(parts) + "\n"
