"""Rule tables, eligibility, answers, routing and the transform pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.dates import days_until
from harrow.functions.money import DOLLAR_AMOUNT, extract_amount
from harrow.operators import joins, quality, reshape, rules
from harrow.plans.eligibility import check_eligibility, submission_pack
from harrow.plans.opportunities import open_latest, opportunities
from harrow.sources.readers import load
from harrow.sources.schemas import OPEN_OPPORTUNITY_SPEC
from harrow.vocab import (
    ANSWERS,
    APPLICANT_RULES,
    DEFAULT_ANSWER,
    DEFAULT_PROGRAM,
    LOCATION_PROGRAMS,
    MATRIX_REGIONS,
    ROUTES,
    dimensions,
)
from registry.bindings import FORMS, RECORDS, cte, frame
from registry.core import micros, canonical_url, filled, first_filled, query, trim


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prefix_case(column: str, index: int) -> str:
    whens = " ".join(
        f"WHEN starts_with({column}, {_q(r[0])}) THEN {_q(r[index])}" for r in LOCATION_PROGRAMS
    )
    return f"CASE {whens} ELSE {_q(DEFAULT_PROGRAM[index - 1])} END"


_MATCHED = "coalesce(" + " OR ".join(f"starts_with(location, {_q(r[0])})" for r in LOCATION_PROGRAMS) + ", false)"
_SCORABLE = " AND ".join(filled(c) for c in ("operation", "scale", "location", "practice"))


@query(
    "rule_by_prefix",
    f"""{cte(forms=FORMS)} SELECT form_id, {_prefix_case('location', 1)} AS program, {_prefix_case('location', 2)} AS rule_type,
        {_prefix_case('location', 3)} AS next_date, {_MATCHED} AS matched FROM forms""",
)
def rule_by_prefix(spark, d):
    out = joins.rule_by_prefix(frame(spark, d, FORMS), "location")
    return out.select("form_id", "program", "rule_type", "next_date", "matched")


@query(
    "prefix_rule_table",
    """WITH m AS (SELECT o_custkey, arg_min(c_mktsegment, c_custkey) AS segment FROM (SELECT DISTINCT o_custkey FROM orders)
         JOIN customer ON starts_with(cast(o_custkey AS VARCHAR), cast(c_custkey AS VARCHAR)) GROUP BY 1)
       SELECT o_orderkey, coalesce(segment, 'none') AS segment, m.o_custkey IS NOT NULL AS matched
       FROM orders o LEFT JOIN m ON m.o_custkey = o.o_custkey""",
)
def prefix_rule_table(spark, d):
    table = load(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("prefix"),
        F.col("c_custkey").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
    )
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"))
    return joins.prefix_join(orders, "cust", table, {"segment": "none"}).select(
        "o_orderkey", "segment", "matched"
    )


@query(
    "check_eligibility",
    f"""{cte(forms=FORMS)}, s AS (SELECT *, {_SCORABLE} AS ok FROM forms)
        SELECT form_id, CASE WHEN ok THEN 'likely' ELSE 'unclear' END AS eligible,
        CASE WHEN ok THEN {_prefix_case('location', 1)} END AS program, CASE WHEN ok THEN {_prefix_case('location', 2)} END AS rule_type,
        CASE WHEN ok THEN {_prefix_case('location', 3)} END AS next_date, ok AND {_MATCHED} AS matched,
        CASE WHEN ok THEN '50-75%' END AS cost_share, CASE WHEN ok THEN '$15,000-$40,000' END AS cap,
        CASE WHEN ok THEN 'Land control proof|Compliance ID verification|Dated quote/practice sketch' END AS checklist,
        ok AND {filled('land_control')} AND {filled('compliance_id')} AS can_submit FROM s""",
)
def eligibility(spark, d):
    out = check_eligibility(frame(spark, d, FORMS))
    return out.select(
        "form_id", "eligible", "program", "rule_type", "next_date", "matched", "cost_share", "cap",
        F.array_join("checklist", "|").alias("checklist"), "can_submit",
    )


@query(
    "submission_packs",
    f"""{cte(forms=FORMS)} SELECT form_id, {first_filled('farmer_name', default='Not provided')} AS farmer_name,
        {first_filled('contact', default='Not provided')} AS contact, location, operation, practice,
        {_prefix_case('location', 1)} AS program, '50-75%' AS cost_share, 'likely' AS eligible, 3 AS items
        FROM forms WHERE {_SCORABLE}""",
)
def submission_packs(spark, d):
    forms = frame(spark, d, FORMS)
    results = check_eligibility(forms).filter(F.col("eligible") == "likely").select(
        "form_id", "program", "rule_type", "next_date", "cost_share", "cap", "eligible", "checklist"
    )
    pack = submission_pack(forms, results)
    return pack.select(
        "form_id", "farmer_name", "contact", "location", "operation", "practice", "program",
        "eligibility_details.cost_share", "eligibility_details.eligible",
        F.size("checklist").alias("items"),
    )


@query(
    "numbered_checklist",
    f"""{cte(forms=FORMS)} SELECT form_id, CAST(number AS INT) AS number, ['Land control proof', 'Compliance ID verification', 'Dated quote/practice sketch'][number] AS item
        FROM forms, range(1, 4) t(number) WHERE {_SCORABLE}""",
)
def numbered_checklist(spark, d):
    results = check_eligibility(frame(spark, d, FORMS))
    return reshape.number_items(results, "checklist", ["form_id"])


@query(
    "option_audit",
    f"""{cte(forms=FORMS)},
        v AS (SELECT 'operation' AS dimension, operation AS value FROM forms WHERE {filled('operation')}
              UNION ALL SELECT 'scale', scale FROM forms WHERE {filled('scale')}
              UNION ALL SELECT 'location', location FROM forms WHERE {filled('location')}
              UNION ALL SELECT 'practice', practice FROM forms WHERE {filled('practice')})
        SELECT dimension, value, count(*) AS rows FROM v
        WHERE value NOT IN ('cow-calf','dairy','sheep','goats','horses','specialty-crops','1-50','51-200','201-500','500+',
          'canada-bc','australia-nsw','newzealand-otago','brazil-south','chile-north','us-iowa')
        GROUP BY 1, 2""",
)
def option_audit(spark, d):
    fields = ["operation", "scale", "location", "practice"]
    long = reshape.sweep_attributes(frame(spark, d, FORMS).select("form_id", *fields), "form_id", [])
    given = long.select(F.col("attr_key").alias("dimension"), F.col("attr_value").alias("value"))
    options = dimensions(spark).select("dimension", "value")
    return (
        given.join(F.broadcast(options), ["dimension", "value"], "left_anti")
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


_ASKED = """
SELECT conv_id, turn, role, CASE turn % 8 WHEN 0 THEN 'What documents do I need?' WHEN 2 THEN '   '
  WHEN 4 THEN 'How do I prove land control?' WHEN 6 THEN 'When are the next deadlines?' ELSE text END AS text
FROM {conversations}
"""


def _answer_case(index: int, other: str) -> str:
    whens = " ".join(f"WHEN {_q(q)} THEN {_q(v[index])}" for q, v in ANSWERS.items())
    return f"CASE text {whens} ELSE {other} END"


@query(
    "answer_lookup",
    f"""{cte(t=_ASKED)} SELECT conv_id, turn, {_answer_case(0, 'NULL')} AS intent, {_answer_case(1, _q(DEFAULT_ANSWER))} AS answer
        FROM t WHERE role = 'user' AND {trim('text')} <> ''""",
)
def answer_lookup(spark, d):
    asked = frame(spark, d, _ASKED).filter("role = 'user'")
    return joins.answer_lookup(asked, "text").select("conv_id", "turn", "intent", "answer")


@query(
    "hydrate_orders",
    """SELECT o_orderkey, coalesce(lines, 0) AS lines, CASE WHEN lines IS NULL THEN o_orderpriority ELSE 'detailed' END AS state, o_orderstatus
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def hydrate_orders(spark, d):
    listed = load(spark, d, "orders").select(
        "o_orderkey",
        F.lit(0).cast("bigint").alias("lines"),
        F.col("o_orderpriority").alias("state"),
        "o_orderstatus",
    )
    detail = (
        load(spark, d, "lineitem")
        .filter("l_returnflag = 'A'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("state", F.lit("detailed"))
    )
    return joins.hydrate(listed, detail, "o_orderkey")


@query(
    "link_by_parsed_id",
    r"""SELECT page_id, parsed_id, p_name FROM (SELECT page_id, nullif(regexp_extract(url, '/(\d+)', 1), '') AS parsed_id FROM pages)
        JOIN part ON parsed_id = cast(p_partkey AS VARCHAR)""",
)
def link_by_parsed_id(spark, d):
    pages, part = load(spark, d, "pages").select("page_id", "url"), load(spark, d, "part")
    linked = joins.link_by_parsed_id(pages, "url", r"/(\d+)", part, "p_partkey")
    return linked.select("page_id", "parsed_id", "p_name")


_TEMPLATE = "https://example.org/programs?keywords={keyword}&region={region}"


@query(
    "request_matrix",
    "SELECT p_name AS keyword, region, 'https://example.org/programs?keywords=' || replace(p_name, ' ', '%20') || '&region=' || region AS url "
    "FROM (SELECT DISTINCT p_name FROM part), (SELECT unnest([" + ", ".join(_q(r) for r in MATRIX_REGIONS) + "]) AS region)",
)
def request_matrix(spark, d):
    words = load(spark, d, "part").select(F.col("p_name").alias("keyword")).distinct()
    return joins.request_matrix(words, "keyword", MATRIX_REGIONS, _TEMPLATE)


@query(
    "only_seeded",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def only_seeded(spark, d):
    seeds = load(spark, d, "labels").filter("quality = 1")
    return joins.only_seeded(load(spark, d, "documents").select("doc_id", "lang"), seeds, "doc_id")


# Alert candidates: one per order.
ALERTS = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'portal_transparencia' WHEN 1 THEN 'mapa_news' WHEN 2 THEN 'bndes_news' ELSE 'other' END AS source,
  cast(o_totalprice AS DECIMAL(18,2)) * 4 AS funding_amount_brl, CASE WHEN o_orderstatus = 'P' THEN 'modified' ELSE 'posted' END AS status,
  CASE o_orderkey % 9 WHEN 0 THEN 'Novo plano safra 2025' WHEN 1 THEN 'CRÉDITO RURAL' WHEN 2 THEN 'Credito rural' WHEN 3 THEN NULL ELSE 'Aviso' END AS title,
  cast(o_orderdate AS DATE) AS deadline FROM {orders}
"""


@query(
    "alert_priority",
    f"""{cte(alerts=ALERTS)}, t AS (SELECT *, date_diff('day', DATE '1998-01-01', deadline) AS days_left FROM alerts)
        SELECT o_orderkey, CASE WHEN source = 'portal_transparencia' AND funding_amount_brl >= 1000000 THEN 'high'
        WHEN status = 'modified' AND days_left <= 21 THEN 'high'
        WHEN regexp_matches(title, '(?i)(Plano Safra|Pronaf|Pronamp|Garantia-Safra|Cr[eé]dito Rural|BNDES)') THEN 'high'
        WHEN source = 'mapa_news' THEN 'medium' WHEN source = 'bndes_news' THEN 'medium' END AS priority FROM t""",
)
def alert_priority(spark, d):
    alerts = frame(spark, d, ALERTS).withColumn("days_left", days_until("deadline", "1998-01-01"))
    return alerts.select("o_orderkey", rules.alert_priority().alias("priority"))


@query(
    "news_priority",
    """SELECT doc_id, CASE WHEN source IN ('src1', 'src2') AND (contains(lower(text), 'psgf') OR contains(lower(text), 'wellbeing') OR contains(lower(text), 'catchment')) THEN 'high'
       WHEN contains(lower(text), 'dairy') OR contains(lower(text), 'cattle') OR contains(lower(text), 'sheep') OR contains(lower(text), 'water') THEN 'medium' END AS priority FROM documents""",
)
def news_priority(spark, d):
    docs = load(spark, d, "documents").withColumn(
        "source", F.when(F.col("source").isin("src1", "src2"), "rss").otherwise("page")
    )
    return docs.select("doc_id", rules.news_priority("source", "text").alias("priority"))


# Titles and texts with sector, status and amounts in them.
ITEMS = """
SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'Dairy ' WHEN 1 THEN 'PSGF round ' WHEN 2 THEN 'Harbour ' WHEN 3 THEN 'Farming ' ELSE 'Primary Sector Growth Fund ' END, p_name) AS title,
  concat(CASE p_partkey % 4 WHEN 0 THEN 'Applications open. ' WHEN 1 THEN 'Applications closed. ' WHEN 2 THEN 'Now OPEN, later closed. ' ELSE 'Soon. ' END,
    CASE WHEN p_size % 3 = 0 THEN 'No sum.' ELSE concat('Up to $', cast(p_size AS STRING), ',500 of $ 900.') END,
    CASE WHEN p_size % 2 = 0 THEN ' Closes 14 March 2025.' ELSE ' Closes 31 Feb 2025.' END) AS text,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat('http://www.example.org/a/', cast(p_partkey AS STRING), '?utm_source=x') END AS link,
  CASE WHEN p_partkey % 2 = 0 THEN 'rss' ELSE 'page' END AS source,
  CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE '' END AS program, CASE WHEN p_partkey % 8 = 0 THEN 'Office' END AS publisher,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE '2025-01-02' END AS published_at, '2025-02-03' AS discovered_at
FROM {part}
"""
_SECTOR_WORDS = ("farm", "farming", "dairy", "livestock", "sheep", "cattle", "goat", "deer", "equine",
                 "water", "catchment", "emissions", "psgf", "sff")
_SECTOR_SQL = (
    "CASE WHEN regexp_matches(title, '(?i)Primary Sector Growth Fund|PSGF') OR "
    + " OR ".join(f"contains(lower(title), '{w}')" for w in _SECTOR_WORDS)
    + " THEN 'agriculture' END"
)
_STATUS_SQL = "CASE WHEN contains(lower(text), 'open') THEN 'open' WHEN contains(lower(text), 'closed') THEN 'closed' END"
_NZD = (
    r"list_max(list_transform(regexp_extract_all(text, '\$\s?([0-9][0-9,\.]+)', 1), "
    r"lambda x: try_cast(regexp_replace(x, '[\$,\s]', '', 'g') AS DECIMAL(18,2))))"
)


@query(
    "infer_labels",
    f"{cte(items=ITEMS)} SELECT p_partkey, {_SECTOR_SQL} AS sector, {_STATUS_SQL} AS status FROM items",
)
def infer_labels(spark, d):
    items = frame(spark, d, ITEMS)
    named = F.when(F.col("title").contains("Primary Sector Growth Fund"), "agriculture")
    return items.select(
        "p_partkey",
        F.coalesce(named, rules.infer_sector("title")).alias("sector"),
        rules.infer_status("text").alias("status"),
    )


@query(
    "opportunities",
    f"""{cte(items=ITEMS)}, t AS (SELECT *, {_SECTOR_SQL} AS sector, {_STATUS_SQL} AS status, {_NZD} AS amount,
          CASE WHEN contains(text, '14 March 2025') THEN '2025-03-14' ELSE '31 Feb 2025' END AS deadline FROM items)
        SELECT sha1(coalesce({canonical_url('link')}, title)) AS id, title, source, {first_filled('program', default='MPI/Ministerial')} AS program,
        sector, status, CAST(amount AS DOUBLE) AS funding_amount_nzd, deadline, link,
        {first_filled('publisher', default='MPI/ NZ Government')} AS publisher, coalesce(published_at, discovered_at) AS published_at
        FROM t WHERE sector = 'agriculture' AND status = 'open' AND amount > 0""",
)
def open_opportunities(spark, d):
    items = frame(spark, d, ITEMS).drop("p_partkey")
    feeds, pages = items.filter("source = 'rss'"), items.filter("source = 'page'")
    out = opportunities([feeds, pages])
    return out.withColumn("funding_amount_nzd", F.col("funding_amount_nzd").cast("double"))


@query(
    "validated_opportunities",
    f"""{cte(items=ITEMS)}, t AS (SELECT *, {_SECTOR_SQL} AS sector, {_STATUS_SQL} AS status, {_NZD} AS amount FROM items)
        SELECT p_partkey, concat_ws('; ', CASE WHEN sector IS NULL THEN 'missing sector' END, CASE WHEN status IS NULL THEN 'missing status' END,
          CASE WHEN amount IS NULL THEN 'missing funding_amount_nzd' END, CASE WHEN link IS NULL THEN 'missing link' END,
          CASE WHEN status <> 'open' THEN 'status not in vocabulary' END) AS reasons FROM t""",
)
def validated_opportunities(spark, d):
    items = frame(spark, d, ITEMS)
    named = F.when(F.col("title").contains("Primary Sector Growth Fund"), "agriculture")
    records = items.select(
        "p_partkey",
        F.col("p_partkey").alias("id"),
        "title",
        "source",
        F.coalesce(named, rules.infer_sector("title")).alias("sector"),
        rules.infer_status("text").alias("status"),
        extract_amount("text", "max", DOLLAR_AMOUNT).alias("funding_amount_nzd"),
        "link",
    )
    checked = quality.validate(records, quality.spec_rules(OPEN_OPPORTUNITY_SPEC))
    return checked.select("p_partkey", F.array_join("failed_rules", "; ").alias("reasons"))


_AMT = (
    r"list_max(list_transform(regexp_extract_all(funding_text, '(\$?\s*[0-9][0-9,\.]{2,})', 1), "
    r"lambda x: try_cast(regexp_replace(x, '[\$,\s]', '', 'g') AS DECIMAL(18,2))))"
)


@query(
    "open_latest",
    f"""{cte(records=RECORDS)},
        norm AS (SELECT *, coalesce(rfx_id, sha1(lower(regexp_replace(link, '[?#].*$', ''))), 'row:' || id) AS logical_key, {_AMT} AS funding_amount
          FROM records WHERE lower(sector) = 'agriculture'),
        latest AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY logical_key ORDER BY published_at DESC NULLS LAST, close_date DESC NULLS LAST, id) = 1),
        once AS (SELECT *, row_number() OVER (PARTITION BY rfx_id ORDER BY published_at DESC NULLS LAST, id) AS r FROM latest)
        SELECT logical_key AS id_key, title, source, agency, program, link, epoch_us(published_at) AS published_at,
        epoch_us(close_date) AS close_date, status, CAST(funding_amount AS DOUBLE) AS funding_amount FROM once
        WHERE (rfx_id IS NULL OR r = 1) AND regexp_matches(status, '(?i)open|opportunit(y|ies) open') AND coalesce(funding_amount, 0) > 0""",
)
def latest_open_records(spark, d):
    out = open_latest(frame(spark, d, RECORDS))
    return out.withColumns(
        {
            "published_at": micros("published_at"),
            "close_date": micros("close_date"),
            "funding_amount": F.col("funding_amount").cast("double"),
        }
    )


_APPLICANTS = """
SELECT c_custkey, concat(CASE c_custkey % 8 WHEN 0 THEN 'Primary producers with an ABN' WHEN 1 THEN 'primary producer, sheep'
  WHEN 2 THEN 'Any University or RDC' WHEN 3 THEN 'a topic for cooperatives' WHEN 4 THEN 'PEAK BODY or producer group with dairy and PIC'
  WHEN 5 THEN 'abn and pic in small letters' WHEN 6 THEN NULL ELSE 'nobody' END, ' ', lower(c_mktsegment)) AS eligibility
FROM {customer}
"""


def _class_sql(name: str) -> str:
    def hit(terms):
        return "(" + " OR ".join(
            f"contains(eligibility, {_q(t)})" if t.isupper() else f"contains(lower(eligibility), {_q(t.lower())})"
            for t in terms
        ) + ")"

    rule = APPLICANT_RULES[name]
    test = hit(rule["match_any"])
    if "must_have_any" in rule:
        test += " AND " + hit(rule["must_have_any"])
    return f"CASE WHEN {test} THEN '{name}' END"


@query(
    "classify_applicants",
    f"""{cte(t=_APPLICANTS)}, c AS (SELECT c_custkey, concat_ws('|', {', '.join(_class_sql(n) for n in sorted(APPLICANT_RULES))}) AS applicant_types FROM t WHERE eligibility IS NOT NULL)
        SELECT * FROM c WHERE applicant_types <> ''""",
)
def classify_applicants(spark, d):
    out = rules.classify(frame(spark, d, _APPLICANTS).filter("eligibility IS NOT NULL"), "eligibility")
    return out.select("c_custkey", F.array_join("applicant_types", "|").alias("applicant_types"))


_NOTICES = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'USDA-AMS' WHEN 1 THEN 'USDA-FNS' WHEN 2 THEN 'USDA-RD' WHEN 3 THEN 'NSF' END AS `agencyCode`,
  CASE WHEN o_orderstatus = 'P' THEN 'modified' ELSE 'posted' END AS `oppStatus` FROM {orders}
"""


@query(
    "route_alerts",
    """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS a, o_orderstatus = 'P' AS modified FROM orders)
       SELECT o_orderkey, unnest(list_concat(
         CASE a WHEN 0 THEN ['queue_ams', 'index_grants'] WHEN 1 THEN ['queue_fns', 'index_grants'] WHEN 2 THEN ['queue_rd', 'index_grants'] ELSE [] END,
         CASE WHEN modified THEN ['alerts_updates'] ELSE [] END)) AS destination FROM t""",
)
def route_alerts(spark, d):
    notices = frame(spark, d, _NOTICES)
    return rules.route(notices, ROUTES).select("o_orderkey", "destination")
