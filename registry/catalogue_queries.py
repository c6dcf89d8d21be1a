"""Catalogue read: search, filters, order, pages, cards and child rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.dates import days_until, deadline_status
from harrow.functions.text import has_email, is_uuid, valid_phone
from harrow.operators import columns as cols
from harrow.operators import filters, joins, sorting
from harrow.plans.catalogue import SEARCHED, browse, catalog_query
from harrow.plans.deadlines import deadline_calendar
from harrow.sources.readers import load
from harrow.sources.writers import export_nested
from harrow.operators.reshape import sweep_attributes
from registry.bindings import PROGRAM_DOCS, PROGRAMS, frame, cte
from registry.core import filled, first_filled, query, trim

P = cte(programs=PROGRAMS)
PD = cte(programs=PROGRAMS, program_docs=PROGRAM_DOCS)


def _search_sql(query_text: str, columns, like: bool) -> str:
    if like:
        tests = [f"coalesce({c} ILIKE '%{query_text}%', false)" for c in columns]
    else:
        tests = [f"coalesce(contains(lower({c}), lower('{query_text}')), false)" for c in columns]
    return "(" + " OR ".join(tests) + ")"


@query(
    "catalog_search",
    f"""SELECT doc_id, lang, source, n_chars FROM documents
        WHERE lang = 'en' AND {_search_sql('The ', ['text', 'source'], False)}""",
)
def catalog_search(spark, d):
    found = catalog_query(
        load(spark, d, "documents"), "en", "The ", ["text", "source"], "lang",
        order_by=["source", "doc_id"],
    )
    return found.select("doc_id", "lang", "source", "n_chars")


@query(
    "catalog_search_wildcards",
    f"""{P} SELECT id, country, program_name, focus FROM programs
        WHERE {_search_sql('b_ue%#2', SEARCHED, True)}""",
)
def catalog_search_wildcards(spark, d):
    found = catalog_query(frame(spark, d, PROGRAMS), "all", "b_ue%#2", wildcards=True)
    return found.select("id", "country", "program_name", "focus")


@query(
    "catalog_search_literal",
    f"""{P} SELECT id, country, program_name FROM programs
        WHERE country = 'NATION_3' AND {_search_sql('BRAND#1', SEARCHED, False)}""",
)
def catalog_search_literal(spark, d):
    found = catalog_query(frame(spark, d, PROGRAMS), "NATION_3", "BRAND#1")
    return found.select("id", "country", "program_name")


@query(
    "browse_named_programs",
    f"""{P} SELECT id, country, program_name FROM programs
        WHERE {filled('program_name')} AND {_search_sql('promo', SEARCHED, False)}""",
)
def browse_named_programs(spark, d):
    return browse(frame(spark, d, PROGRAMS), "all", "promo", "country").select(
        "id", "country", "program_name"
    )


@query(
    "sorted_by_name_page",
    f"""{P} SELECT id, program_name FROM programs ORDER BY program_name, id LIMIT 40 OFFSET 100""",
)
def sorted_by_name_page(spark, d):
    ordered = frame(spark, d, PROGRAMS).select("id", "program_name")
    return sorting.page(ordered, ["program_name", "id"], 100, 40)


@query(
    "sorted_by_name_deep_page",
    f"""{P} SELECT id, program_name FROM programs ORDER BY program_name NULLS FIRST, id
        LIMIT 100 OFFSET (SELECT count(*) // 2 FROM programs)""",
)
def sorted_by_name_deep_page(spark, d):
    ordered = frame(spark, d, PROGRAMS).select("id", "program_name")
    return sorting.page(ordered, ["program_name", "id"], ordered.count() // 2, 100, front=0)


@query(
    "sorted_by_country_top",
    f"""{P} SELECT id, country, program_name FROM programs
        ORDER BY country, program_name, id LIMIT 100""",
)
def sorted_by_country_top(spark, d):
    ordered = sorting.sort_catalog(frame(spark, d, PROGRAMS), "country")
    return ordered.select("id", "country", "program_name").limit(100)


@query(
    "sorted_by_country",
    f"""{P} SELECT id, country, program_name FROM programs""",
)
def sorted_by_country(spark, d):
    ordered = sorting.sort_catalog(frame(spark, d, PROGRAMS), "country")
    return ordered.select("id", "country", "program_name")


@query(
    "sorted_by_deadline_text_top",
    f"""{P} SELECT id, {first_filled('closing_date', 'application_deadline')} AS deadline
        FROM programs ORDER BY 2 NULLS LAST, id LIMIT 200""",
)
def sorted_by_deadline_text_top(spark, d):
    ordered = sorting.sort_catalog(frame(spark, d, PROGRAMS), "deadline", mode="text")
    return ordered.select("id", cols.deadline_column().alias("deadline")).limit(200)


@query(
    "sorted_by_deadline_text",
    f"""{P} SELECT id, {first_filled('closing_date', 'application_deadline')} AS deadline
        FROM programs""",
)
def sorted_by_deadline_text(spark, d):
    ordered = sorting.sort_catalog(frame(spark, d, PROGRAMS), "deadline", mode="text")
    return ordered.select("id", cols.deadline_column().alias("deadline"))


_DATE = """CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast({0} AS DATE)
 WHEN regexp_matches({0}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$')
 THEN try_cast(substr({0}, 7, 4) || '-' || substr({0}, 4, 2) || '-' || substr({0}, 1, 2) AS DATE) END"""


@query(
    "sorted_by_deadline_top",
    f"""{P}, t AS (SELECT id, {first_filled('closing_date', 'application_deadline')} AS deadline FROM programs)
        SELECT id, deadline FROM t
        ORDER BY deadline IS NULL, {_DATE.format('deadline')} NULLS LAST, deadline NULLS LAST, id LIMIT 300""",
)
def sorted_by_deadline_top(spark, d):
    ordered = sorting.sort_catalog(frame(spark, d, PROGRAMS), "deadline")
    return ordered.select("id", cols.deadline_column().alias("deadline")).limit(300)


@query(
    "sorted_by_deadline",
    f"""{P}, t AS (SELECT id, {first_filled('closing_date', 'application_deadline')} AS deadline FROM programs)
        SELECT id, deadline FROM t""",
)
def sorted_by_deadline(spark, d):
    ordered = sorting.sort_catalog(frame(spark, d, PROGRAMS), "deadline")
    return ordered.select("id", cols.deadline_column().alias("deadline"))


def _named_pages(spark, d):
    return load(spark, d, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("country"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("program_name"),
    )


@query("sorted_locale_aware_top")
def sorted_locale_aware_top(spark, d):
    return sorting.sort_catalog(_named_pages(spark, d), "name", locale=True).limit(100)


@query(
    "sorted_locale_aware",
    """SELECT page_id AS id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS country, regexp_extract(html, '<title>(.*?)</title>', 1) AS program_name FROM pages""",
)
def sorted_locale_aware(spark, d):
    return sorting.sort_catalog(_named_pages(spark, d), "name", locale=True)


@query("sorted_unknown_mode", f"{P} SELECT id, country, program_name FROM programs")
def sorted_unknown_mode(spark, d):
    return sorting.sort_catalog(frame(spark, d, PROGRAMS), "newest").select("id", "country", "program_name")


@query(
    "page_after_key",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50",
)
def page_after_key(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sorting.page_after(orders, "o_orderkey", 1000, 50)


@query(
    "drop_blank_names",
    f"""{P} SELECT id, program_name FROM programs WHERE {filled(trim('program_name'))}""",
)
def drop_blank_names(spark, d):
    return filters.drop_blank(frame(spark, d, PROGRAMS), "program_name").select("id", "program_name")


@query(
    "with_any_deadline",
    f"""{P} SELECT id FROM programs WHERE {filled('closing_date')} OR {filled('application_deadline')}""",
)
def with_any_deadline(spark, d):
    return filters.filter_any_filled(
        frame(spark, d, PROGRAMS), ["closing_date", "application_deadline"]
    ).select("id")


@query("get_program_by_id", f"""{P} SELECT * FROM programs WHERE id = 'P000000042'""")
def get_program_by_id(spark, d):
    return filters.get_by_id(frame(spark, d, PROGRAMS), "id", "P000000042")


_UUIDISH = """CASE WHEN event_id % 3 = 0 THEN md5(cast(event_id AS STRING))
 ELSE concat_ws('-', substr(md5(cast(event_id AS STRING)), 1, 8), substr(md5(cast(event_id AS STRING)), 9, 4),
 substr(md5(cast(event_id AS STRING)), 13, 4), substr(md5(cast(event_id AS STRING)), 17, 4),
 substr(md5(cast(event_id AS STRING)), 21, 12)) END"""


@query(
    "uuid_guard",
    f"""SELECT event_id, regexp_matches(u, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS ok
        FROM (SELECT event_id, {_UUIDISH} AS u FROM events)""",
)
def uuid_guard(spark, d):
    keyed = frame(spark, d, f"SELECT event_id, {_UUIDISH} AS u FROM {{events}}")
    return keyed.select("event_id", is_uuid("u").alias("ok"))


@query(
    "children_of_program",
    f"""{cte(program_docs=PROGRAM_DOCS)} SELECT doc_id, doc_type, display_name FROM program_docs
        WHERE program_id = 'P000000010' ORDER BY doc_type, display_name, doc_id""",
)
def children_of_program(spark, d):
    docs = frame(spark, d, PROGRAM_DOCS)
    found = filters.children_of(docs, "P000000010", ["doc_type", "display_name", "doc_id"])
    return found.select("doc_id", "doc_type", "display_name")


@query("phone_lengths", "SELECT o_orderkey, o_orderkey >= 100 AS phone FROM orders")
def phone_lengths(spark, d):
    phone = F.concat(F.lit("555-123"), F.col("o_orderkey").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", valid_phone(phone).alias("phone"))


@query(
    "contact_predicates",
    r"""SELECT doc_id, regexp_matches(text, '\S+@\S+\.\S+') AS email, length(source || lang) >= 10 AS phone
        FROM documents""",
)
def contact_predicates(spark, d):
    docs = load(spark, d, "documents")
    return docs.select(
        "doc_id",
        has_email("text").alias("email"),
        valid_phone(F.concat("source", "lang")).alias("phone"),
    )


@query(
    "contact_addresses",
    r"""SELECT c_custkey, regexp_matches(a, '\S+@\S+\.\S+') AS email FROM (
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@example.org'
        WHEN c_custkey % 3 = 1 THEN c_name || '@host' ELSE c_name END AS a FROM customer)""",
)
def contact_addresses(spark, d):
    rows = frame(
        spark,
        d,
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@example.org' "
        "WHEN c_custkey % 3 = 1 THEN c_name || '@host' ELSE c_name END AS a FROM {customer}",
    )
    return rows.select("c_custkey", has_email("a").alias("email"))


@query(
    "include_any_terms",
    """SELECT doc_id FROM documents WHERE """
    + " OR ".join(f"contains(lower(text), '{t}')" for t in ("ingreat", "lichkeit", "ciónmente", "aux la")),
)
def include_any_terms(spark, d):
    docs = load(spark, d, "documents")
    return filters.include_any(docs, ["text"], ["ingreat", "Lichkeit", "CIÓNmente", "aux la"]).select("doc_id")


@query(
    "filter_in_list",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def filter_in_list(spark, d):
    orders = load(spark, d, "orders")
    return filters.filter_in(orders, "o_orderpriority", "1-URGENT|2-HIGH").select(
        "o_orderkey", "o_orderpriority"
    )


@query(
    "filter_in_array",
    """SELECT p_partkey FROM part WHERE p_name LIKE 'blue %' OR p_name LIKE '% bolt' OR p_name LIKE 'bolt %' OR p_name LIKE '% blue'""",
)
def filter_in_array(spark, d):
    words = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return filters.filter_in(words, "words", "blue|bolt").select("p_partkey")


@query(
    "where_all_rules",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
       WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_discount <= 0.02""",
)
def where_all_rules(spark, d):
    rules = [
        {"field": "l_returnflag", "eq": "R"},
        {"field": "l_quantity", "gt": 45},
        {"field": "l_discount", "le": 0.02},
    ]
    return filters.where_all(load(spark, d, "lineitem"), rules).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )


@query(
    "over_threshold",
    """SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000
       AND date_diff('day', DATE '1998-01-01', cast(o_orderdate AS DATE)) BETWEEN 0 AND 21""",
)
def over_threshold(spark, d):
    return filters.over_threshold(
        load(spark, d, "orders"), "o_totalprice", 200000, "o_orderdate", "1998-01-01", 21
    ).select("o_orderkey")


_PACKED = "concat(p_name, '; ', lower(p_type), ' ;', p_brand)"


@query(
    "facet_in_packed_list",
    "SELECT p_partkey FROM part WHERE p_name = 'promo' OR lower(p_type) = 'promo'",
)
def facet_in_packed_list(spark, d):
    packed = frame(spark, d, f"SELECT p_partkey, {_PACKED} AS tags FROM {{part}}")
    return filters.facet_in_list(packed, "tags", "promo").select("p_partkey")


@query(
    "display_fields",
    f"""{P} SELECT id, {first_filled('closing_date', 'application_deadline', default='Ongoing')} AS deadline,
        CASE WHEN {filled('key_objectives')} THEN 'Key Objectives' WHEN {filled('focus')} THEN 'Focus' END AS label,
        {first_filled('key_objectives', 'focus')} AS objectives,
        {first_filled('eligibility_cutoffs', 'cutoffs_caps', 'acreage_production_limit')} AS eligibility,
        {filled('budget_exhaustion_marker')} AS budget_limited,
        nullif(funding_amount, '') AS funding_amount FROM programs""",
)
def display_fields(spark, d):
    objectives = cols.objectives_column()
    programs = cols.blanks_to_null(frame(spark, d, PROGRAMS), ["funding_amount"])
    return programs.select(
        "id",
        cols.deadline_column("Ongoing").alias("deadline"),
        objectives["label"].alias("label"),
        objectives["value"].alias("objectives"),
        cols.eligibility_column().alias("eligibility"),
        cols.budget_limited().alias("budget_limited"),
        "funding_amount",
    )


@query(
    "practice_cards",
    f"""{P} SELECT id, program_name AS title, country AS category,
        {first_filled('funding_amount', default='Varies by program')} AS cost_share,
        {first_filled('payment_cap', default='Contact local office')} AS cap_range,
        {first_filled('closing_date', 'application_deadline', default='Ongoing')} AS payoff_period,
        array_to_string(['Government funding available',
          {first_filled('key_objectives', 'focus', default='Agricultural support program')},
          {first_filled('administered', default='Multiple funding sources')}], '|') AS benefits,
        array_to_string(['Application through program office',
          {first_filled('eligibility_cutoffs', default='Eligibility requirements apply')},
          {first_filled('additional_information', default='Program-specific documentation')}], '|') AS verification_notes
        FROM programs ORDER BY country, program_name, id LIMIT 12""",
)
def practice_cards(spark, d):
    cards = cols.practice_cards(frame(spark, d, PROGRAMS))
    return cards.withColumns(
        {c: F.array_join(c, "|") for c in ("benefits", "verification_notes")}
    )


_LABELS = """CASE doc_type WHEN 'guideline' THEN 'Program Guide' WHEN 'application_form' THEN 'Application Form'
 WHEN 'faq' THEN 'FAQ' WHEN 'checklist' THEN 'Checklist' WHEN 'terms' THEN 'Terms & Conditions'
 WHEN 'webpage' THEN 'Web Page' WHEN 'quick_guide' THEN 'Quick Guide' WHEN 'reference' THEN 'Reference'
 ELSE doc_type END"""


@query(
    "doc_captions_and_targets",
    f"""{cte(program_docs=PROGRAM_DOCS)} SELECT doc_id,
        {_LABELS} || CASE WHEN {filled('language')} AND language <> 'en' THEN ' · ' || upper(language) ELSE '' END AS caption,
        CASE WHEN {filled('file_slug')} THEN 'download' WHEN {filled('source_url')} THEN 'view' END AS kind,
        CASE WHEN {filled('file_slug')} THEN '/pdfs/' || file_slug WHEN {filled('source_url')} THEN source_url END AS href
        FROM program_docs""",
)
def doc_captions_and_targets(spark, d):
    target = cols.resolve_doc_target()
    return frame(spark, d, PROGRAM_DOCS).select(
        "doc_id",
        cols.doc_caption().alias("caption"),
        target["kind"].alias("kind"),
        target["href"].alias("href"),
    )


@query(
    "programs_with_documents",
    f"""{PD} SELECT id, doc_id, doc_type FROM programs LEFT JOIN program_docs ON id = program_id""",
)
def programs_with_documents(spark, d):
    joined = joins.with_documents(
        frame(spark, d, PROGRAMS).select("id"),
        frame(spark, d, PROGRAM_DOCS).select("program_id", "doc_id", "doc_type"),
    )
    return joined.select("id", "doc_id", "doc_type")


@query(
    "order_lines",
    """SELECT o_orderkey, count(l_partkey) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def order_lines(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    lines = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("program_id"), "l_partkey", "l_quantity"
    )
    return (
        joins.with_documents(orders, lines)
        .groupBy(F.col("id").alias("o_orderkey"))
        .agg(
            F.count("l_partkey").alias("lines"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        )
    )


_ATTRS = """SELECT {0} AS program_id, 'brand' AS attr_key, p_brand AS attr_value FROM {{part}} WHERE p_partkey % 4 <> 0
 UNION ALL SELECT {0}, 'size', cast(p_size AS STRING) FROM {{part}} WHERE p_partkey % 4 <> 0
 UNION ALL SELECT {0}, 'type', p_type FROM {{part}} WHERE p_partkey % 2 = 1""".format(
    "concat('P', lpad(cast(p_partkey AS STRING), 9, '0'))"
)


@query(
    "programs_with_attributes",
    f"""{cte(programs=PROGRAMS, attrs=_ATTRS)}
        SELECT id, attr_key, attr_value FROM programs LEFT JOIN attrs ON id = program_id""",
)
def programs_with_attributes(spark, d):
    joined = joins.with_attributes(
        frame(spark, d, PROGRAMS).select("id"), frame(spark, d, _ATTRS)
    )
    return joined.select("id", "attr_key", "attr_value")


@query(
    "nested_export",
    f"""{cte(programs=PROGRAMS, program_docs=PROGRAM_DOCS, attrs=_ATTRS)},
        a AS (SELECT program_id, string_agg(attr_key || '=' || attr_value, ',' ORDER BY attr_key) AS attributes FROM attrs GROUP BY 1),
        x AS (SELECT program_id, string_agg(doc_id || ':' || doc_type, ',' ORDER BY doc_id) AS documents FROM program_docs GROUP BY 1)
        SELECT id, country, 1 AS parts, coalesce(attributes, '') AS attributes, coalesce(documents, '') AS documents
        FROM programs LEFT JOIN a ON id = a.program_id LEFT JOIN x ON id = x.program_id""",
)
def nested_export(spark, d):
    docs = frame(spark, d, PROGRAM_DOCS).select("program_id", "doc_id", "doc_type")
    nested = export_nested(
        frame(spark, d, PROGRAMS).select("id", "country"), frame(spark, d, _ATTRS), docs
    )
    pairs = F.transform(
        F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    listed = F.transform("documents", lambda x: F.concat_ws(":", x["doc_id"], x["doc_type"]))
    return nested.select(
        "id",
        "country",
        "parts",
        F.array_join(pairs, ",").alias("attributes"),
        F.array_join(listed, ",").alias("documents"),
    )


@query(
    "sweep_attributes",
    f"""{P} SELECT id AS program_id, attr_key, attr_value FROM (
        UNPIVOT (SELECT id, description, hyperlink, funding_amount, payment_cap, focus FROM programs)
        ON description, hyperlink, funding_amount, payment_cap, focus INTO NAME attr_key VALUE attr_value)
        WHERE {filled('attr_value')}""",
)
def sweep_program_attributes(spark, d):
    rows = frame(spark, d, PROGRAMS).select(
        "id", "country", "program_name", "description", "hyperlink", "funding_amount",
        "payment_cap", "focus",
    )
    return sweep_attributes(rows, "id", ["country", "program_name"])


_STATUS_SQL = """CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} <= 0 THEN 'Closed' WHEN {0} <= 7 THEN 'Closing soon'
 WHEN {0} <= 14 THEN 'Due soon' ELSE 'Open' END"""


def _calendar_sql(where: str) -> str:
    deadline = first_filled("closing_date", "application_deadline", default="TBD")
    return f"""{P}, t AS (SELECT id, program_name AS program, country AS location, {deadline} AS date FROM programs
          WHERE {filled('closing_date')} OR {filled('application_deadline')}),
        u AS (SELECT *, CAST(date_diff('day', DATE '2025-04-01', {_DATE.format('date')}) AS INT) AS days_until FROM t)
        SELECT id, program, 'signup' AS type, date, location, days_until, {_STATUS_SQL.format('days_until')} AS status,
        CASE WHEN days_until <= 7 THEN 'destructive' WHEN days_until <= 14 THEN 'default' ELSE 'secondary' END AS severity,
        coalesce(days_until BETWEEN 1 AND 7, false) AS urgent, coalesce(days_until > 0, false) AS can_remind,
        CASE WHEN days_until IS NULL THEN 'unknown' WHEN days_until <= 0 THEN 'Deadline passed'
             WHEN days_until = 1 THEN '1 day remaining' ELSE days_until || ' days remaining' END AS remaining
        FROM u {where}"""


@query("deadline_calendar", _calendar_sql(""))
def calendar_all(spark, d):
    return deadline_calendar(frame(spark, d, PROGRAMS), "2025-04-01")


@query("deadline_calendar_90_days", _calendar_sql("WHERE days_until BETWEEN 0 AND 90"))
def calendar_90(spark, d):
    return deadline_calendar(frame(spark, d, PROGRAMS), "2025-04-01", horizon_days=90)


@query(
    "orders_deadline_buckets",
    f"""SELECT {_STATUS_SQL.format('d')} AS status, count(*) AS orders FROM (
        SELECT date_diff('day', DATE '1998-06-01', cast(o_orderdate AS DATE)) AS d FROM orders) GROUP BY 1""",
)
def orders_deadline_buckets(spark, d):
    days = days_until("o_orderdate", "1998-06-01")
    return (
        load(spark, d, "orders")
        .groupBy(deadline_status(days).alias("status"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
