"""Text, URL, date, money and key expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import dates, keys, money, text, urls
from harrow.operators.survivorship import url_alternates
from harrow.operators.windows import with_payload
from harrow.sources.readers import load
from registry.bindings import PROGRAMS, RECORDS, cte, frame
from registry.core import (
    bare_url,
    canonical_url,
    filled,
    first_filled,
    host,
    norm,
    query,
    stable_key,
    strip_html,
    tokens,
    trim,
)


def _heavy(spark, d, name):
    """A table for work that is heavy per row."""
    return load(spark, d, name)


_PADDED = "concat(chr(9), ' ', p_name, '-', p_brand, '-', cast(p_size AS STRING), '  ', chr(10))"


@query(
    "text_scalars",
    f"""SELECT p_partkey, {trim(_PADDED)} AS trimmed, lower(p_brand) AS folded,
        regexp_replace({trim(_PADDED)}, '^([^-]*)-', '\\1 ') AS label,
        contains({_PADDED}, 'blue') AS has_blue,
        try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS brand_no, try_cast(p_name AS BIGINT) AS name_no
        FROM part""",
)
def text_scalars(spark, d):
    rows = frame(spark, d, f"SELECT p_partkey, p_brand, p_name, {_PADDED} AS s FROM {{part}}")
    return rows.select(
        "p_partkey",
        text.trim_ws("s").alias("trimmed"),
        F.lower("p_brand").alias("folded"),
        text.type_label(text.trim_ws("s")).alias("label"),
        F.contains("s", F.lit("blue")).alias("has_blue"),
        text.parse_count(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_no"),
        text.parse_count("p_name").alias("name_no"),
    )


@query(
    "clean_html",
    f"""SELECT page_id, trim(regexp_replace({strip_html('html')}, '[\\s\\x0B\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'), ' ') AS visible FROM pages""",
)
def clean_html(spark, d):
    return _heavy(spark, d, "pages").select("page_id", text.clean_text("html").alias("visible"))


@query(
    "clean_documents",
    f"SELECT doc_id, md5({norm('text')}) AS normal_md5 FROM documents",
)
def clean_documents(spark, d):
    docs = _heavy(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.normalize_text("text")).alias("normal_md5"))


_ALIASED = """CASE {0} WHEN 'www.therti.example.org' THEN 'therti.example.org'
 WHEN 'm.ththth.example.net' THEN 'ththth.example.net' ELSE {0} END""".format(host("url"))
ALIASES = {
    "www.therti.example.org": "therti.example.org",
    "m.ththth.example.net": "ththth.example.net",
}


@query(
    "canonical_urls",
    f"""SELECT page_id, {canonical_url('url', _ALIASED)} AS canonical, {host('url')} AS host FROM pages""",
)
def canonical_urls(spark, d):
    return load(spark, d, "pages").select(
        "page_id", urls.canonical_url("url", ALIASES).alias("canonical"), urls.host("url").alias("host")
    )


@query(
    "canonical_urls_bare",
    f"SELECT page_id, {bare_url('url')} AS canonical FROM pages",
)
def canonical_urls_bare(spark, d):
    pages = load(spark, d, "pages")
    return pages.select("page_id", urls.canonical_url("url", keep_query=False).alias("canonical"))


@query(
    "canonical_urls_malformed",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN 'https://example.org:8443/x' ELSE {canonical_url('u')} END AS canonical,
          CASE WHEN o_orderkey % 7 = 6 THEN 'example.org' ELSE {host('u')} END AS host FROM (
        SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://a.example/x'
          WHEN 2 THEN ' HTTP://WWW.Example.ORG/Path/' || o_orderkey || '?utm_source=a&b=1&GCLID=2#f '
          WHEN 3 THEN 'https://example.org' WHEN 4 THEN 'not a url' WHEN 6 THEN 'https://user:pw@Example.org:8443/x' ELSE 'https://example.org/a?x&fbclid=1&&y=' END AS u FROM orders)""",
)
def canonical_urls_malformed(spark, d):
    rows = frame(
        spark,
        d,
        """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://a.example/x'
           WHEN 2 THEN ' HTTP://WWW.Example.ORG/Path/' || o_orderkey || '?utm_source=a&b=1&GCLID=2#f '
           WHEN 3 THEN 'https://example.org' WHEN 4 THEN 'not a url' WHEN 6 THEN 'https://user:pw@Example.org:8443/x' ELSE 'https://example.org/a?x&fbclid=1&&y=' END AS u
           FROM {orders}""",
    )
    return rows.select(
        "o_orderkey", urls.canonical_url("u").alias("canonical"), urls.host("u").alias("host")
    )


@query(
    "url_alternates",
    f"""SELECT DISTINCT {bare_url('url')} AS canonical, url AS alternate FROM pages
        WHERE url IS DISTINCT FROM {bare_url('url')}""",
)
def page_alternates(spark, d):
    pages = load(spark, d, "pages").select(
        "url", urls.canonical_url("url", keep_query=False).alias("canonical")
    )
    return url_alternates(pages, "canonical", "url", "canonical")


# Dates as text in several spellings, one per order.
DATE_TEXTS = """
SELECT o_orderkey, CASE o_orderkey % 7
  WHEN 0 THEN iso
  WHEN 1 THEN concat('Fri, ', dd, ' ', mon, ' ', yyyy, ' 10:30:00 GMT')
  WHEN 2 THEN concat(dd, ' ', month, ' ', yyyy)
  WHEN 3 THEN concat(month, ' ', dd, ', ', yyyy)
  WHEN 4 THEN concat(dd, '/', mm, '/', yyyy)
  WHEN 5 THEN concat('31 Feb ', yyyy)
  ELSE concat('closes ', dd, ' ', mon, ' ', yyyy, ' or later') END AS s, iso, o_orderkey % 7 AS shape, yyyy
FROM (SELECT o_orderkey, iso, substr(iso, 1, 4) AS yyyy, substr(iso, 6, 2) AS mm, substr(iso, 9, 2) AS dd,
        CASE substr(iso, 6, 2) WHEN '01' THEN 'Jan' WHEN '02' THEN 'Feb' WHEN '03' THEN 'Mar' WHEN '04' THEN 'Apr'
          WHEN '05' THEN 'May' WHEN '06' THEN 'Jun' WHEN '07' THEN 'Jul' WHEN '08' THEN 'Aug' WHEN '09' THEN 'Sep'
          WHEN '10' THEN 'Oct' WHEN '11' THEN 'Nov' ELSE 'Dec' END AS mon,
        CASE substr(iso, 6, 2) WHEN '01' THEN 'January' WHEN '02' THEN 'February' WHEN '03' THEN 'March'
          WHEN '04' THEN 'April' WHEN '05' THEN 'May' WHEN '06' THEN 'June' WHEN '07' THEN 'July'
          WHEN '08' THEN 'August' WHEN '09' THEN 'September' WHEN '10' THEN 'October'
          WHEN '11' THEN 'November' ELSE 'December' END AS month
      FROM (SELECT o_orderkey, cast(cast(o_orderdate AS DATE) AS STRING) AS iso FROM {orders}))
"""


@query(
    "iso_dates",
    f"{cte(t=DATE_TEXTS)} SELECT o_orderkey, CASE WHEN shape <= 4 THEN iso END AS iso_date FROM t",
)
def iso_dates(spark, d):
    rows = frame(spark, d, DATE_TEXTS)
    return rows.select("o_orderkey", dates.to_iso_date("s").alias("iso_date"))


@query(
    "publish_instants",
    f"""{cte(t=DATE_TEXTS)} SELECT o_orderkey, CASE WHEN shape = 1 THEN epoch_us(CAST(iso || ' 10:30:00' AS TIMESTAMP))
        WHEN shape <= 4 THEN epoch_us(CAST(iso AS TIMESTAMP)) END AS micros FROM t""",
)
def publish_instants(spark, d):
    rows = frame(spark, d, DATE_TEXTS)
    return rows.select("o_orderkey", F.unix_micros(dates.parse_timestamp("s")).alias("micros"))


@query(
    "deadline_text",
    f"""{cte(t=DATE_TEXTS)} SELECT o_orderkey,
        nullif(regexp_extract(s, '(\\d{{1,2}}\\s+[A-Za-z]{{3,9}}\\s+\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS deadline FROM t""",
)
def deadline_text(spark, d):
    rows = frame(spark, d, DATE_TEXTS)
    return rows.select("o_orderkey", dates.extract_date_text("s").alias("deadline"))


@query(
    "event_times",
    """SELECT o_orderkey, epoch_us(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY END, TIMESTAMP '2020-01-01')) AS micros FROM orders""",
)
def event_times(spark, d):
    orders = load(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("published"),
        F.when(F.col("o_orderkey") % 5 == 0, F.expr("o_orderdate + INTERVAL 1 DAY")).alias("page"),
        F.lit("2020-01-01").cast("timestamp").alias("ingested"),
    )
    when = dates.event_time("published", "page", "ingested")
    return orders.select("o_orderkey", F.unix_micros(when).alias("micros"))


def _money_sql(c: str) -> str:
    return f"try_cast(regexp_replace({c}, '[\\$,\\s]', '', 'g') AS DECIMAL(18,2))"


_AMOUNT = "(\\$?\\s*[0-9][0-9,\\.]{2,})"


@query(
    "funding_amounts",
    f"""{cte(records=RECORDS)} SELECT id,
        CAST({_money_sql(f"regexp_extract(funding_text, '{_AMOUNT}', 1)")} AS DOUBLE) AS first_amount,
        CAST(list_max(list_transform(regexp_extract_all(funding_text, '{_AMOUNT}', 1), lambda x: {_money_sql('x')})) AS DOUBLE) AS max_amount
        FROM records""",
)
def funding_amounts(spark, d):
    return frame(spark, d, RECORDS).select(
        "id",
        money.extract_amount("funding_text", "first").cast("double").alias("first_amount"),
        money.extract_amount("funding_text", "max").cast("double").alias("max_amount"),
    )


# What is read follows from how the text is made: the price where it carries a mark, else the year.
@query(
    "amounts_beside_years",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)
         WHEN 1 THEN greatest(500.0, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) ELSE 2025.0 END AS amount FROM orders""",
)
def amounts_beside_years(spark, d):
    made = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('Round 2025: up to $', price, ' for 99999999 places')
         WHEN 1 THEN concat('In 2024 from NZ$500 to NZ$ ', price) ELSE concat('Round 2025, about ', price) END AS told
       FROM (SELECT o_orderkey, cast(cast(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price FROM {orders})"""
    return frame(spark, d, made).select("o_orderkey", money.extract_amount("told").cast("double").alias("amount"))


@query(
    "normalized_money",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS brl,
       CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS DOUBLE) AS whole, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS usd FROM orders""",
)
def normalized_money(spark, d):
    texts = load(spark, d, "orders").select(
        "o_orderkey",
        F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("us"),
    )
    swapped = F.concat(F.lit("R$ "), F.translate("us", ",.", ".,"))
    return texts.select(
        "o_orderkey",
        money.normalize_money(swapped, "pt-BR", 2).cast("double").alias("brl"),
        money.normalize_money(swapped, "es-CL", 0).cast("double").alias("whole"),
        money.normalize_money(F.concat(F.lit("$"), "us"), "en-US", 2).cast("double").alias("usd"),
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", keys.content_hash("text").alias("sha256"))


@query(
    "stable_keys",
    f"""{cte(programs=PROGRAMS)} SELECT id, {stable_key('country', 'program_name', 'focus')} AS stable_key FROM programs""",
)
def stable_keys(spark, d):
    return frame(spark, d, PROGRAMS).select(
        "id", keys.stable_key("country", "program_name", "focus").alias("stable_key")
    )


_KEYED = """
SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN concat(' G', cast(page_id AS STRING)) WHEN page_id % 3 = 1 THEN '' END AS guid,
  CASE WHEN page_id % 10 = 9 THEN NULL ELSE url END AS link,
  CASE WHEN page_id % 10 = 9 THEN NULL ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS title FROM {pages}
"""


@query(
    "primary_keys",
    f"""{cte(t=_KEYED)} SELECT page_id, coalesce(nullif({trim('guid')}, ''),
        CASE WHEN link IS NOT NULL OR title IS NOT NULL THEN sha1(coalesce({canonical_url('link')}, '') || '|' || coalesce({norm('title')}, '')) END,
        'row:' || page_id) AS primary_key,
        CASE WHEN title IS NOT NULL THEN sha1({norm('title')}) END AS secondary_key FROM t""",
)
def primary_keys(spark, d):
    return frame(spark, d, _KEYED).select(
        "page_id",
        keys.primary_key(["guid"], {"link": "url", "title": "text"}, "page_id").alias("primary_key"),
        keys.composite_key({"title": "text"}).alias("secondary_key"),
    )


@query(
    "bucketed_keys",
    """SELECT user_id, cast(cast(ts AS DATE) AS VARCHAR) AS day, count(*) AS items FROM events GROUP BY 1, 2""",
)
def bucketed_keys(spark, d):
    bucket = keys.bucketed_key("user_id", "ts")
    return (
        load(spark, d, "events")
        .groupBy(bucket.alias("b"))
        .agg(F.count(F.lit(1)).alias("items"))
        .select(F.col("b.key").alias("user_id"), F.col("b.day").cast("string").alias("day"), "items")
    )


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-\\z', '', 'g')"


@query(
    "slug_ids",
    f"""SELECT doc_id, concat_ws('-', 'CA', upper(lang), nullif({_SLUG.format('text')}, '')) AS slug_id,
        regexp_replace(lower(source || ' ' || lang), '[ \\t]+', '-', 'g') AS test_id FROM documents""",
)
def slug_ids(spark, d):
    docs = _heavy(spark, d, "documents")
    return docs.select(
        "doc_id",
        keys.slug_id(F.lit("CA"), F.upper("lang"), "text").alias("slug_id"),
        text.dash_spaces(F.concat_ws(" ", "source", "lang")).alias("test_id"),
    )


_SECTION = "concat('Intro. Eligibility: ', p_name, chr(10), p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE chr(10) END, chr(10), 'rest')"


@query(
    "eligibility_sections",
    f"""SELECT p_partkey, nullif(regexp_extract({_SECTION}, '(?is)(Eligibility|Who can apply|Eligible)(.*?)\\n\\n', 2), '') AS section FROM part""",
)
def eligibility_sections(spark, d):
    rows = frame(spark, d, f"SELECT p_partkey, {_SECTION} AS s FROM {{part}}")
    return rows.select("p_partkey", text.extract_section("s").alias("section"))


@query(
    "payload_snapshots",
    """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","c_custkey":' || c_custkey || '}' AS payload,
       c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def payload_snapshots(spark, d):
    joined = load(spark, d, "customer").join(
        load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return with_payload(joined.select("n_nationkey", "n_name", "c_custkey")).select(
        "n_nationkey", "payload", "c_custkey"
    )


@query(
    "distinct_words",
    f"""SELECT doc_id, len({tokens('text')}) AS words FROM documents""",
)
def distinct_words(spark, d):
    return _heavy(spark, d, "documents").select("doc_id", F.size(text.tokens("text")).cast("bigint").alias("words"))


@query(
    "first_filled_default",
    f"""{cte(programs=PROGRAMS)} SELECT id, {first_filled('payment_cap', 'cutoffs_caps', default='none')} AS cap,
        {filled('focus')} AS has_focus FROM programs""",
)
def first_filled_default(spark, d):
    return frame(spark, d, PROGRAMS).select(
        "id",
        text.first_filled("payment_cap", "cutoffs_caps", default="none").alias("cap"),
        text.filled("focus").alias("has_focus"),
    )
