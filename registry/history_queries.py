"""Latest versions, history, rolling measures and key-set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import reshape, windows
from harrow.operators.columns import project, rename_map
from harrow.sources.readers import load
from registry.bindings import CALLS, PROGRAMS, RECORDS, cte, frame
from registry.core import edits, micros, query


@query(
    "keep_latest",
    """SELECT user_id, event_id, event_type, epoch_us(ts) AS micros FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""",
)
def keep_latest(spark, d):
    latest = windows.keep_latest(load(spark, d, "events"), "user_id", ["ts"], "event_id")
    return latest.select("user_id", "event_id", "event_type", micros("ts").alias("micros"))


@query(
    "collapse_by_second_id",
    f"""{cte(records=RECORDS)} SELECT id, rfx_id FROM records WHERE rfx_id IS NULL UNION ALL
        (SELECT id, rfx_id FROM records WHERE rfx_id IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY rfx_id ORDER BY published_at DESC, close_date DESC NULLS LAST, id) = 1)""",
)
def collapse_by_second_id(spark, d):
    records = frame(spark, d, RECORDS)
    out = windows.collapse_by(records, "rfx_id", ["published_at", "close_date"], "id")
    return out.select("id", "rfx_id")


@query(
    "mark_superseded",
    """WITH n AS (SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS newest FROM orders)
       SELECT o_orderkey, nullif(newest, o_orderkey) AS superseded_by FROM n""",
)
def mark_superseded(spark, d):
    out = windows.mark_superseded(load(spark, d, "orders"), "o_custkey", ["o_orderdate"], "o_orderkey")
    return out.select("o_orderkey", "superseded_by")


@query(
    "diff_history",
    """WITH p AS (SELECT user_id, ts, event_id, event_type, round(value) AS whole, lag(event_type) OVER w AS pt,
          lag(round(value)) OVER w AS pv, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT user_id, event_id, 'event_type' AS field, pt AS old_value, event_type AS new_value FROM p WHERE n > 1 AND pt IS DISTINCT FROM event_type
       UNION ALL SELECT user_id, event_id, 'whole', cast(cast(pv AS BIGINT) AS VARCHAR), cast(cast(whole AS BIGINT) AS VARCHAR) FROM p
       WHERE n > 1 AND pv IS DISTINCT FROM whole""",
)
def diff_history(spark, d):
    events = load(spark, d, "events").withColumn("whole", F.round("value").cast("bigint"))
    out = windows.diff_history(events, "user_id", ["ts", "event_id"], ["event_type", "whole"])
    return out.select("user_id", "event_id", "field", "old_value", "new_value")


@query(
    "changed_snapshots",
    f"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS cur, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
       SELECT conv_id, turn FROM p WHERE prev IS NOT NULL AND {edits('cur', 'prev')} >= 200""",
)
def changed_snapshots(spark, d):
    turns = load(spark, d, "conversations").withColumn(
        "seen_at", F.timestamp_seconds(F.col("turn") * 60)
    )
    out = windows.changed_snapshots(turns, "conv_id", ["seen_at", "turn"], "text", 200)
    return out.select("conv_id", "turn")


@query(
    "changed_pages",
    f"""WITH p AS (SELECT page_id, html AS cur, lag(html) OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1) ORDER BY page_id) AS prev FROM pages)
       SELECT page_id FROM p WHERE prev IS NOT NULL AND cur <> prev AND (abs(length(cur) - length(prev)) >= 200 OR {edits('cur', 'prev')} >= 200)""",
)
def changed_pages(spark, d):
    pages = load(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("url", "://([^/]*)", 1).alias("site"),
        F.timestamp_seconds("page_id").alias("seen_at"),
        "html",
    )
    return windows.changed_snapshots(pages, "site", ["seen_at", "page_id"], "html").select("page_id")


@query(
    "rolling_failure_rate",
    f"""{cte(calls=CALLS)} SELECT event_id, round(avg(CAST(failed AS INT)) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS 19 PRECEDING), 6) AS failure_rate FROM calls""",
)
def rolling_failure_rate(spark, d):
    calls = frame(spark, d, CALLS)
    out = windows.rolling_failure_rate(calls, "domain", ["ts", "event_id"], "failed")
    return out.select("event_id", "failure_rate")


@query(
    "retain_history",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY",
)
def retain_history(spark, d):
    return windows.retain(load(spark, d, "orders"), "o_orderdate", "2001-08-02").select("o_orderkey")


@query(
    "dedupe_exact",
    "SELECT min(doc_id) AS doc_id, lang, sha256(text) AS text_hash FROM documents GROUP BY lang, text",
)
def dedupe_exact(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))
    return reshape.dedupe(docs, ["lang", "text_hash"], ["doc_id"])


@query(
    "reconcile_labels",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'active_only' WHEN a.doc_id IS NULL THEN 'allowed_only' ELSE 'both' END AS side
       FROM (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""",
)
def reconcile_labels(spark, d):
    active = load(spark, d, "documents").filter("n_chars > 1000")
    return reshape.reconcile(active, load(spark, d, "labels"), ["doc_id"])


@query(
    "union_sources",
    """SELECT 'customer' AS source_sheet, c_name AS program_name, c_mktsegment AS focus, c_acctbal AS amount FROM customer
       UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT 'part', p_name, NULL, NULL FROM part""",
)
def union_sources(spark, d):
    c = load(spark, d, "customer").selectExpr(
        "'customer' AS source_sheet", "c_name AS program_name", "c_mktsegment AS focus", "c_acctbal AS amount"
    )
    s = load(spark, d, "supplier").selectExpr(
        "'supplier' AS source_sheet", "s_name AS program_name", "s_acctbal AS amount"
    )
    p = load(spark, d, "part").selectExpr("'part' AS source_sheet", "p_name AS program_name")
    return reshape.union_sources([c, s, p])


@query(
    "pivot_attributes",
    """SELECT 'C' || c_custkey AS program_id, c_mktsegment AS segment, c_name AS name, NULL AS absent FROM customer""",
)
def pivot_attributes(spark, d):
    wide = load(spark, d, "customer").selectExpr(
        "'C' || c_custkey AS id", "c_mktsegment AS segment", "c_name AS name"
    )
    long = reshape.sweep_attributes(wide, "id", [])
    return reshape.pivot_attributes(long, ["segment", "name", "absent"])


_TAGS = "concat(p_name, ' ;', p_brand, '; ;', lower(p_type), ';')"


@query(
    "split_list_items",
    """SELECT p_partkey, CAST(i AS INT) AS number, [p_name, p_brand, lower(p_type)][i] AS item FROM part, range(1, 4) t(i)""",
)
def split_list_items(spark, d):
    packed = frame(spark, d, f"SELECT p_partkey, {_TAGS} AS tags FROM {{part}}")
    return reshape.number_items(reshape.split_lists(packed, ["tags"]), "tags", ["p_partkey"])


@query(
    "rename_and_project",
    f"""{cte(programs=PROGRAMS)} SELECT program_name AS title, hyperlink AS href, country AS region FROM programs""",
)
def rename_and_project(spark, d):
    names = {"title": "program_name", "href": "hyperlink", "region": "country"}
    return project(rename_map(frame(spark, d, PROGRAMS), names), ["title", "href", "region"])
