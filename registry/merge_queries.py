"""Clusters, survivorship and the merge of several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.keys import primary_key
from harrow.functions.urls import host
from harrow.operators.clusters import connected_components, with_clusters
from harrow.operators.fuzzy import match_edges
from harrow.operators.survivorship import source_rank, survive
from harrow.plans.merge import Policy, latest_publish_wins, merge_sources
from harrow.plans.policies import POLICIES
from harrow.sources.readers import load
from registry.bindings import cte, frame
from registry.core import canonical_url as canonical_sql
from registry.core import host as host_sql
from registry.core import edits, micros, norm, query, strip_html

# Records of three sources merged by the customer they belong to.
SOURCED = """
SELECT o_orderkey AS record_id, o_custkey AS cluster,
  CASE o_orderkey % 4 WHEN 0 THEN 'gets_tender' WHEN 1 THEN 'mpi_rss' WHEN 2 THEN 'beehive_rss' ELSE 'elsewhere' END AS source,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS published_at,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL ELSE concat('Title ', cast(o_orderkey AS STRING)) END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_totalprice AS DECIMAL(18,2)) END AS amount,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('<p>', o_orderpriority, '</p><br><br><br><br>') WHEN o_orderkey % 6 = 1 THEN concat('Order of priority ', o_orderpriority) END AS description,
  concat('https://example.org/', CASE WHEN o_orderkey % 2 = 0 THEN 'a/b/' ELSE '' END, cast(o_orderkey AS STRING)) AS link,
  o_orderdate AS close_date, o_orderpriority AS tag, o_orderstatus AS status
FROM {orders}
"""
_RANK = "CASE source WHEN 'gets_tender' THEN 0 WHEN 'mpi_rss' THEN 1 WHEN 'beehive_rss' THEN 2 ELSE 1000000 END"


def _sourced(spark, d):
    rows = frame(spark, d, SOURCED).withColumn("rank", source_rank("source", POLICIES["NZ"].precedence))
    return rows.withColumn("tags", F.array("tag"))


def _pick(value: str, where: str, order: str) -> str:
    return f"first({value} ORDER BY {order}) FILTER (WHERE {where})"


_DEPTH = "length(regexp_replace(link, '[^/]', '', 'g'))"


@query(
    "survive_by_precedence",
    f"""{cte(s=SOURCED)}, r AS (SELECT *, {_RANK} AS rank, {strip_html('description')} AS seen FROM s)
        SELECT cluster, count(*) AS n_records,
        {_pick('title', "coalesce(title, '') <> ''", 'rank, published_at IS NULL, published_at DESC, record_id')} AS title,
        epoch_us({_pick('published_at', 'published_at IS NOT NULL', 'rank, published_at, record_id')}) AS published_at,
        epoch_us(min(close_date)) AS close_date,
        CAST({_pick('amount', 'amount IS NOT NULL', 'rank, amount DESC, record_id')} AS DOUBLE) AS amount,
        {_pick('link', 'true', f'{_DEPTH} DESC, length(link) DESC, link')} AS link,
        {_pick('description', "coalesce(description, '') <> ''", 'rank, length(seen) DESC, record_id')} AS description,
        {_pick('status', 'true', 'rank, record_id')} AS status,
        string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM r GROUP BY cluster""",
)
def survive_by_precedence(spark, d):
    rules = {
        "title": "latest_by_precedence",
        "published_at": "earliest_by_precedence",
        "close_date": "earliest_non_null",
        "amount": "max_by_precedence",
        "link": "prefer_deepest_path",
        "description": "richest_html_by_precedence",
        "status": "first_non_null_by_precedence",
        "tags": "union_unique",
    }
    out = survive(_sourced(spark, d), "cluster", rules)
    return out.withColumns(
        {
            "published_at": micros("published_at"),
            "close_date": micros("close_date"),
            "amount": F.col("amount").cast("double"),
            "tags": F.array_join("tags", "|"),
        }
    )


@query(
    "survive_by_date",
    f"""{cte(s=SOURCED)}, r AS (SELECT *, {_RANK} AS rank, {strip_html('description')} AS seen FROM s)
        SELECT cluster, count(*) AS n_records,
        {_pick('title', "coalesce(title, '') <> ''", 'published_at IS NULL, published_at DESC, rank, record_id')} AS title,
        CAST({_pick('amount', 'amount IS NOT NULL', 'published_at IS NULL, published_at DESC, amount DESC, record_id')} AS DOUBLE) AS amount,
        {_pick('description', "coalesce(description, '') <> ''", 'published_at IS NULL, published_at DESC, length(seen) DESC, record_id')} AS description,
        epoch_us(max(close_date)) AS close_date,
        {_pick('tag', 'true', 'rank, length(tag) DESC, tag')} AS tag,
        {_pick('status', "source IN ('beehive_rss', 'elsewhere')", "source <> 'beehive_rss', published_at IS NULL, published_at, record_id")} AS status
        FROM r GROUP BY cluster""",
)
def survive_by_date(spark, d):
    rules = {
        "title": "latest_by_date",
        "amount": "max_by_date",
        "description": "richest_html_by_date",
        "close_date": "latest_crawl",
        "tag": "longest_by_precedence",
        "status": ["beehive_rss", "elsewhere"],
    }
    out = survive(_sourced(spark, d), "cluster", rules)
    return out.withColumns(
        {"amount": F.col("amount").cast("double"), "close_date": micros("close_date")}
    )


@query(
    "latest_publish_wins",
    f"""{cte(s=SOURCED)} SELECT record_id, nullif(first_value(record_id) OVER (PARTITION BY cluster ORDER BY published_at IS NULL, published_at DESC, record_id), record_id) AS superseded_by FROM s""",
)
def superseded_records(spark, d):
    _, marked = latest_publish_wins(_sourced(spark, d), "cluster", {"title": "latest_by_date"})
    return marked.select("record_id", "superseded_by")


_PAGES = """
SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM {pages}
"""
_NODES = f"""{cte(p=_PAGES)}, n AS (SELECT page_id, {norm('title')} AS t, {host_sql('url')} AS host FROM p),
 e AS (SELECT a.page_id AS u, b.page_id AS v FROM n a JOIN n b ON a.host = b.host AND a.page_id <> b.page_id
   AND a.t <> '' AND b.t <> '' AND {edits('a.t', 'b.t')} * 1000 <= 140 * greatest(length(a.t), length(b.t)))
"""
_CLOSURE = _NODES.replace("WITH ", "WITH RECURSIVE ", 1) + """, reach(id, other) AS (
 SELECT page_id, page_id FROM n UNION SELECT r.id, e.v FROM reach r JOIN e ON e.u = r.other)
"""


@query("title_clusters", _CLOSURE + "SELECT id AS page_id, min(other) AS cluster FROM reach GROUP BY 1")
def title_clusters(spark, d):
    pages = frame(spark, d, _PAGES).withColumn("host", host("url"))
    links = match_edges(pages, "page_id", "title", ["host"], 0.86)
    return with_clusters(pages, "page_id", links).select("page_id", "cluster")


@query(
    "shared_key_clusters",
    """WITH RECURSIVE link AS (SELECT DISTINCT o_custkey AS u, 1000000 + l_suppkey * 1000 + l_linenumber AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey
         WHERE o_orderpriority = '1-URGENT' AND l_quantity > 49 AND l_returnflag = 'A'),
       e AS (SELECT u, v FROM link UNION SELECT v, u FROM link), reach(id, other) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM reach r JOIN e ON e.u = r.other)
       SELECT id, min(other) AS cluster FROM reach GROUP BY 1""",
)
def shared_key_clusters(spark, d):
    orders = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    lines = load(spark, d, "lineitem").filter("l_quantity > 49 AND l_returnflag = 'A'")
    links = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("u"),
        (F.col("l_suppkey") * 1000 + F.col("l_linenumber") + 1000000).alias("v"),
    )
    return connected_components(links)


# Two feeds over the pages: the pages themselves, and notices naming some of them by number.
_FEED = """
SELECT concat('p', lpad(cast(page_id AS STRING), 9, '0')) AS record_id, 'mpi_rss' AS source, '' AS guid, cast(page_id AS STRING) AS number,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS link, timestamp '2024-01-01 00:00:00' AS published_at,
  cast(page_id AS DECIMAL(18,2)) AS amount FROM {pages}
"""
_NOTICES = """
SELECT concat('q', lpad(cast(page_id AS STRING), 9, '0')) AS record_id, 'gets_tender' AS source, concat('g', cast(page_id AS STRING)) AS guid, '' AS number,
  concat('Notice ', md5(cast(page_id AS STRING))) AS title, concat('https://tenders.example.org/detail?id=RFX', cast(page_id AS STRING)) AS link,
  timestamp '2024-02-01 00:00:00' AS published_at, cast(NULL AS DECIMAL(18,2)) AS amount FROM {pages} WHERE url LIKE '%.com%'
"""

_MERGE_CTE = f"""{cte(feed=_FEED, notices=_NOTICES).replace('WITH ', 'WITH RECURSIVE ', 1)},
 recs AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY published_at DESC, record_id) AS rn FROM (
   SELECT *, coalesce(nullif(guid, ''), sha1({canonical_sql('link')} || '|' || {norm('title')})) AS key FROM (SELECT * FROM feed UNION ALL SELECT * FROM notices))),
 r AS (SELECT *, {norm('title')} AS t, {host_sql('link')} AS host, nullif(regexp_extract(link, 'id=RFX(\\d+)', 1), '') AS ref,
   CASE source WHEN 'gets_tender' THEN 0 ELSE 1 END AS rank FROM recs WHERE rn = 1),
 pairs AS (SELECT a.record_id AS u, b.record_id AS v FROM r a JOIN r b ON a.host = b.host AND a.record_id <> b.record_id AND a.t <> '' AND b.t <> ''
     AND {edits('a.t', 'b.t')} * 1000 <= 140 * greatest(length(a.t), length(b.t))
   UNION SELECT a.record_id, b.record_id FROM r a JOIN r b ON a.ref = b.number AND a.record_id <> b.record_id),
 e AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
 reach(id, other) AS (SELECT record_id, record_id FROM r UNION SELECT x.id, e.v FROM reach x JOIN e ON e.u = x.other),
 c AS (SELECT id, min(other) AS cluster FROM reach GROUP BY 1)
"""


@query(
    "merge_sources",
    _MERGE_CTE
    + f"""SELECT cluster, count(*) AS n_records, {_pick('title', "title <> ''", 'rank, published_at DESC, record_id')} AS title,
        CAST(max(amount) AS DOUBLE) AS amount, {_pick('link', 'true', "length(regexp_replace(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1), '/+$|[^/]', '', 'g')) DESC, length(link) DESC, link")} AS link
        FROM r JOIN c ON record_id = id GROUP BY cluster""",
)
def merged_sources(spark, d):
    def keyed(sql):
        rows = frame(spark, d, sql)
        return rows.withColumn(
            "key", primary_key(["guid"], {"link": "url", "title": "text"}, "record_id")
        )

    policy = Policy(
        precedence=POLICIES["NZ"].precedence,
        fields={
            "title": "latest_by_precedence",
            "amount": "latest_crawl",
            "link": "prefer_deepest_path",
        },
        threshold=0.86,
        id_pattern=r"id=RFX(\d+)",
    )
    merged = merge_sources([keyed(_FEED), keyed(_NOTICES)], policy)
    return merged.withColumn("amount", F.col("amount").cast("double"))
