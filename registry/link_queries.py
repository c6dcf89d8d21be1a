"""Linking documents to programs, similar titles, and word search."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.keys import content_hash
from harrow.functions.urls import host as url_host
from harrow.operators import fuzzy, joins, search
from harrow.operators.columns import hosted_path
from harrow.operators.containment import contained_pairs
from harrow.operators.html import extract_cards
from harrow.operators.linking import link_documents, unlinked
from harrow.operators.aggregates import link_summary
from harrow.sources.readers import load
from registry.bindings import frame
from registry.core import edits, host, norm, query, tokens, trim

# Passages as programs, documents as titled documents.
_LINKED = f"""WITH programs AS (SELECT lower(text) AS title, min(item_id) AS id FROM benchmark WHERE {trim('text')} <> '' GROUP BY 1),
 docs AS (SELECT doc_id, lower(text) AS title FROM documents),
 exact AS (SELECT doc_id, id FROM docs JOIN programs USING (title)),
 partial AS (SELECT doc_id, min(id) AS id FROM docs JOIN programs p ON contains(docs.title, p.title) OR contains(p.title, docs.title)
   WHERE {trim('docs.title')} <> '' AND doc_id NOT IN (SELECT doc_id FROM exact) GROUP BY 1),
 linked AS (SELECT doc_id, coalesce(e.id, p.id) AS program_id,
   CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN p.id IS NOT NULL THEN 'partial' ELSE 'none' END AS match_kind
   FROM docs LEFT JOIN exact e USING (doc_id) LEFT JOIN partial p USING (doc_id))
"""


def _documents(spark, d):
    return load(spark, d, "documents")


def _linked(spark, d):
    docs = _documents(spark, d).select("doc_id", F.col("text").alias("program_title"))
    programs = load(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("program_name")
    )
    return link_documents(docs, programs)


@query("link_documents", _LINKED + "SELECT * FROM linked")
def link_document_titles(spark, d):
    return _linked(spark, d).select("doc_id", "program_id", "match_kind")


@query("unlinked_documents", _LINKED + "SELECT doc_id FROM linked WHERE match_kind = 'none'")
def unlinked_documents(spark, d):
    return unlinked(_linked(spark, d)).select("doc_id")


@query("link_summary", _LINKED + "SELECT match_kind, count(*) AS documents FROM linked GROUP BY 1")
def link_counts(spark, d):
    return link_summary(_linked(spark, d))


# Part names as programs; the first words of customer segments and names as titles.
_TITLES = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('Guide: ', p_name, ' (EN)')
  WHEN 2 THEN substr(p_name, 2, 4) WHEN 3 THEN 'zzz nothing' ELSE ' ' END AS program_title
FROM {orders} JOIN {part} ON o_custkey = p_partkey
"""


@query(
    "link_short_titles",
    f"""WITH programs AS (SELECT lower(p_name) AS title, min(p_partkey) AS id FROM part GROUP BY 1),
        docs AS (SELECT o_orderkey, lower(program_title) AS title FROM ({_TITLES.replace('{', '').replace('}', '')})),
        hits AS (SELECT d.title, min(CASE WHEN d.title = p.title THEN id END) AS e, min(id) AS id FROM (SELECT DISTINCT title FROM docs WHERE {trim('title')} <> '') d
          JOIN programs p ON contains(d.title, p.title) OR contains(p.title, d.title) GROUP BY 1)
        SELECT o_orderkey, coalesce(e, id) AS program_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN id IS NOT NULL THEN 'partial' ELSE 'none' END AS match_kind
        FROM docs LEFT JOIN hits USING (title)""",
)
def link_short_titles(spark, d):
    programs = load(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("program_name")
    )
    return link_documents(frame(spark, d, _TITLES), programs).select(
        "o_orderkey", "program_id", "match_kind"
    )


@query(
    "contained_passages",
    """SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''""",
)
def contained_passages(spark, d):
    passages = load(spark, d, "benchmark").select("item_id", F.lower("text").alias("needle"))
    docs = _documents(spark, d).select("doc_id", F.lower("text").alias("text"))
    pairs = contained_pairs(passages, "needle", docs, "doc_id", "text")
    return pairs.join(passages, "needle").select("doc_id", "item_id")


@query(
    "attach_file_hash",
    """SELECT o_orderkey, 'canada/file' || o_orderkey || '.pdf' AS file_slug, doc_id IS NOT NULL AS file_present,
       sha256(text) AS sha256 FROM orders LEFT JOIN documents ON doc_id = o_orderkey""",
)
def attach_file_hash(spark, d):
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    files = load(spark, d, "documents").select(
        name.alias("path"), name.alias("file_name"), content_hash("text").alias("sha256")
    )
    docs = load(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit("file"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"),
    )
    return joins.attach_file_hash(docs, files).select(
        "o_orderkey", hosted_path().alias("file_slug"), "file_present", "sha256"
    )


_PAGE_TITLES = f"""WITH pages_t AS (SELECT page_id, {host('url')} AS host, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)
"""


def _page_titles(spark, d):
    return load(spark, d, "pages").select(
        "page_id",
        url_host("url").alias("host"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
    )


def _fuzzy_sql(blocks: str, edits_per_1000: int) -> str:
    cond = " AND ".join(f"a.{b} = b.{b}" for b in blocks.split(", "))
    return (
        _PAGE_TITLES
        + f""", g AS (SELECT {blocks}, {norm('title')} AS t, min(page_id) AS rep FROM pages_t WHERE {norm('title')} <> '' GROUP BY ALL)
        SELECT a.rep AS a, b.rep AS b, round(1 - {edits('a.t', 'b.t')} / greatest(length(a.t), length(b.t)), 4) AS similarity
        FROM g a JOIN g b ON {cond} AND a.rep < b.rep
        WHERE {edits('a.t', 'b.t')} * 1000 <= {edits_per_1000} * greatest(length(a.t), length(b.t))"""
    )


@query("similar_titles_by_host", _fuzzy_sql("host", 140))
def similar_titles_by_host(spark, d):
    return fuzzy.fuzzy_match(_page_titles(spark, d), "page_id", "title", ["host"], 0.86).select(
        "a", "b", "similarity"
    )


@query("similar_titles_by_kind", _fuzzy_sql("lang", 120))
def similar_titles_by_kind(spark, d):
    return fuzzy.fuzzy_match(_page_titles(spark, d), "page_id", "title", ["lang"], 0.88).select(
        "a", "b", "similarity"
    )


# Titles with small edits: customers' segments with a city-like tail, one per order.
_EDITED = """
SELECT o_orderkey, cast(o_orderkey % 3 AS STRING) AS kind, concat(md5(cast(o_custkey AS STRING)),
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN ' Program' ELSE ' programme' END) AS title FROM {orders}
"""


# Comparing all pairs in SQL takes over a minute here; the tests do it on a small folder.
EDITED_SQL = f"""WITH e AS ({_EDITED.replace('{orders}', 'orders')}), g AS (SELECT kind, {norm('title')} AS t, min(o_orderkey) AS rep FROM e GROUP BY ALL)
 SELECT a.rep AS a, b.rep AS b, round(1 - {edits('a.t', 'b.t')} / greatest(length(a.t), length(b.t)), 4) AS similarity
 FROM g a JOIN g b ON a.kind = b.kind AND a.rep < b.rep WHERE {edits('a.t', 'b.t')} * 1000 <= 140 * greatest(length(a.t), length(b.t))"""


@query("similar_edited_titles")
def similar_edited_titles(spark, d):
    return fuzzy.fuzzy_match(frame(spark, d, _EDITED), "o_orderkey", "title", ["kind"], 0.86).select(
        "a", "b", "similarity"
    )


# Titles of different customers have next to nothing in common, and the four endings make
# two groups of similar titles, so the clusters follow from the generator above.
@query(
    "edited_title_clusters",
    "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 3, o_orderkey % 4 < 2) AS cluster FROM orders",
)
def edited_title_clusters(spark, d):
    return fuzzy.similar_clusters(frame(spark, d, _EDITED), "o_orderkey", "title", ["kind"], 0.86).select(
        "o_orderkey", "cluster"
    )


# Titles that differ in their number alone: very many of them are similar to each other.
_NUMBERED = """
SELECT c_custkey, cast(c_nationkey % 4 AS STRING) AS kind,
  concat('Round ', lpad(cast(c_custkey AS STRING), 6, '0'), ' of the rural water fund') AS title FROM {customer}
"""
_SIMILAR = f"""WITH e AS ({_NUMBERED.replace('{customer}', 'customer')}), g AS (SELECT kind, {norm('title')} AS t, min(c_custkey) AS rep FROM e GROUP BY ALL),
 p AS (SELECT a.rep AS a, b.rep AS b, levenshtein(a.t, b.t) AS n, greatest(length(a.t), length(b.t)) AS l
   FROM g a JOIN g b ON a.kind = b.kind AND a.rep < b.rep)
"""


@query(
    "similar_numbered_titles",
    _SIMILAR + "SELECT a, b, round(1 - n / l, 4) AS similarity FROM p WHERE n * 1000 <= 50 * l",
)
def similar_numbered_titles(spark, d):
    titles = frame(spark, d, _NUMBERED)
    return fuzzy.fuzzy_match(titles, "c_custkey", "title", ["kind"], 0.95).select("a", "b", "similarity")


_TERMS = ("the", "thing", "of")


def _score_sql(word_list: str, words_text: str, words_source: str) -> str:
    return (
        f"2 * len(list_intersect({words_text}, {word_list})) + 5 * len(list_intersect({words_source}, {word_list}))"
    )


@query(
    "search_words",
    f"""WITH t AS (SELECT doc_id, {tokens('text')} AS wt, {tokens('source')} AS ws, {tokens("concat_ws(' ', text, source)")} AS w FROM documents)
        SELECT doc_id, len(list_intersect(w, ['the', 'of', 'src1'])) AS matched_terms,
        {_score_sql("['the', 'of', 'src1']", 'wt', 'ws')} AS score FROM t
        WHERE len(list_intersect(w, ['the', 'of', 'src1'])) = 3""",
)
def search_words(spark, d):
    out = search.search_tokens(_documents(spark, d), "The of src1", {"text": 2, "source": 5})
    return out.select(
        "doc_id", F.col("matched_terms").cast("bigint").alias("matched_terms"), F.col("score").cast("bigint").alias("score")
    )


@query(
    "search_words_any",
    f"""WITH t AS (SELECT doc_id, {tokens('text')} AS w FROM documents)
        SELECT doc_id, len(list_intersect(w, ['erlich', 'lichkeit', 'pfbe'])) AS matched_terms FROM t
        WHERE len(list_intersect(w, ['erlich', 'lichkeit', 'pfbe'])) >= 1""",
)
def search_words_any(spark, d):
    out = search.search_tokens(_documents(spark, d), "erlich LICHKEIT pfbe", {"text": 1}, "any")
    return out.select("doc_id", F.col("matched_terms").cast("bigint").alias("matched_terms"))


@query(
    "search_index",
    f"""WITH docs AS (SELECT doc_id, {tokens('text')} AS w FROM documents),
        queries AS (SELECT item_id AS query_id, {tokens('text')} AS q FROM benchmark),
        p AS (SELECT doc_id, unnest(w) AS term FROM docs), t AS (SELECT query_id, unnest(q) AS term, len(q) AS needed FROM queries)
        SELECT query_id, doc_id, count(*) AS matched_terms, count(*) * 3 AS score FROM p JOIN t USING (term)
        GROUP BY query_id, doc_id, needed HAVING count(*) = needed""",
)
def search_index(spark, d):
    index = search.token_index(_documents(spark, d), "doc_id", {"text": 3})
    queries = load(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return search.search_index(index, queries, "doc_id")


@query(
    "navigation_links",
    r"""SELECT page_id, url, CAST(i AS INT) AS card_no, regexp_extract(x, '<a href="([^"]*)">', 1) AS href, trim(regexp_extract(x, '">([^<]*)</a>', 1), ' ') AS title
        FROM (SELECT page_id, url, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
          SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages))""",
)
def navigation_links(spark, d):
    fields = {"title": "a", "href": "a[href]"}
    return extract_cards(load(spark, d, "pages"), "nav li", fields)


@query(
    "page_headings",
    r"""SELECT page_id, CAST(1 AS INT) AS card_no,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(regexp_extract(html, '<article><h1>([^<]*)</h1>', 1), ' '),
          '&#x27;', chr(39)), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS heading
        FROM pages WHERE contains(html, '<article>')""",
)
def page_headings(spark, d):
    return extract_cards(load(spark, d, "pages"), "article", {"heading": "h1"}, keep=["page_id"])
