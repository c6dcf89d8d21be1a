"""Counts, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import aggregates as agg
from harrow.operators import joins, windows
from harrow.operators.filters import matches_literal
from harrow.sources.readers import load
from registry.bindings import CALLS, PROGRAM_DOCS, PROGRAMS, cte, frame
from registry.core import filled, query

P = cte(programs=PROGRAMS)


@query("stats_by_lang", "SELECT lang, count(*) AS count FROM documents GROUP BY 1")
def stats_by_lang(spark, d):
    return agg.stats_by(load(spark, d, "documents"), "lang")


@query(
    "stats_by_priority", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1"
)
def stats_by_priority(spark, d):
    return agg.stats_by(load(spark, d, "orders"), "o_orderpriority")


@query("stats_by_country", f"{P} SELECT country, count(*) AS count FROM programs GROUP BY 1")
def stats_by_country(spark, d):
    return agg.stats_by(frame(spark, d, PROGRAMS), "country")


@query("count_where", "SELECT count(*) AS total FROM lineitem WHERE l_returnflag = 'R'")
def count_where(spark, d):
    return agg.count_where(load(spark, d, "lineitem"), F.col("l_returnflag") == "R")


_PROFILED = ("funding_amount", "hyperlink", "eligibility_cutoffs", "closing_date")


@query(
    "fill_profile",
    f"{P} SELECT country, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE {filled(c)}) AS with_{c}" for c in _PROFILED)
    + " FROM programs GROUP BY 1",
)
def fill_profile(spark, d):
    return agg.fill_profile(frame(spark, d, PROGRAMS), _PROFILED, ["country"])


@query(
    "fill_profile_total",
    f"{P} SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE {filled(c)}) AS with_{c}" for c in _PROFILED)
    + " FROM programs",
)
def fill_profile_total(spark, d):
    return agg.fill_profile(frame(spark, d, PROGRAMS), _PROFILED)


@query(
    "label_coverage",
    """SELECT lang, count(*) AS total, count(quality) AS with_quality, count(toxic) AS with_toxic
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def label_coverage(spark, d):
    docs, labels = load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels")
    return agg.fill_profile(docs.join(labels, "doc_id", "left"), ["quality", "toxic"], ["lang"])


@query(
    "import_summary",
    f"""{P} SELECT source_sheet, count(*) AS imported FROM programs GROUP BY 1
        UNION ALL SELECT '(total)', count(*) FROM programs""",
)
def import_summary(spark, d):
    return agg.import_summary(frame(spark, d, PROGRAMS))


@query("facet_values", "SELECT DISTINCT source FROM documents")
def facet_values(spark, d):
    return agg.facet_values(load(spark, d, "documents"), "source")


@query(
    "territory_map",
    f"""{P}, s AS (SELECT country, count(*) AS n FROM programs GROUP BY 1)
        SELECT string_agg(country || '=' || n, ',' ORDER BY country) AS counts FROM s""",
)
def territory_map(spark, d):
    folded = agg.as_map(agg.stats_by(frame(spark, d, PROGRAMS), "country"), "country", "count")
    entries = F.transform(
        F.array_sort(F.map_entries("as_map")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return folded.select(F.array_join(entries, ",").alias("counts"))


@query(
    "shown_of_total",
    """SELECT count(*) FILTER (WHERE contains(lower(text), 'that the')) AS shown, count(*) AS total
       FROM documents""",
)
def shown_of_total(spark, d):
    docs = load(spark, d, "documents")
    return agg.shown_of_total(docs, matches_literal("That the", ["text"]))


@query(
    "doc_counts",
    f"""{cte(programs=PROGRAMS, program_docs=PROGRAM_DOCS)}
        SELECT id, count(doc_id) AS documents FROM programs LEFT JOIN program_docs ON id = program_id GROUP BY 1""",
)
def doc_counts(spark, d):
    return joins.doc_counts(frame(spark, d, PROGRAMS), frame(spark, d, PROGRAM_DOCS))


@query(
    "counts_for_dimension",
    """SELECT n_name, count(s_suppkey) AS count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
       AND s_acctbal > 5000 GROUP BY 1""",
)
def counts_for_dimension(spark, d):
    dim = load(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    rich = load(spark, d, "supplier").filter("s_acctbal > 5000")
    stats = agg.stats_by(
        rich.join(dim, F.col("s_nationkey") == F.col("k")).select("n_name"), "n_name"
    )
    return joins.counts_for(dim, stats, "n_name")


_SHEET_COLS = ("hyperlink", "focus", "cutoffs_caps", "closing_date")


@query(
    "sheet_profile",
    f"""{P}, s AS (SELECT source_sheet, count(*) AS rows, """
    + ", ".join(f"bool_or({filled(c)}) AS h_{c}" for c in _SHEET_COLS)
    + """ FROM programs GROUP BY 1)
        SELECT source_sheet, rows, array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN h_{c} THEN '{c}' END" for c in _SHEET_COLS)
    + """], lambda x: x IS NOT NULL), ',') AS columns FROM s""",
)
def sheet_profile(spark, d):
    profile = agg.sheet_profile(frame(spark, d, PROGRAMS).select("source_sheet", *_SHEET_COLS))
    return profile.withColumn("columns", F.array_join("columns", ","))


@query(
    "sheet_preview",
    f"""{P}, r AS (SELECT source_sheet, id, CAST(row_number() OVER (PARTITION BY source_sheet ORDER BY id) AS INT) AS row_no FROM programs)
        SELECT source_sheet, id, row_no FROM r WHERE row_no <= 5""",
)
def sheet_preview(spark, d):
    return windows.preview(frame(spark, d, PROGRAMS).select("source_sheet", "id"), "source_sheet", ["id"])


@query(
    "crawl_metrics",
    f"""{cte(calls=CALLS)},
        m AS (SELECT CASE WHEN grouping(status) + grouping(domain) = 2 THEN 'all' WHEN grouping(status) = 0 THEN 'status' ELSE 'domain' END AS scope,
          CASE WHEN grouping(status) = 0 THEN cast(status AS VARCHAR) WHEN grouping(domain) = 0 THEN domain END AS value,
          count(*) AS calls, count(*) FILTER (WHERE failed) AS errors,
          round(CAST(sum(latency_ms) AS DOUBLE) / count(latency_ms), 3) AS mean_latency_ms
          FROM calls GROUP BY GROUPING SETS ((), (status), (domain)))
        SELECT * FROM m""",
)
def crawl_metrics(spark, d):
    calls = frame(spark, d, CALLS).withColumn("status", F.col("status").cast("string"))
    return agg.crawl_metrics(calls)
