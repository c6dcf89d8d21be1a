"""Round trips through the readers and writers, over data derived from the given tables.

Each run writes to a new folder below the shared one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.session import new_run_dir
from harrow.sources import readers, writers
from harrow.sources.readers import load
from harrow.sources.schemas import FEED_ITEM
from registry.bindings import PROGRAM_DOCS, PROGRAMS, cte, frame
from registry.core import query


@query("table_scan", "SELECT * FROM supplier")
def table_scan(spark, d):
    return load(spark, d, "supplier")


@query(
    "sheets_round_trip",
    f"{cte(programs=PROGRAMS)} SELECT source_sheet, count(*) AS rows, count(program_name) AS names, CAST(sum(length(description)) AS BIGINT) AS chars FROM programs GROUP BY 1",
)
def sheets_round_trip(spark, d):
    out = new_run_dir(spark, "sheets")
    rows = frame(spark, d, PROGRAMS).select("id", "program_name", "description", "source_sheet")
    writers.export_json(rows, out)
    back = readers.read_exported_sheets(
        spark, out, "id string, program_name string, description string, source_sheet string"
    )
    return back.groupBy("source_sheet").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("program_name").alias("names"),
        F.sum(F.length("description").cast("bigint")).alias("chars"),
    )


@query(
    "one_sheet",
    f"{cte(programs=PROGRAMS)} SELECT id, program_name FROM programs WHERE source_sheet = 'PROMO'",
)
def one_sheet(spark, d):
    out = new_run_dir(spark, "sheet")
    writers.export_json(frame(spark, d, PROGRAMS).select("id", "program_name", "source_sheet"), out)
    back = readers.read_exported_sheets(spark, out, "id string, program_name string, source_sheet string")
    return back.filter("source_sheet = 'PROMO'").select("id", "program_name")


_SHEET_ROWS = f"""{cte(programs=PROGRAMS)}
SELECT id, nullif(program_name, '') AS program_name, nullif(focus, '') AS focus, nullif(key_objectives, '') AS key_objectives, source_sheet FROM programs"""


def _workbook(spark, d):
    out = new_run_dir(spark, "workbook")
    columns = ["id", "program_name", "focus", "key_objectives", "source_sheet"]
    writers.write_workbook(frame(spark, d, PROGRAMS).select(*columns), out)
    return out


@query("workbook_sheets", _SHEET_ROWS)
def workbook_sheets(spark, d):
    return readers.read_sheets(spark, _workbook(spark, d))


@query("workbook_sheet", _SHEET_ROWS + " WHERE source_sheet = 'ECONOMY'")
def workbook_sheet(spark, d):
    return readers.read_sheet(spark, _workbook(spark, d), "ECONOMY")


@query("json_array_rows", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def json_array_rows(spark, d):
    out = new_run_dir(spark, "arrays")
    # a missing cell is absent from its row, or there as null
    left_out = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal"))
    row = F.to_json(F.struct("s_suppkey", "s_name", left_out.alias("s_acctbal")))
    row = F.when(F.col("s_suppkey") % 2 == 0, row).otherwise(
        F.regexp_replace(row, r"\}$", F.when(left_out.isNull(), ',"s_acctbal":null}').otherwise("}"))
    )
    files = load(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 500)).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(row), ",\n"), F.lit("]")).alias("value")
    )
    files.select("value").write.option("maxRecordsPerFile", 1).text(out)
    return readers.read_rows_json(spark, out, "s_suppkey bigint, s_name string, s_acctbal double")


@query(
    "json_rows_by_key",
    """SELECT n_name AS country, n_name AS source_sheet, s_name AS program, CAST(s_suppkey AS VARCHAR) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey
       WHERE n_regionkey < 3""",
)
def json_rows_by_key(spark, d):
    out = new_run_dir(spark, "keyed")
    nations = load(spark, d, "nation")
    row = F.struct(F.col("s_name").alias("Program"), F.col("s_suppkey").cast("string").alias("id"))
    rows = load(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    # an object of at most 500 suppliers per file
    per_key = rows.groupBy(F.floor(F.col("s_suppkey") / 500).alias("file"), "n_name").agg(F.collect_list(row).alias("rows"))
    files = per_key.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "rows")))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(out)
    wanted = [r[0] for r in nations.filter("n_regionkey < 3").select("n_name").collect()]  # 25 nations at most
    back = readers.columns_of_map(readers.read_keyed_json(spark, out, wanted), ["Program", "id"])
    return back.withColumnRenamed("Program", "program")


@query("landed_text_hashes", "SELECT sha256(text || chr(10)) AS sha256, CAST(strlen(text) + 1 AS BIGINT) AS length FROM benchmark")
def landed_text_hashes(spark, d):
    out = new_run_dir(spark, "landed")
    load(spark, d, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(out)
    return readers.file_hashes(spark, out, "*.txt").select("sha256", "length")


@query(
    "append_twice",
    "SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1",
)
def append_twice(spark, d):
    out = new_run_dir(spark, "orders")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    # every batch holds each key twice
    writers.append_new(orders.filter("o_orderstatus = 'F'").union(orders.filter("o_orderstatus = 'F'")), out, "o_orderkey")
    writers.append_new(orders.union(orders), out, "o_orderkey")
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("keys")
    )


@query("jsonl_round_trip", "SELECT doc_id, lang, sha256(text) AS sha256 FROM documents")
def jsonl_round_trip(spark, d):
    out = new_run_dir(spark, "jsonl")
    writers.write_jsonl(load(spark, d, "documents").select("doc_id", "lang", "text"), out)
    back = spark.read.schema("doc_id bigint, lang string, text string").json(out)
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))


@query("csv_any_round_trip", "SELECT doc_id, lang, sha256(text) AS sha256 FROM documents")
def csv_any_round_trip(spark, d):
    out = new_run_dir(spark, "csv")
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    docs.write.options(
        header=True, sep=";", quoteAll=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(out)
    back = readers.read_csv_any(spark, out, "doc_id bigint, lang string, text string")
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))


@query(
    "manifest_round_trip",
    f"""{cte(docs=PROGRAM_DOCS)} SELECT doc_type, count(*) AS rows, count(nullif(language, '')) AS languages, count(nullif(file_slug, '')) AS files FROM docs GROUP BY 1""",
)
def manifest_round_trip(spark, d):
    out = new_run_dir(spark, "manifest")
    none = F.lit(None).cast("string")
    frame(spark, d, PROGRAM_DOCS).select(
        "program_id",
        F.col("display_name").alias("program_title"),
        none.alias("province_or_state"),
        F.lit("CA").alias("country"),
        "doc_type",
        "display_name",
        F.col("file_slug").alias("file_name"),
        "language",
        none.alias("effective_date"),
        "source_url",
        none.alias("notes"),
    ).write.option("header", True).csv(out)
    back = readers.read_manifest(spark, out)
    return back.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("language").alias("languages"),
        F.count("file_name").alias("files"),
    )


@query(
    "feed_items_round_trip",
    f"""{cte(programs=PROGRAMS)} SELECT id AS guid, trim(program_name, ' ') AS title, hyperlink AS link FROM programs WHERE trim(program_name, ' ') <> ''""",
)
def feed_items_round_trip(spark, d):
    out = new_run_dir(spark, "feed")
    programs = frame(spark, d, PROGRAMS).filter("trim(program_name) <> ''")
    items = programs.select(
        F.col("program_name").alias("title"),
        F.col("hyperlink").alias("link"),
        F.lit("Fri, 26 Sep 2025 10:00:00 GMT").alias("pubDate"),
        F.col("id").alias("guid"),
    )
    items.write.format("xml").options(rootTag="channel", rowTag="item").save(out)
    return readers.read_feed_items(spark, out, FEED_ITEM).select("guid", "title", "link")


@query("landed_file_hashes")
def landed_file_hashes(spark, d):
    return readers.file_hashes(spark, d, "*.parquet").select("file_name", "length", "sha256")
