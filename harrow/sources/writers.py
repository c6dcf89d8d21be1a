"""Sinks: append with and without replay safety, JSON lines and nested export."""

from __future__ import annotations

from collections.abc import Sequence

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Plain append; running it twice duplicates rows."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key: the first by the other columns' order, whatever the partitioning."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    first = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.`{c}`") for c in df.columns])


def new_rows(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row of each key that the table does not hold yet."""
    return one_per_key(df.join(existing.select(key).distinct(), key, "left_anti"), key)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append that may be run again: rows already present by key are left out, as are repeats inside a batch."""
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as error:  # first load: no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        append(one_per_key(df, key), path)
        return
    append(new_rows(df, existing, key), path)


def export_json(df: DataFrame, path: str, sheet_column: str = "source_sheet") -> None:
    """One folder of JSON lines per sheet."""
    df.write.mode("overwrite").partitionBy(sheet_column).json(path)


def write_workbook(df: DataFrame, folder: str, sheet_column: str = "source_sheet") -> None:
    """One CSV file per sheet, named after it: the folder that readers.read_sheets reads.

    A sheet is written by one task; the driver only gives the finished files their names.
    """
    spark = df.sparkSession
    draft = f"{folder.rstrip('/')}/_draft"
    df.repartition(sheet_column).write.mode("overwrite").partitionBy(sheet_column).options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(draft)
    jvm = spark._jvm.org.apache.hadoop.fs
    home = jvm.Path(draft)
    store = home.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in store.globStatus(jvm.Path(f"{draft}/{sheet_column}=*/part-*")):
        sheet = unquote(part.getPath().getParent().getName().partition("=")[2])
        store.rename(part.getPath(), jvm.Path(home.getParent(), f"{sheet}.csv"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def route_to_folders(df: DataFrame, path: str, column: str = "destination") -> None:
    """Routed rows, one folder per destination."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def export_nested(
    programs: DataFrame, attributes: DataFrame, docs: DataFrame, max_documents: int = 10_000
) -> DataFrame:
    """Records of a program: core columns, attributes as a map, documents as an array.

    Programs are keyed by id, documents by doc_id, children by program_id. Most
    programs are one record. One with more documents than max_documents is
    written as several parts of about that size (part of parts, from 0), so no
    task gathers an unbounded group and no document is lost. Where an attribute
    key repeats, its smallest value is kept.
    """
    attr = attributes.groupBy("program_id", "attr_key").agg(F.min("attr_value").alias("attr_value"))
    attr = attr.groupBy(F.col("program_id").alias("_a")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr_key", "attr_value")))).alias(
            "attributes"
        )
    )
    sizes = docs.groupBy(F.col("program_id").alias("_s")).agg(
        F.ceil(F.count(F.lit(1)) / max_documents).cast("int").alias("parts")
    )
    fields = [c for c in docs.columns if c != "program_id"]
    doc = (
        docs.join(sizes, F.col("program_id") == F.col("_s"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .groupBy(F.col("program_id").alias("_d"), "parts", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("documents"))
    )
    no_docs = F.array().cast(doc.schema["documents"].dataType)
    return (
        programs.join(attr, F.col("id") == F.col("_a"), "left")
        .join(doc, F.col("id") == F.col("_d"), "left")
        .withColumns(
            {
                "attributes": F.coalesce("attributes", F.create_map().cast("map<string,string>")),
                "documents": F.coalesce("documents", no_docs),
                "parts": F.coalesce("parts", F.lit(1)),
                "part": F.coalesce("part", F.lit(0)),
            }
        )
        .drop("_a", "_d")
    )
