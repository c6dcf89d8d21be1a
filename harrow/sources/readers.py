"""Readers for landed files: tables, sheet exports, JSON, CSV, feed XML and raw bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.keys import content_hash
from harrow.operators.reshape import union_sources
from harrow.session import conf_set, cut_lineage
from harrow.sources.schemas import FEED_ITEM, MANIFEST

# Files of more bytes are hashed piece by piece; others are read whole.
LARGE_FILE = 32 << 20


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table by name, as stored, so that filters on any column reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _sheet_name(path: str = "_metadata.file_name") -> F.Column:
    return F.regexp_replace(F.col(path), r"\.[A-Za-z]+$", "")


def read_sheets(spark: SparkSession, folder: str, fmt: str = "csv", schema=None) -> DataFrame:
    """All sheet exports of a workbook folder, one file per sheet, tagged with the sheet name.

    Missing and empty cells both arrive as NULL. Without a schema, the columns
    are the union of the JSON keys, or the header the CSV files share; a CSV file
    with another header raises an error (see read_workbook).
    """
    reader = spark.read.option("pathGlobFilter", f"*.{fmt}").option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"', enforceSchema=False)
    df = reader.format(fmt).load(folder)
    return df.select("*", _sheet_name().alias("source_sheet"))


def read_sheet(spark: SparkSession, folder: str, name: str, fmt: str = "csv", schema=None):
    """One named sheet: only its file is read."""
    df = read_sheets(spark, f"{folder.rstrip('/')}/{name}.{fmt}", fmt, schema)
    return df.filter(F.col("source_sheet") == name)


def read_workbook(spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "csv"):
    """The named sheets in one table, each read under its own header; absent columns are NULL."""
    return union_sources([read_sheet(spark, folder, name, fmt) for name in names])


def read_exported_sheets(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """Sheets written by export_json: one partition folder per sheet, pruned by filters on it."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("mode", "PERMISSIVE").json(folder)


def read_rows_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON array of row objects. One file is one task; land large data as JSON lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a declared schema; a line that does not fit stays in _corrupt_record."""
    wanted = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.option("mode", "PERMISSIVE").schema(wanted).json(path)


def read_keyed_json(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A JSON object of territory -> rows, flattened to (country, source_sheet, row map).

    Keys outside the list, and keys that hold no array, are left out. The file
    is one record and so one task; the rows are spread again right after it.
    """
    wanted = T.MapType(T.StringType(), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    raw = spark.read.text(path, wholetext=True)
    per_key = raw.select(F.explode(F.from_json("value", wanted)).alias("country", "rows"))
    rows = per_key.filter(F.col("country").isin(*keys)).select(
        "country", F.col("country").alias("source_sheet"), F.explode("rows").alias("row")
    )
    return rows.repartition(spark.sparkContext.defaultParallelism)


def columns_of_map(df: DataFrame, headers: Sequence[str], column: str = "row") -> DataFrame:
    """The listed keys of a row map as columns beside the other columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.element_at(column, F.lit(h)).alias(h) for h in headers])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=MANIFEST, header=True, multiLine=True, escape='"')


def read_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Landed files as (path, file_name, length, content)."""
    df = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return df.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content"
    )


def file_hashes(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, file_name, length, sha256) of the landed files.

    A file is hashed in one task. A large one is read as the bytes between line feeds, so no
    task holds it whole; the longest stretch of bytes without one must fit in memory.
    """
    files = read_files(spark, folder, glob)
    columns = ["path", "file_name", "length"]
    small = files.filter(F.col("length") <= LARGE_FILE).select(*columns, content_hash("content").alias("sha256"))
    large = files.filter(F.col("length") > LARGE_FILE).select(*columns, "_metadata.file_path")
    longest = large.agg(F.max("length")).first()[0]
    if longest is None:
        return small
    lines = (
        spark.read.options(pathGlobFilter=glob, recursiveFileLookup=True, lineSep="\n")
        .text(folder)
        .select("_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", F.col("value").cast("binary"))
        .filter(F.col("file_size") > LARGE_FILE)
    )
    # no file is split: the lines of one arrive in order
    whole = {"spark.sql.files.maxPartitionBytes": longest, "spark.sql.files.minPartitionNum": 1}
    with conf_set(spark, whole):
        hashed = cut_lineage(lines.mapInArrow(_hash_lines, "file_path string, sha256 string"))
    return small.unionByName(large.join(hashed, "file_path").select(*columns, "sha256"))


class _LineHash:
    """The hash of a file's bytes from its lines: they come without line feeds and without a byte order mark."""

    _MARK = b"\xef\xbb\xbf"

    def __init__(self):
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(self._MARK)
        self.bytes, self.begun = 0, False

    def add(self, lines: list[bytes]) -> None:
        joined = b"\n".join([b"", *lines] if self.begun else lines)
        self.plain.update(joined)
        self.marked.update(joined)
        self.bytes += len(joined)
        self.begun = True

    def hexdigest(self, length: int) -> str:
        """Which of a mark and a last line feed are there follows from the file's length."""
        absent = length - self.bytes
        if absent not in (0, 1, 3, 4):
            raise ValueError(f"read {self.bytes} bytes of a file of {length}")
        found = self.marked if absent >= 3 else self.plain
        if absent % 3 == 1:
            found.update(b"\n")
        return found.hexdigest()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(path: str, length: int, found: _LineHash) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file_path": [path], "sha256": [found.hexdigest(length)]})

    current, found = None, None
    for batch in batches:
        runs = batch.column("file_path").to_pylist()
        starts = [i for i, path in enumerate(runs) if i == 0 or path != runs[i - 1]]
        for at, end in zip(starts, [*starts[1:], len(runs)], strict=True):
            if batch.column("file_block_start")[at].as_py():
                raise ValueError(f"{runs[at]} was split")
            if current is None or current[0] != runs[at]:
                if current is not None:
                    yield told(*current, found)
                current, found = (runs[at], batch.column("file_size")[at].as_py()), _LineHash()
            found.add(batch.column("value").slice(at, end - at).to_pylist())
    if current is not None:
        yield told(*current, found)


def read_feed_items(spark: SparkSession, path: str, schema=FEED_ITEM) -> DataFrame:
    """<item> elements of landed feed files."""
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in one header line; comma when none does."""
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0] if first else ""
    return max(",;\t|", key=lambda d: header.count(d))


def read_csv_any(spark: SparkSession, path: str, schema=None, encoding: str = "UTF-8"):
    """CSV with a sniffed delimiter; quoted line breaks are allowed and become LF."""
    reader = spark.read.options(
        header=True, sep=sniff_delimiter(spark, path), multiLine=True, escape='"', encoding=encoding
    )
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.regexp_replace(F.col(f"`{n}`"), "\r\n?", "\n") for n in texts})
