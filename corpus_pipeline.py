"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.decontaminate import clean
from harrow.llm.language import DIMENSIONS, UNDETERMINED, learn, predict
from harrow.llm.lines import without_repeats
from harrow.llm.nbest import decode, encode
from harrow.llm.ngramjoin import ngram_components
from harrow.session import cut_lineage

# Segmentations of a text that are searched, as in op7_sentencepiece.
N_BEST = 4

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_OTHERS = [c for c in DOCUMENT_COLUMNS if c != "text"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or have no letter are rejected.

    Where no row has a lang there is nothing to learn, and every text with a letter stays.
    """
    prototypes = learn(docs) or {"unlearned": np.ones(DIMENSIONS)}
    told = predict(docs.withColumn("body", F.col("text")), prototypes, *map(F.col, _OTHERS), F.col("body"))
    return told.where(F.col("lang_pred") != UNDETERMINED).withColumnRenamed("body", "text").select(*DOCUMENT_COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line nearly equals; a document that loses every line goes."""
    out = without_repeats(docs, "doc_id", "lang", "source", emptied=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that shares most of its five-word shingles."""
    stay = ngram_components(docs).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(stay.withColumnRenamed("doc_id", "k"), docs["doc_id"].eqNullSafe(F.col("k")), "left_semi").select(
        *DOCUMENT_COLUMNS
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*DOCUMENT_COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, its best segmentations, and whether the ids give its text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(docs, model, N_BEST, *map(F.col, _OTHERS), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    back = decode(coded, model)
    return back.select(*_OTHERS, "n_pieces", "score", "ids", "nbest", (F.xxhash64("decoded") == F.col("h")).alias("round_trip"))


STAGES = [
    ("language", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

# No stage can be put in SQL as a whole; tests compare each with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
