"""Document to program linking by exact, then partial title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import has_text
from harrow.operators.containment import contained_pairs
from harrow.session import BROADCAST_LIMIT, cut_lineage


def title_index(programs: DataFrame, key: str = "id", name: str = "program_name") -> DataFrame:
    """(title, program_id) by folded title. Of equal titles the smallest id counts; blanks are out."""
    return (
        programs.filter(has_text(name))
        .groupBy(F.lower(name).alias("title"))
        .agg(F.min(key).alias("program_id"))
    )


def link_exact(docs: DataFrame, titles: DataFrame, title: str = "program_title") -> DataFrame:
    """Documents with the program of the same folded title, NULL when there is none."""
    known = titles.select(F.col("title").alias("_t"), F.col("program_id"))
    return docs.join(known, F.lower(title) == F.col("_t"), "left").drop("_t")


def link_contains(
    wanted: DataFrame, titles: DataFrame, broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """(doc_title, program_id): titles where one holds the other; of several, the smallest id.

    wanted holds distinct folded document titles as doc_title.
    """
    asked = wanted.filter(has_text("doc_title"))
    inside = contained_pairs(titles, "title", asked, "doc_title", "doc_title", broadcast_limit)
    around = contained_pairs(
        asked, "doc_title", titles.select("title"), "title", "title", broadcast_limit
    )
    pairs = inside.select("doc_title", F.col("needle").alias("title")).unionByName(
        around.select(F.col("needle").alias("doc_title"), "title")
    )
    return (
        pairs.join(titles, "title").groupBy("doc_title").agg(F.min("program_id").alias("program_id"))
    )


def link_documents(
    docs: DataFrame,
    programs: DataFrame,
    title: str = "program_title",
    key: str = "id",
    name: str = "program_name",
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Every document with program_id and match_kind: exact, partial or none.

    Matching is done once per distinct title, and its outcome joined to the documents
    once. The distinct titles on both sides are read several times, so they are
    tables in the shared folder; the documents are read twice.
    """
    titles = cut_lineage(title_index(programs, key, name))
    folded = docs.select(F.lower(title).alias("doc_title")).distinct()
    asked = cut_lineage(link_exact(folded, titles, "doc_title").withColumnRenamed("program_id", "_exact"))
    left_over = asked.filter(F.col("_exact").isNull()).select("doc_title")
    partial = link_contains(left_over, titles, broadcast_limit).withColumnRenamed("program_id", "_partial")
    kind = (
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_partial").isNotNull(), "partial")
        .otherwise("none")
    )
    told = asked.join(partial, "doc_title", "left").select(
        F.col("doc_title").alias("_t"), F.coalesce("_exact", "_partial").alias("program_id"), kind.alias("match_kind")
    )
    # a document without a title has no entry of its own
    return (
        docs.join(told, F.lower(title) == F.col("_t"), "left")
        .withColumn("match_kind", F.coalesce("match_kind", F.lit("none")))
        .drop("_t")
    )


def unlinked(linked: DataFrame) -> DataFrame:
    """The documents no program was found for."""
    return linked.filter(F.col("match_kind") == "none").drop("program_id", "match_kind")
