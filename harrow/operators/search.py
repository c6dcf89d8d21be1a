"""Word search over the catalogue."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import let, tokens
from harrow.session import BROADCAST_LIMIT, cut_lineage, measured_bytes


def _hit(weights: Mapping[str, int], terms: Column) -> Column:
    """struct(matched_terms, score): query words held by any field, and the sum over
    fields of weight times the number of query words the field holds."""
    held = F.array(*[F.array_intersect(tokens(c), terms) for c in weights])

    def summed(per_field: Column) -> Column:
        matched = F.size(F.array_distinct(F.flatten(per_field)))
        score = sum(F.size(per_field[i]) * F.lit(int(w)) for i, w in enumerate(weights.values()))
        return F.struct(matched.alias("matched_terms"), score.alias("score"))

    return let(held, summed)


def search_tokens(
    df: DataFrame, query: str, weights: Mapping[str, int], match: str = "all"
) -> DataFrame:
    """Rows holding all (or any) words of one query in the given fields, with a score.

    Whole words are compared after case folding; there is no stemming. One
    query is a filter over the rows: nothing is shuffled.
    """
    terms = tokens(F.lit(query))
    wanted = F.size(terms) if match == "all" else F.lit(1)
    # A text lacking a word as a substring lacks it as a word: no need to cut it into words.
    each = F.forall if match == "all" else F.exists
    everything = F.lower(F.concat_ws(" ", *[F.col(c) for c in weights]))
    possible = let(everything, lambda text: each(terms, lambda t: F.contains(text, t)))
    # Exploding the hits that count cuts every text into words once; a filter on a
    # computed column would do it once more.
    hits = F.filter(
        F.array(_hit(weights, terms)),
        lambda h: (h["matched_terms"] >= wanted) & (h["matched_terms"] > 0),
    )
    return (
        df.filter(possible)
        .withColumn("_hit", F.explode(hits))
        .select(*df.columns, "_hit.matched_terms", "_hit.score")
    )


def token_index(df: DataFrame, key: str, weights: Mapping[str, int]) -> DataFrame:
    """Inverted table (term, key, weight): the summed weight of the fields holding the term.

    The key is unique, so a row's postings follow from the row alone and
    nothing is shuffled.
    """
    rows = df.select(key, *[tokens(c).alias(f"_t{i}") for i, c in enumerate(weights)])
    fields = [F.col(f"_t{i}") for i in range(len(weights))]
    terms = F.array_distinct(F.concat(*fields))
    weight = sum(
        (F.array_contains(f, F.col("term")).cast("bigint") * w)
        for f, w in zip(fields, weights.values())
    )
    return rows.withColumn("term", F.explode(terms)).select("term", key, weight.alias("weight"))


def search_index(
    index: DataFrame, queries: DataFrame, key: str, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """All words of many queries at once: (query_id, key, matched_terms, score), rows with every word.

    queries holds (query_id, query). Queries of the same words are looked up once.
    One pass over the index keeps the postings of the words asked for and gives
    their document frequencies. A query starts from the postings of its rarest
    word; those rows are then looked up under its other words, by word and row, so a
    word that every text and query holds makes no product. A query with a word that
    no row has, or without a word, finds nothing.
    """
    terms = F.array_sort(tokens("query"))
    asked = queries.select("query_id", terms.alias("_terms")).filter(F.size("_terms") > 0)
    asked = cut_lineage(asked.withColumn("_q", F.sha2(F.array_join("_terms", " "), 256)))
    sets = cut_lineage(asked.groupBy("_q").agg(F.first("_terms").alias("_terms")))
    each = sets.select("_q", F.size("_terms").cast("bigint").alias("needed"), F.explode("_terms").alias("term"))
    vocabulary = cut_lineage(each.select("term").distinct())
    small = measured_bytes(vocabulary) <= limit
    postings = cut_lineage(index.join(F.broadcast(vocabulary) if small else vocabulary, "term"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    known = (
        each.join(frequency, "term")
        .groupBy("_q", "needed")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "term"))).alias("_by"))
        .filter(F.size("_by") == F.col("needed"))
    )
    starts = cut_lineage(
        known.select(
            "_q",
            "needed",
            F.col("_by")[0]["term"].alias("term"),
            F.slice("_by.term", F.lit(2), F.greatest(F.size("_by") - 1, F.lit(0))).alias("_others"),
        )
    )
    if measured_bytes(starts) <= limit:
        starts = F.broadcast(starts)
    first = postings.join(starts, "term").select("_q", "needed", key, "weight", "_others")
    alone = first.filter("needed = 1").select("_q", key, "needed", F.col("weight").alias("score"))
    others = first.filter("needed > 1").select(
        "_q", "needed", key, F.col("weight").alias("_w"), F.explode("_others").alias("term")
    )
    together = (
        others.join(postings, ["term", key])
        .groupBy("_q", key, "needed", "_w")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_s"))
        .filter(F.col("_n") == F.col("needed") - 1)
        .select("_q", key, "needed", (F.col("_w") + F.col("_s")).alias("score"))
    )
    hits = alone.unionByName(together)
    return asked.select("query_id", "_q").join(hits, "_q").select(
        "query_id", key, F.col("needed").alias("matched_terms"), "score"
    )
