"""Substring join: which texts hold which needles, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import let
from harrow.session import BROADCAST_LIMIT, cut_lineage, measured_bytes

# Kinds of character runs used as join keys. WORD runs start at a word start, so a
# text has few of them; both neighbouring characters of the start lie inside the
# needle, so a text holding the needle has the same start. A needle without one uses
# runs from every position, of the longest size that fits: even one character is found.
WORD = 0
_WORD_TAIL = 11
GRAM_SIZES = (16, 8, 4, 2, 1)

# Runs of a needle considered as its key. Any run finds every match; more
# choices only make a rarer one likelier.
ANCHOR_CHOICES = 64
FEW_CHOICES = 8

# Bytes of join keys a byte of text can turn into, for judging the text side's size.
KEY_BYTES = 32


def _runs(text: Column, kind: int) -> Column:
    """Distinct hashes of all runs of this kind, in one pass over the text."""
    if kind == WORD:
        pattern = rf"(?s)[^\p{{L}}](?=(\p{{L}}.{{{_WORD_TAIL}}}))"
    else:
        pattern = f"(?s)(?=(.{{{kind}}}))"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, lambda g: F.xxhash64(g)))


def _kind_of(text: Column) -> Column:
    out = F.when(text.rlike(rf"(?s)[^\p{{L}}]\p{{L}}.{{{_WORD_TAIL}}}"), F.lit(WORD))
    for size in GRAM_SIZES:
        out = out.when(F.length(text) >= size, F.lit(size))
    return out


def _spaced(runs: Column, choices: int) -> Column:
    """At most this many runs, spread evenly over the array."""
    n = F.size(runs)
    take = F.least(n, F.lit(choices))
    places = F.when(n > 0, F.sequence(F.lit(0), take - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places, lambda i: F.element_at(runs, F.floor(i * n / take).cast("int") + 1)
    )


def _anchors(needles: DataFrame, choices: int) -> DataFrame:
    """(needle, kind, gram): one run per needle as its join key, the one fewest needles share."""
    tagged = needles.withColumns(
        {"nid": F.sha2("needle", 256), "kind": _kind_of(F.col("needle"))}
    )
    runs = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for kind in (WORD, *GRAM_SIZES):
        runs = runs.when(F.col("kind") == kind, _runs(F.col("needle"), kind))
    each = tagged.select("nid", F.explode(let(runs, lambda r: _spaced(r, choices))).alias("gram"))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = (
        each.join(shared, "gram")
        .groupBy("nid")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    )
    return tagged.join(chosen, "nid").select("needle", "kind", "gram")


def contained_pairs(
    needles: DataFrame,
    needle: str,
    texts: DataFrame,
    text_id: str,
    text: str,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """(text_id, needle) for every text that holds the needle. Exact; blanks match nothing.

    A text holding a needle holds every run of the needle, so one run per
    needle is an equality join key and the containment test runs on the few
    candidates. The smaller side decides the join: needles within the broadcast
    limit are looked up while the texts stream by; else texts whose runs fit
    are looked up by the needles; else both are joined by run, one row per needle,
    and adaptive execution splits a run that very many texts hold. Needles longer than every text are left out at once; the
    others are read several times and so written once to the shared folder.
    """
    longest = texts.agg(F.max(F.length(text))).scalar()
    wanted = cut_lineage(
        needles.select(F.col(needle).alias("needle"))
        .filter((F.col("needle") != "") & (F.length("needle") <= longest))
        .distinct()
    )
    few = measured_bytes(wanted) <= broadcast_limit
    anchors = cut_lineage(_anchors(wanted, ANCHOR_CHOICES if few else FEW_CHOICES))
    kinds = anchors.agg(F.collect_set("kind")).scalar()
    hay = texts.select(F.col(text_id), F.col(text).alias("_text")).filter("_text <> ''")
    hay = hay.withColumn("_kinds", kinds)
    none = F.array().cast("array<bigint>")
    runs = F.concat(
        *[
            F.when(F.array_contains("_kinds", kind), _runs(F.col("_text"), kind)).otherwise(none)
            for kind in (WORD, *GRAM_SIZES)
        ]
    )
    if few:
        hits = hay.withColumn("gram", F.explode(runs)).join(F.broadcast(anchors), "gram")
        return hits.filter(F.contains("_text", "needle")).select(text_id, "needle")
    keyed = hay.select(text_id, F.explode(F.array_distinct(runs)).alias("gram"))
    if measured_bytes(hay.select(text_id, "_text")) * KEY_BYTES <= broadcast_limit:
        candidates = anchors.join(F.broadcast(keyed), "gram").select(text_id, "needle")
    else:
        # a run common in the texts is a skewed key, which an inner join splits as it needs
        candidates = keyed.join(anchors, "gram").select(text_id, "needle")
    return (
        candidates.join(hay.select(text_id, "_text"), text_id)
        .filter(F.contains("_text", "needle"))
        .select(text_id, "needle")
    )
