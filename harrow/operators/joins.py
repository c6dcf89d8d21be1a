"""Parent-child joins, enrichment and dimension lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import blank_to_null, has_text
from harrow.session import broadcast_if_small
from harrow.vocab import ANSWERS, DEFAULT_ANSWER, DEFAULT_PROGRAM, LOCATION_PROGRAMS


def _with_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parents LEFT JOIN children on id = program_id, as matched rows plus childless parents.

    One parent may own a large share of the children. An inner join can be
    split on that key at run time; the child side of an outer join cannot.
    """
    owners = children.select("program_id").distinct()
    matched = parents.join(children, parents["id"] == children["program_id"])
    alone = parents.join(owners, parents["id"] == owners["program_id"], "left_anti")
    return matched.drop("program_id").unionByName(alone, allowMissingColumns=True)


def with_documents(programs: DataFrame, docs: DataFrame) -> DataFrame:
    """Programs with their documents, one row per document; programs without keep one row."""
    return _with_children(programs, docs)


def with_attributes(programs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Programs with their attributes, one row per attribute; programs without keep one row."""
    return _with_children(programs, attributes)


def doc_counts(programs: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents per program, 0 included. Counts first, so each program joins one row."""
    counts = docs.groupBy("program_id").agg(F.count("doc_id").alias("n"))
    return programs.join(counts, programs["id"] == counts["program_id"], "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("documents")
    )


def counts_for(dim: DataFrame, stats: DataFrame, column: str) -> DataFrame:
    """Every dimension value with its count, 0 where there is none."""
    return dim.join(stats, column, "left").select(column, F.coalesce("count", F.lit(0)).alias("count"))


def attach_file_hash(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """sha256 of the landed file of the same name; NULL when it is missing."""
    per_name = hashes.groupBy("file_name").agg(F.min(F.struct("path", "sha256")).alias("f"))
    return (
        docs.drop("sha256")
        .join(per_name, "file_name", "left")
        .withColumns({"file_present": F.col("f").isNotNull(), "sha256": F.col("f.sha256")})
        .drop("f")
    )


def rule_by_prefix(
    df: DataFrame,
    column: str,
    rules: Sequence[tuple] = LOCATION_PROGRAMS,
    default: Sequence[str] = DEFAULT_PROGRAM,
    names: Sequence[str] = ("program", "rule_type", "next_date"),
) -> DataFrame:
    """The first rule whose prefix starts the value, else the default row.

    The rules are a short literal list, so they become one CASE chain per
    output column. matched tells a rule from the default.
    """

    def chain(values: Sequence, otherwise) -> Column:
        out = F.when(F.lit(False), F.lit(otherwise))
        for rule, value in zip(rules, values):
            out = out.when(F.col(column).startswith(rule[0]), F.lit(value))
        return out.otherwise(F.lit(otherwise))

    added = {
        n: chain([r[i + 1] for r in rules], default[i]) for i, n in enumerate(names)
    }
    return df.withColumns({**added, "matched": chain([True] * len(rules), False)})


def prefix_join(df: DataFrame, column: str, rules: DataFrame, default: Mapping[str, str]) -> DataFrame:
    """rule_by_prefix for a rule table (prefix, priority, values...) of any size.

    An equality join on every prefix of the value, of the lengths the rules use,
    keeps the rule of lowest priority number. The input column must identify
    its rule, so the match is found once per distinct value.
    """
    values = [c for c in rules.columns if c not in ("prefix", "priority")]
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("l")).scalar()
    distinct = df.select(F.col(column).alias("_v")).filter(F.col(column).isNotNull()).distinct()
    probes = distinct.withColumn("_lens", lengths).select(
        "_v", F.explode(F.transform("_lens", lambda n: F.substring("_v", F.lit(1), n))).alias("prefix")
    )
    best = (
        probes.distinct()
        .join(broadcast_if_small(rules), "prefix")
        .groupBy("_v")
        .agg(F.min_by(F.struct(*values), F.struct("priority", "prefix")).alias("_r"))
    )
    out = df.join(best, F.col(column) == F.col("_v"), "left")
    filled_in = {v: F.coalesce(F.col(f"_r.{v}"), F.lit(default[v])) for v in values}
    return out.withColumns({**filled_in, "matched": F.col("_r").isNotNull()}).drop("_v", "_r")


def answer_lookup(messages: DataFrame, text: str, answers: Mapping = ANSWERS) -> DataFrame:
    """The canned answer and intent of each non-blank message, else the default answer."""
    spark = messages.sparkSession
    table = spark.createDataFrame(
        [(q, intent, a) for q, (intent, a) in answers.items()],
        "question string, intent string, answer string",
    )
    asked = messages.filter(has_text(text))
    return (
        asked.join(F.broadcast(table), F.col(text) == F.col("question"), "left")
        .withColumn("answer", F.coalesce("answer", F.lit(DEFAULT_ANSWER)))
        .drop("question")
    )


def hydrate(listed: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """List records with detail values where the detail record has them.

    Detail is expected to have one row per key. Columns of both sides prefer
    the detail value; the others are carried along.
    """
    shared = [c for c in listed.columns if c in detail.columns and c != key]
    extra = [c for c in detail.columns if c not in listed.columns]
    left, right = listed.alias("l"), detail.alias("d")
    return left.join(right, F.col(f"l.{key}") == F.col(f"d.{key}"), "left").select(
        F.col(f"l.{key}"),
        *[F.coalesce(F.col(f"d.{c}"), F.col(f"l.{c}")).alias(c) for c in shared],
        *[F.col(f"l.{c}") for c in listed.columns if c != key and c not in shared],
        *[F.col(f"d.{c}") for c in extra],
    )


def link_by_parsed_id(
    left: DataFrame, text: str, pattern: str, right: DataFrame, right_id: str, group: int = 1
) -> DataFrame:
    """Left rows joined to the right row whose id their text or URL contains."""
    parsed = blank_to_null(F.regexp_extract(F.col(text), pattern, group))
    return left.withColumn("parsed_id", parsed).join(
        right, F.col("parsed_id") == right[right_id].cast("string")
    )


def request_matrix(
    keywords: DataFrame, keyword: str, regions: Sequence[str], template: str
) -> DataFrame:
    """One request URL per keyword and region.

    The regions are a short literal list of already encoded names, so each
    keyword row fans out in place. Keywords are encoded with %20 for spaces.
    """
    encoded = F.replace(F.url_encode(F.col(keyword)), F.lit("+"), F.lit("%20"))
    fanned = keywords.withColumn("region", F.explode(F.array(*[F.lit(r) for r in regions])))
    url = F.replace(
        F.replace(F.lit(template), F.lit("{keyword}"), encoded), F.lit("{region}"), F.col("region")
    )
    return fanned.withColumn("url", url)


def only_seeded(df: DataFrame, seeds: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The rows whose key is in the authoritative list."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(seeds.select(*keys).distinct(), keys, "left_semi")
