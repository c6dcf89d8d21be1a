"""Merging records of several sources into one record per program."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.keys import composite_key, day_bucket, primary_key
from harrow.functions.money import normalize_money
from harrow.functions.text import blank_to_null, clean_text, first_filled
from harrow.functions.urls import TRACKING_PARAMS, canonical_url, host
from harrow.operators.clusters import with_clusters
from harrow.operators.fuzzy import match_edges
from harrow.operators.reshape import union_sources
from harrow.operators.survivorship import source_rank, survive, union_rows, url_alternates
from harrow.operators.windows import diff_history, keep_latest, mark_superseded, retain, with_payload
from harrow.session import cut_lineage


@dataclass(frozen=True)
class Policy:
    """How sources are matched and which of their values survive.

    precedence: sources, best first. fields: field -> survivorship rule.
    id_pattern: record number inside the link or title; its group 1 equals the
    number column of the record it refers to. kinds: columns whose values never
    merge with each other, with the value that a blank stands for. block: where
    titles are compared, the first filled of these. day_sources: sources whose records of one key stay
    apart when published on different days. money: text field -> (locale,
    decimal places) it is read with. cleaned: text fields stripped of markup.
    audited: fields whose changes are kept, for history_days.
    """

    precedence: Sequence[str]
    fields: Mapping[str, str | Sequence[str]]
    threshold: float = 0.88
    id_pattern: str | None = None
    kinds: Mapping[str, str] = field(default_factory=dict)
    block: Sequence[str] = ("host",)
    day_sources: Sequence[str] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    tracking: Sequence[str] = TRACKING_PARAMS
    money: Mapping[str, tuple[str, int]] = field(default_factory=dict)
    cleaned: Sequence[str] = ()
    audited: Sequence[str] = ()
    history_days: int = 365


@dataclass(frozen=True)
class SourceKey:
    """How records of one source are identified.

    ids: id columns, best first. parts: what is hashed when they are blank
    (column -> url, text or raw). second: the same for a secondary key. urls:
    columns holding the link, best first; template: the link where none does,
    with a column's name in braces. number: the column that other sources name the
    record by. by_day: records of one key stay apart when published on different days.
    """

    ids: Sequence[str] = ()
    parts: Mapping[str, str] = field(default_factory=dict)
    second: Mapping[str, str] = field(default_factory=dict)
    urls: Sequence[str] = ("link",)
    template: str | None = None
    number: str | None = None
    by_day: bool = False


def _from_template(template: str) -> Column:
    """The text with the columns in braces filled in; NULL when one of them is blank."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[blank_to_null(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def with_keys(df: DataFrame, spec: SourceKey, record: str = "record_id") -> DataFrame:
    """Adds key, second_key, link, and number where the source has one, to the records of one source."""
    second = composite_key(spec.second) if spec.second else F.lit(None).cast("string")
    links = [blank_to_null(c) for c in spec.urls]
    if spec.template:
        links.append(_from_template(spec.template))
    added = {
        "key": primary_key(spec.ids, spec.parts, record),
        "second_key": second,
        "link": F.coalesce(*links),
    }
    if spec.number:
        added["number"] = F.col(spec.number).cast("string")
    return df.withColumns(added)


def normalize_fields(df: DataFrame, policy: Policy) -> DataFrame:
    """Money texts as numbers and marked-up texts as plain ones, for the columns present."""
    money = {
        c: normalize_money(c, locale, places)
        for c, (locale, places) in policy.money.items()
        if c in df.columns
    }
    cleaned = {c: clean_text(c) for c in policy.cleaned if c in df.columns}
    return df.withColumns({**money, **cleaned}) if money or cleaned else df


def prepare(frames: Sequence[DataFrame], policy: Policy) -> DataFrame:
    """Records of all sources with canonical_url, host and rank.

    Frames have record_id (unique), source, key (from keys.primary_key), title,
    link, published_at, and of number, second_key, the kinds and the fields of the
    policy those that the source knows.
    """
    url = canonical_url("link", policy.aliases, policy.tracking)
    records = normalize_fields(union_sources(frames), policy).withColumn("canonical_url", url)
    records = records.withColumns(
        {"host": host("canonical_url"), "rank": source_rank("source", policy.precedence)}
    )
    # a value that stands for a kind or a block is marked with the column it is from
    kinds = [
        first_filled(c, default=blank) if c in records.columns else F.lit(blank)
        for c, blank in policy.kinds.items()
    ]
    blocks = [F.concat(F.lit(f"{c}:"), blank_to_null(c)) for c in policy.block if c in records.columns]
    return records.withColumns(
        {"_kind": F.to_json(F.array(*kinds)) if kinds else F.lit(""), "_block": F.coalesce(*blocks)}
    )


def within_sources(records: DataFrame, policy: Policy) -> DataFrame:
    """The newest record per source and key, per day where the policy says so."""
    day = F.when(F.col("source").isin(*policy.day_sources), day_bucket("published_at").cast("string"))
    keyed = records.withColumn(
        "_slot", F.concat_ws("|", "source", "key", F.coalesce(day, F.lit("")))
    )
    return keep_latest(keyed, "_slot", ["published_at"], "record_id").drop("_slot")


def _shared(records: DataFrame, columns: Sequence[str], filled: Sequence[str]) -> DataFrame:
    """(u, v): the first record of each combination of values to every other one of it."""
    known = records
    for c in filled:
        known = known.filter(blank_to_null(c).isNotNull())
    first = known.groupBy(*columns).agg(F.min("record_id").alias("u"))
    return (
        known.select("record_id", *columns)
        .join(first, list(columns))
        .select("u", F.col("record_id").alias("v"))
        .filter("u <> v")
    )


def _named(records: DataFrame, policy: Policy, kind: Sequence[str]) -> DataFrame:
    """(u, v): the first record of a number to every record naming it in its link or title."""
    owners = (
        records.filter(blank_to_null("number").isNotNull())
        .groupBy(*kind, F.col("number").alias("_n"))
        .agg(F.min("record_id").alias("u"))
    )

    def named_in(column: str) -> DataFrame:
        parsed = F.regexp_extract(column, policy.id_pattern, 1).alias("_n")
        return records.select("record_id", *kind, parsed).filter("_n <> ''")

    refs = named_in("link").unionByName(named_in("title")).distinct()
    return (
        refs.join(owners, [*kind, "_n"])
        .select("u", F.col("record_id").alias("v"))
        .filter("u <> v")
    )


def links(records: DataFrame, policy: Policy) -> DataFrame:
    """(u, v): pairs of records that are one program.

    They share a number, or a secondary key within their source, or one names
    the other's number, or their titles on one host (or of one agency, as the
    policy's block says) are similar. Every link is between records of one kind, so
    a cluster never holds two kinds, through whatever records it runs. Records that
    share a value link to the first of them, so links grow with the records.
    """
    kind = ["_kind"]
    found = [match_edges(records, "record_id", "title", ["_block", *kind], policy.threshold)]
    if "number" in records.columns:
        found.append(_shared(records, ["number", *kind], ["number"]))
        if policy.id_pattern:
            found.append(_named(records, policy, kind))
    if "second_key" in records.columns:
        found.append(_shared(records, ["source", "second_key", *kind], ["second_key"]))
    return union_sources(found)


def _clustered(frames: Sequence[DataFrame], policy: Policy) -> DataFrame:
    # matching reads the deduplicated records several times
    records = cut_lineage(within_sources(prepare(frames, policy), policy))
    return with_clusters(records, "record_id", links(records, policy))


@dataclass(frozen=True)
class Merged:
    """The merge of a territory.

    records: one per program, as merge_sources. members: every kept record with its
    cluster, and payload, the record as JSON. alternates: (cluster, alternate), the
    raw links other than the canonical one. values: (cluster, field, value), the
    distinct entries of list fields as rows. history: (cluster, published_at,
    record_id, field, old_value, new_value), what changed from one record of a
    program to the next.
    """

    records: DataFrame
    members: DataFrame
    alternates: DataFrame
    values: DataFrame
    history: DataFrame


def merge_territory(
    sources: Mapping[str, DataFrame], policy: Policy, keys: Mapping[str, SourceKey], record: str = "record_id"
) -> Merged:
    """The raw records of a territory's sources, by source name, merged as its policy says."""
    frames = [with_keys(df, keys[s], record).withColumn("source", F.lit(s)) for s, df in sources.items()]
    raw = [c for f in frames for c in f.columns]
    members = cut_lineage(_clustered(frames, policy))
    fields = {c: rule for c, rule in policy.fields.items() if c in members.columns}
    lists = [c for c, rule in fields.items() if rule == "union_unique"]
    audited = [c for c in policy.audited if c in members.columns]
    order = ["published_at", record]
    known = [c for c in dict.fromkeys(raw) if c in members.columns]
    return Merged(
        survive(members, "cluster", fields),
        with_payload(members.select("cluster", *known)),
        url_alternates(members, "cluster", "link", "canonical_url"),
        union_rows(members, "cluster", lists),
        diff_history(members.withColumns({c: F.col(c).cast("string") for c in audited}), "cluster", order, audited),
    )


def merge_sources(frames: Sequence[DataFrame], policy: Policy) -> DataFrame:
    """(cluster, n_records, fields...): one record per cluster of matching records.

    The result does not depend on row order or partitioning.
    """
    clustered = _clustered(frames, policy)
    return survive(clustered, "cluster", {c: r for c, r in policy.fields.items() if c in clustered.columns})


def audit_history(
    snapshots: DataFrame, key: str, time: str, policy: Policy, as_of: str
) -> DataFrame:
    """Field changes between kept snapshots of merged records: (key, time, field, old, new)."""
    kept = retain(snapshots, time, as_of, policy.history_days)
    fields = [c for c in policy.audited if c in snapshots.columns]
    return diff_history(kept, key, [time], fields)


def latest_publish_wins(
    records: DataFrame, key: str, fields: Mapping[str, str], record: str = "record_id"
) -> tuple[DataFrame, DataFrame]:
    """(merged, all records with superseded_by): the newest publish date decides a conflict."""
    merged = survive(records, key, fields, record=record)
    return merged, mark_superseded(records, key, ["published_at"], record)
