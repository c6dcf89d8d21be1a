"""Content hashes and stable record keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.text import _col, blank_to_null, normalize_text, slug, trim_ws
from harrow.functions.urls import canonical_url


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def _joined(parts: Sequence[Column]) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_key(*cols: Column | str) -> Column:
    """The same business values always give the same key; NULL counts as blank.

    Every part is preceded by its length, so that no two lists of parts look alike.
    """
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]), 256)


def _part(c: Column | str, how: str) -> Column:
    if how == "url":
        return F.coalesce(canonical_url(c), trim_ws(c))
    if how == "text":
        return normalize_text(c)
    if how == "raw":
        return _col(c).cast("string")
    raise ValueError(f"unknown key part kind {how!r}")


def composite_key(parts: Mapping[str, str]) -> Column:
    """SHA-1 over normalised parts (column -> url, text or raw); NULL when every part is blank."""
    cols = [blank_to_null(_part(c, how)) for c, how in parts.items()]
    return F.when(F.coalesce(*cols).isNotNull(), F.sha1(_joined(cols)))


def primary_key(ids: Sequence[str], parts: Mapping[str, str], own_key: Column | str) -> Column:
    """First filled id, else the composite key, else the row's own key.

    The last step keeps rows that have neither id nor content from all
    sharing one NULL key.
    """
    return F.coalesce(
        *[blank_to_null(trim_ws(_col(i).cast("string"))) for i in ids],
        *([composite_key(parts)] if parts else []),
        F.concat(F.lit("row:"), _col(own_key).cast("string")),
    )


def link_key(record_id: Column | str, link: Column | str, own_key: Column | str) -> Column:
    """Record id, else SHA-1 of the link without query or fragment, else the row's own key."""
    bare = F.lower(F.regexp_replace(_col(link), r"[?#].*$", ""))
    return F.coalesce(
        blank_to_null(record_id),
        F.sha1(blank_to_null(bare)),
        F.concat(F.lit("row:"), _col(own_key).cast("string")),
    )


def day_bucket(ts: Column | str) -> Column:
    return F.to_date(F.date_trunc("day", _col(ts)))


def bucketed_key(key: Column | str, ts: Column | str) -> Column:
    """Key plus calendar day: edits within one day collapse, later ones do not."""
    return F.struct(_col(key).alias("key"), day_bucket(ts).alias("day"))


def slug_id(country: Column | str, region: Column | str, title: Column | str) -> Column:
    """CA-BC-some-title; blank parts are left out."""
    return F.concat_ws("-", blank_to_null(country), blank_to_null(region), blank_to_null(slug(title)))
