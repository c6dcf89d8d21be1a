"""URL expressions: canonical form, host and path depth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.text import let, trim_ws

# Query parameters dropped as tracking.
TRACKING_PARAMS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "gclid",
    "fbclid",
)

# host, port, path, query; user information before the host is not kept
_SHAPE = r"^(?i)https?://(?:[^/?#\s@]*@)?(\[[^\]\s]*\]|[^/?#\s:@]+)((?::\d*)?)((?:/[^?#\s]*)?)(\?[^#\s]*)?(#\S*)?$"


def host(c: Column | str) -> Column:
    """Lower-case host without port and user information; NULL when the value is no http(s) URL."""
    return F.nullif(F.lower(F.regexp_extract(trim_ws(c), _SHAPE, 1)), F.lit(""))


def _aliased(h: Column, aliases: Mapping[str, str]) -> Column:
    if not aliases:
        return h
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), h), h)


def canonical_url(
    c: Column | str,
    aliases: Mapping[str, str] | None = None,
    tracking: Sequence[str] = TRACKING_PARAMS,
    keep_query: bool = True,
) -> Column:
    """https, lower-case host after aliasing, no user information, fragment or tracking parameters.

    A port stays. keep_query=False drops the whole query instead. Anything that is no http(s)
    URL gives NULL. The path keeps its case; an empty path stays empty.
    """

    def build(raw: Column) -> Column:
        name = F.nullif(F.lower(F.regexp_extract(raw, _SHAPE, 1)), F.lit(""))
        h = _aliased(name, dict(aliases or {}))
        base = F.concat(F.lit("https://"), h, F.regexp_extract(raw, _SHAPE, 2), F.regexp_extract(raw, _SHAPE, 3))
        return F.concat(base, _kept_query(raw, tracking)) if keep_query else base

    return let(trim_ws(c), build)


def _kept_query(raw: Column, tracking: Sequence[str]) -> Column:
    """'?a=1&b=2' without tracking parameters, or the empty string."""
    query = F.substring(F.regexp_extract(raw, _SHAPE, 4), 2, 2**31 - 1)
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*tracking),
    )
    joined = F.array_join(kept, "&")
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")


def path_depth(c: Column | str) -> Column:
    """Number of non-empty path segments."""
    path = F.regexp_extract(trim_ws(c), _SHAPE, 3)
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
