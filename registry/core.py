"""Registration, and SQL snippets the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame function, with its SQL where there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def micros(column: str):
    """A time as microseconds since 1970, read as UTC when it carries no zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+\\z', '', 'g')"


def stable_key(*cols: str) -> str:
    """SQL of the key over these values: each part after its length."""
    parts = [f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols]
    return f"sha256({' || '.join(f'length({p}) || chr(58) || {p}' for p in parts)})"


def filled(c: str) -> str:
    return f"(coalesce({c}, '') <> '')"


def first_filled(*cols: str, default: str | None = None) -> str:
    parts = [f"nullif({c}, '')" for c in cols] + ([f"'{default}'"] if default else [])
    return f"coalesce({', '.join(parts)})"


def norm(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' '))"


URL = r"(?i)^https?://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$"
TRACKING = "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid')"


def host(c: str) -> str:
    return f"nullif(lower(regexp_extract({trim(c)}, '{URL}', 1)), '')"


def bare_url(c: str, alias_case: str | None = None) -> str:
    h = alias_case or host(c)
    return f"('https://' || {h} || regexp_extract({trim(c)}, '{URL}', 2))"


def canonical_url(c: str, alias_case: str | None = None) -> str:
    kept = (
        f"list_filter(string_split(substr(regexp_extract({trim(c)}, '{URL}', 3), 2), '&'), "
        f"lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {TRACKING})"
    )
    tail = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    return f"({bare_url(c, alias_case)} || {tail})"


ENTITY_STEPS = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "''"),
    ("&amp;", "&"),
)


def strip_html(c: str) -> str:
    out = f"regexp_replace({c}, '(?is)<script\\b.*?</script\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<style\\b.*?</style\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, char in ENTITY_STEPS:
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def tokens(c: str) -> str:
    words = f"regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+')"
    return f"list_distinct(list_filter({words}, lambda w: w <> ''))"


# The engine behind the oracles counts edits in bytes. Giving each accented
# letter of the tables a single-byte stand-in makes it count letters.
_ACCENTED = "êçÇíéèÍÈÑäÜÉßñÊÄüóÓöÖ"
_STAND_INS = "||".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])


def edits(a: str, b: str) -> str:
    one = f"translate({{}}, '{_ACCENTED}', {_STAND_INS})"
    return f"levenshtein({one.format(a)}, {one.format(b)})"
