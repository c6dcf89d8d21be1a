"""Dates held in free text, days remaining, and the deadline buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.text import _col, let, trim_ws

# Month names by their first three letters.
MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

_MONTH_WORD = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?$"
_DAY_FIRST = rf"^(?i)(?:[a-z]{{3,9}},\s*)?(\d{{1,2}})\s+({_MONTH_WORD})\.?,?\s+(\d{{4}})(?:\s.*)?$"
_MONTH_FIRST = rf"^(?i)(?:[a-z]{{3,9}},\s*)?({_MONTH_WORD})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$"
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_RFC822 = (
    rf"^(?i)(?:[a-z]{{3}},\s*)?(\d{{1,2}})\s+({_MONTH_WORD})\s+(\d{{4}})\s+"
    r"(\d{2}:\d{2}(?::\d{2})?)\s+(GMT|UTC|UT|Z|[+-]\d{2}:?\d{2})$"
)

DEADLINE_TEXT = r"(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|\d{4}-\d{2}-\d{2})"


def _month(word: Column) -> Column:
    """Two-digit month of a month name; a number stays as it is."""
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.coalesce(F.element_at(names, F.lower(F.substring(word, 1, 3))), F.lpad(word, 2, "0"))


def _day_text(parts: Column) -> Column:
    """yyyy-mm-dd text from (year, month, day) parts."""
    return F.concat_ws(
        "-", F.element_at(parts, 1), _month(F.element_at(parts, 2)),
        F.lpad(F.element_at(parts, 3), 2, "0"),
    )


def parse_date(c: Column | str, slashes: str = "dmy") -> Column:
    """The calendar date as written, from ISO, RFC 822, spelled-month or slashed text.

    Slashed dates are read day first unless slashes="mdy". Unreadable text and
    impossible days give NULL; nothing is guessed.
    """
    parts = trim_ws(c)
    shapes = (
        (_ISO, "$1|$2|$3"),
        (_DAY_FIRST, "$3|$2|$1"),
        (_MONTH_FIRST, "$3|$1|$2"),
        (_SLASHED, "$3|$2|$1" if slashes == "dmy" else "$3|$1|$2"),
    )
    for shape, order in shapes:
        parts = F.regexp_replace(parts, shape, order)
    readable = r"^\d{4}\|\w+\|\d{1,2}$"
    return let(
        parts,
        lambda p: F.when(
            p.rlike(readable), _day_text(F.split(p, r"\|")).try_cast("date")
        ),
    )


def to_iso_date(c: Column | str, slashes: str = "dmy") -> Column:
    return parse_date(c, slashes).cast("string")


def _rfc822_text(parts: Column) -> Column:
    """Timestamp text with zone from (year, month, day, time, zone) parts."""
    zone = F.upper(F.element_at(parts, 5))
    offset = F.when(zone.isin("GMT", "UTC", "UT", "Z"), F.lit("+00:00")).otherwise(
        F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    )
    time = F.regexp_replace(F.element_at(parts, 4), r"^(\d{2}:\d{2})$", "$1:00")
    return F.concat(_day_text(parts), F.lit(" "), time, offset)


def parse_timestamp(c: Column | str) -> Column:
    """An instant from ISO text or an RFC 822 date with zone; a bare date gives midnight."""

    def read(s: Column) -> Column:
        rfc = F.split(F.regexp_replace(s, _RFC822, "$3|$2|$1|$4|$5"), r"\|")
        return F.coalesce(
            F.when(s.rlike(_RFC822), _rfc822_text(rfc).try_cast("timestamp")),
            F.when(s.rlike(_ISO), s.try_cast("timestamp")),
        )

    return F.coalesce(let(trim_ws(c), read), parse_date(c).cast("timestamp"))


def event_time(published: Column | str, page: Column | str, ingested: Column | str) -> Column:
    """Published time, else page time, else ingest time."""
    return F.coalesce(_col(published), _col(page), _col(ingested))


def extract_date_text(c: Column | str, pattern: str = DEADLINE_TEXT) -> Column:
    return F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit(""))


def days_until(day: Column | str, as_of: str) -> Column:
    return F.datediff(_col(day), F.lit(as_of).cast("date"))


def deadline_status(days: Column | str) -> Column:
    """Closed at or past the day, then 7 and 14 day steps; 'unknown' when there is no date."""
    d = _col(days)
    return (
        F.when(d.isNull(), "unknown")
        .when(d <= 0, "Closed")
        .when(d <= 7, "Closing soon")
        .when(d <= 14, "Due soon")
        .otherwise("Open")
    )


def deadline_severity(days: Column | str) -> Column:
    d = _col(days)
    return F.when(d <= 7, "destructive").when(d <= 14, "default").otherwise("secondary")


def is_urgent(days: Column | str) -> Column:
    d = _col(days)
    return F.coalesce((d > 0) & (d <= 7), F.lit(False))


def can_remind(days: Column | str) -> Column:
    return F.coalesce(_col(days) > 0, F.lit(False))


def remaining_text(days: Column | str) -> Column:
    d = _col(days)
    return (
        F.when(d.isNull(), "unknown")
        .when(d <= 0, "Deadline passed")
        .when(d == 1, "1 day remaining")
        .otherwise(F.concat(d.cast("string"), F.lit(" days remaining")))
    )
