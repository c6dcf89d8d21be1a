"""Text expressions: blanks, trimming, folding, clean-up and shape predicates.

"Filled" means not NULL and not the empty string, everywhere in this package.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters that text trimming removes, as a regular
# expression class and as the characters themselves.
WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# HTML entities decoded by clean_text. The ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}

UUID_SHAPE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """fn applied to a value that is computed once per row, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def filled(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("")) != ""


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c).cast("string"), F.lit(""))


def first_filled(*cols: Column | str, default: str | None = None) -> Column:
    """The first filled column, else the default."""
    parts = [blank_to_null(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def first_filled_labelled(labelled: Mapping[str, Column | str]) -> Column:
    """struct(label, value) of the first filled column; NULL when none is."""
    out = None
    for label, c in labelled.items():
        pair = F.struct(F.lit(label).alias("label"), _col(c).cast("string").alias("value"))
        out = F.when(filled(c), pair) if out is None else out.when(filled(c), pair)
    return out


def trim_ws(c: Column | str) -> Column:
    """Strip every kind of white space at both ends (Spark's trim strips spaces only)."""
    return F.trim(_col(c), F.lit(WS_CHARS))


def has_text(c: Column | str) -> Column:
    """Filled with something other than white space; stops at the first such character."""
    return F.coalesce(_col(c).cast("string").rlike(WS.replace("[", "[^", 1)), F.lit(False))


def collapse_ws(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"{WS}+", " ")


def normalize_text(c: Column | str) -> Column:
    """Comparison form: white space collapsed and trimmed, case folded."""
    return F.lower(F.trim(collapse_ws(c)))


def strip_html(c: Column | str) -> Column:
    """Visible text: script and style bodies, comments and tags go, common entities are decoded."""
    text = F.regexp_replace(_col(c), r"(?is)<script\b.*?</script\s*>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_text(c: Column | str) -> Column:
    return F.trim(collapse_ws(strip_html(c)))


def slug(c: Column | str) -> Column:
    """Lower case, every run of other characters becomes one dash, no dash at the ends."""
    dashed = F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-|-\z", "")


def dash_spaces(c: Column | str) -> Column:
    """White space runs become dashes, after case folding."""
    return F.regexp_replace(F.lower(_col(c)), rf"{WS}+", "-")


def type_label(c: Column | str) -> Column:
    """The first dash becomes a space; later dashes stay."""
    return F.regexp_replace(_col(c), r"^([^-]*)-", "$1 ")


def parse_count(c: Column | str) -> Column:
    return _col(c).try_cast("bigint")


def has_email(c: Column | str) -> Column:
    # The cheap test first: most texts have no at sign at all.
    at = F.contains(_col(c), F.lit("@"))
    return F.coalesce(at & _col(c).rlike(r"\S+@\S+\.\S+"), F.lit(False))


def valid_phone(c: Column | str) -> Column:
    return F.coalesce(F.length(_col(c)) >= 10, F.lit(False))


def is_uuid(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(UUID_SHAPE), F.lit(False))


def language_suffix(c: Column | str, default: str = "en") -> Column:
    """' · FR' for a filled language other than the default, else the empty string."""
    return F.when(
        filled(c) & (_col(c) != default), F.concat(F.lit(" · "), F.upper(_col(c)))
    ).otherwise("")


def extract_section(c: Column | str, headings: str = "Eligibility|Who can apply|Eligible") -> Column:
    """Text after the first heading word up to the next blank line; NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(c), rf"(?is)({headings})(.*?)\n\n", 2), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Distinct folded words: runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def split_list(c: Column | str, separator: str = ";") -> Column:
    """A delimiter-packed text as an array of trimmed, non-blank parts (NULL stays NULL)."""
    parts = F.transform(F.split(_col(c), "[" + separator + "]"), trim_ws)
    return F.filter(parts, lambda p: p != "")


def contains_any(c: Column | str, terms: list[str]) -> Column:
    """Case-folded containment of any of the literal terms; false for NULL text."""
    wanted = [t.lower() for t in terms if t]
    if not wanted:
        return F.lit(False)

    def any_of(text: Column) -> Column:
        hits = [F.contains(text, F.lit(t)) for t in wanted]
        return reduce(lambda a, b: a | b, hits)

    return F.coalesce(let(F.lower(_col(c)), any_of), F.lit(False))
