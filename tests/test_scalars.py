"""Expressions on hand-made values, blanks and malformed ones included."""

import datetime
from decimal import Decimal

import pytest
from harrow.functions import dates, keys, money, text, urls
from pyspark.sql import functions as F


def values(spark, inputs, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, s {kind}")
    return [r[0] for r in df.orderBy("i").select(expr.alias("v")).collect()]


def test_filled_and_trim(spark):
    names = [None, "", "  ", "\t\n", "0", " x﻿"]
    assert values(spark, names, text.filled("s")) == [False, False, True, True, True, True]
    assert values(spark, names, text.filled(text.trim_ws("s"))) == [False] * 4 + [True, True]
    assert values(spark, names, text.trim_ws("s")) == [None, "", "", "", "0", "x"]


def test_first_filled_keeps_zero(spark):
    assert values(spark, ["0", "", None], text.first_filled("s", default="d")) == ["0", "d", "d"]


def test_clean_text(spark):
    html = "<p>A&nbsp;&amp; <b>B</b></p>\n<script>x<y</script><!-- c --><style>p{}</style> &lt;C&gt; &amp;lt;"
    assert values(spark, [html, None], text.clean_text("s")) == ["A & B <C> &lt;", None]


def test_labels_and_slugs(spark):
    assert values(spark, ["a-b-c", "ab", None], text.type_label("s")) == ["a b-c", "ab", None]
    assert values(spark, ["Agri  Innovate! (2)", "--"], text.slug("s")) == ["agri-innovate-2", ""]
    assert values(spark, ["Rotational  Grazing"], text.dash_spaces("s")) == ["rotational-grazing"]
    assert values(spark, ["Honey Bee", ""], keys.slug_id(F.lit("CA"), F.lit("BC"), "s")) == ["CA-BC-honey-bee", "CA-BC"]


def test_predicates(spark):
    mails = ["a@b.co", "x a@b.co!", "a@b", "", None]
    assert values(spark, mails, text.has_email("s")) == [True, True, False, False, False]
    assert values(spark, ["5551234567", "555123456", None], text.valid_phone("s")) == [True, False, False]
    ids = ["0aF3b2c4-1111-2222-3333-444455556666", "0aF3b2c4-1111-2222-3333-444455556666\n", "x", None]
    assert values(spark, ids, text.is_uuid("s")) == [True, False, False, False]


def test_language_suffix(spark):
    assert values(spark, ["fr", "en", "", None], text.language_suffix("s")) == [" · FR", "", "", ""]


def test_section(spark):
    docs = ["x Eligibility: a\nb\n\nrest", "Who can apply ok\n\n", "Eligibility without end", None]
    assert values(spark, docs, text.extract_section("s")) == [": a\nb", " ok", None, None]


URLS = {
    "http://WWW.grants.gov/Path?utm_source=x&id=5&GCLID=1#frag": "https://grants.gov/Path?id=5",
    " https://m.site.org ": "https://m.site.org",
    "https://a.org/x?utm_medium=1": "https://a.org/x",
    "https://a.org/x?b&&c=": "https://a.org/x?b&c=",
    "ftp://a.org": None,
    "a.org/x": None,
    "http://": None,
    "": None,
    None: None,
}


def test_canonical_url(spark):
    out = urls.canonical_url("s", {"www.grants.gov": "grants.gov"})
    assert values(spark, list(URLS), out) == list(URLS.values())
    again = values(spark, [u for u in URLS.values() if u], out)
    assert again == [u for u in URLS.values() if u]


def test_canonical_url_without_query(spark):
    assert values(spark, ["https://a.org/x?id=1#t"], urls.canonical_url("s", keep_query=False)) == ["https://a.org/x"]
    assert values(spark, ["https://a.org/x//y/", None], urls.path_depth("s")) == [2, None]


DATES = {
    "2025-09-26": "2025-09-26",
    "2025-9-6": "2025-09-06",
    "2025-09-26T10:00:00Z": "2025-09-26",
    "Fri, 26 Sep 2025 10:00:00 GMT": "2025-09-26",
    "26 September 2025": "2025-09-26",
    "Friday, 26 Sept 2025": "2025-09-26",
    "November 15, 2024": "2024-11-15",
    "03/04/2025": "2025-04-03",
    "31 Feb 2025": None,
    "2025-13-01": None,
    "Rolling": None,
    "14 Marching 2025": None,
    "": None,
    None: None,
}


def test_dates(spark):
    assert values(spark, list(DATES), dates.to_iso_date("s")) == list(DATES.values())
    assert values(spark, ["03/04/2025"], dates.to_iso_date("s", "mdy")) == ["2025-03-04"]


def test_instants(spark):
    given = ["Fri, 26 Sep 2025 10:00:00 +1200", "26 Sep 2025 10:00 GMT", "2025-09-26 01:02:03", "26/09/2025", "x"]
    want = [
        datetime.datetime(2025, 9, 25, 22),
        datetime.datetime(2025, 9, 26, 10),
        datetime.datetime(2025, 9, 26, 1, 2, 3),
        datetime.datetime(2025, 9, 26),
        None,
    ]
    got = values(spark, given, F.date_format(dates.parse_timestamp("s"), "yyyy-MM-dd HH:mm:ss"))
    assert got == [w and w.strftime("%Y-%m-%d %H:%M:%S") for w in want]


def test_deadline_buckets(spark):
    days = [8, 24, -3, 113, 0, 1, 7, 14, 15, None]
    status = ["Due soon", "Open", "Closed", "Open", "Closed", "Closing soon", "Closing soon", "Due soon", "Open", "unknown"]
    assert values(spark, days, dates.deadline_status("s"), "int") == status
    assert values(spark, days, dates.is_urgent("s"), "int") == [d is not None and 0 < d <= 7 for d in days]
    assert values(spark, [0, 1, 2, None], dates.remaining_text("s"), "int") == [
        "Deadline passed", "1 day remaining", "2 days remaining", "unknown",
    ]
    assert values(spark, [7, 14, 15], dates.deadline_severity("s"), "int") == ["destructive", "default", "secondary"]


def test_amounts(spark):
    texts = ["from $1,000 up to $30,000", "AUD 1.000.000", "$5", "none", None]
    assert values(spark, texts, money.extract_amount("s")) == [Decimal("30000.00"), None, None, None, None]
    assert values(spark, texts, money.extract_amount("s", "first")) == [Decimal("1000.00"), None, None, None, None]
    years = ["Round 2025: up to $500", "Round 2025: up to 500.00", "2024 to 2026, $1,000 or $90", "$2025 of 1.000.000", "$1.2.3 or 700"]
    assert values(spark, years, money.extract_amount("s")) == [Decimal("500.00"), Decimal("2025.00"), Decimal("1000.00"), Decimal("2025.00"), None]
    assert values(spark, years[:3], money.extract_amount("s", "max")) == [Decimal("2025.00"), Decimal("2025.00"), Decimal("2026.00")]
    with pytest.raises(ValueError):
        money.extract_amount("s", "last")


def test_money_by_locale(spark):
    assert values(spark, ["R$ 1.000.000,505", "x", ""], money.normalize_money("s", "pt-BR")) == [Decimal("1000000.51"), None, None]
    assert values(spark, ["$1.234.567"], money.normalize_money("s", "es-CL", 0)) == [Decimal("1234567")]
    assert values(spark, ["US$1,234.5"], money.normalize_money("s", "en-US")) == [Decimal("1234.50")]


def test_keys(spark):
    df = spark.createDataFrame(
        [("1", " id ", "http://a.org/x#f", "T  itle"), ("2", "", "https://a.org/x", "t itle "), ("3", None, None, None), ("4", "", "", " ")],
        "row string, guid string, link string, title string",
    )
    parts = {"link": "url", "title": "text"}
    got = {r[0]: r[1] for r in df.select("row", keys.primary_key(["guid"], parts, "row")).collect()}
    assert got["1"] == "id" and got["3"] == "row:3" and got["4"] == "row:4"
    bare = {r[0]: r[1] for r in df.select("row", keys.composite_key(parts)).collect()}
    assert bare["1"] == bare["2"] and bare["3"] is None
    linked = {r[0]: r[1] for r in df.select("row", keys.link_key("guid", "link", "row")).collect()}
    assert linked["3"] == "row:3" and linked["4"] == "row:4" and linked["2"] != "row:2"


def test_tokens_and_lists(spark):
    assert values(spark, ["Été, a-b A 2x", None], text.tokens("s")) == [["été", "a", "b", "2x"], []]
    assert values(spark, ["cow-calf; dairy;; mixed ", None], text.split_list("s")) == [["cow-calf", "dairy", "mixed"], None]
    assert values(spark, ["a|b| "], text.split_list("s", "|")) == [["a", "b"]]
