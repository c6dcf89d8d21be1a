"""Rule tables: inference, classification, priorities and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import _col, contains_any
from harrow.vocab import (
    APPLICANT_RULES,
    CLOSE_DAYS,
    HIGH_VALUE,
    PRIORITY_TITLE,
    ROUTES,
    SECTOR_TERMS,
)


def first_rule(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(default))
    for condition, value in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(value))
    return out.otherwise(F.lit(default))


def infer_sector(title: Column | str, terms: Sequence[str] = SECTOR_TERMS) -> Column:
    return F.when(contains_any(title, list(terms)), "agriculture")


def infer_status(text: Column | str) -> Column:
    """open before closed, in the listed order."""
    return first_rule(
        [
            (contains_any(text, ["open", "Applications open"]), "open"),
            (contains_any(text, ["closed", "Applications closed"]), "closed"),
        ]
    )


def _words(c: Column | str, terms: Sequence[str]) -> Column:
    """Any term, as containment; terms in capitals only are matched in capitals."""
    text = _col(c)
    exact = [t for t in terms if t.isupper()]
    loose = [t for t in terms if not t.isupper()]
    out = contains_any(text, loose)
    for t in exact:
        out = out | F.coalesce(F.contains(text, F.lit(t)), F.lit(False))
    return out


def applicant_classes(text: Column | str, rules: Mapping = APPLICANT_RULES) -> Column:
    """Sorted array of the classes whose terms the text holds."""
    hits = []
    for name in sorted(rules):
        hit = _words(text, rules[name]["match_any"])
        if rules[name].get("must_have_any"):
            hit = hit & _words(text, rules[name]["must_have_any"])
        hits.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*hits))


def classify(
    df: DataFrame, text: str, rules: Mapping = APPLICANT_RULES, only_matches: bool = True
) -> DataFrame:
    """Adds applicant_types; rows without any are dropped unless only_matches=False."""
    out = df.withColumn("applicant_types", applicant_classes(text, rules))
    return out.filter(F.size("applicant_types") > 0) if only_matches else out


def alert_priority(
    source: str = "source",
    amount: str = "funding_amount_brl",
    status: str = "status",
    days_left: str = "days_left",
    title: str = "title",
) -> Column:
    """high or medium by the first rule that holds, else NULL."""
    s = F.col(source)
    return first_rule(
        [
            ((s == "portal_transparencia") & (F.col(amount) >= HIGH_VALUE), "high"),
            ((F.col(status) == "modified") & (F.col(days_left) <= CLOSE_DAYS), "high"),
            (F.col(title).rlike(PRIORITY_TITLE), "high"),
            (s == "mapa_news", "medium"),
            (s == "bndes_news", "medium"),
        ]
    )


def news_priority(source: str = "source", title: str = "title") -> Column:
    """The feed variant: rules on the title's words."""
    return first_rule(
        [
            (
                (F.col(source) == "rss") & contains_any(title, ["PSGF", "wellbeing", "catchment"]),
                "high",
            ),
            (contains_any(title, ["dairy", "cattle", "sheep", "water"]), "medium"),
        ]
    )


def route(df: DataFrame, rules: Sequence[tuple[str, str, Sequence[str]]] = ROUTES) -> DataFrame:
    """One row per destination; a destination named by several matching rules appears once.

    The rules are a short literal list, so routing is a projection without a join.
    """
    none = F.array().cast("array<string>")
    hits = [
        F.when(F.col(column) == value, F.array(*[F.lit(d) for d in destinations])).otherwise(none)
        for column, value, destinations in rules
    ]
    return df.withColumn("destination", F.explode(F.array_distinct(F.flatten(F.array(*hits)))))
