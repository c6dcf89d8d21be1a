"""Validation rules, audits and the accept/reject split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import filled, has_text

Rules = Mapping[str, Column]


def required(columns: Sequence[str], trimmed: bool = True) -> dict[str, Column]:
    """Rule name -> condition that must hold: each column is filled, after trimming unless trimmed=False."""
    return {f"missing {c}": has_text(c) if trimmed else filled(c) for c in columns}


def required_any(columns: Sequence[str]) -> dict[str, Column]:
    """At least one of the columns is filled."""
    out = filled(columns[0])
    for c in columns[1:]:
        out = out | filled(c)
    return {"missing " + " or ".join(columns): out}


def well_formed(column: str = "_corrupt_record") -> dict[str, Column]:
    """The line fitted its declared schema (see readers.read_records)."""
    return {"malformed record": F.col(column).isNull()}


def in_vocabulary(allowed: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Each column is blank or one of its allowed words."""
    return {
        f"{c} not in vocabulary": ~filled(c) | F.col(c).isin(*words) for c, words in allowed.items()
    }


def spec_rules(spec: Mapping) -> dict[str, Column]:
    """Rules from a JSON-Schema-like object: required, and per property enum, const, minimum."""
    rules = required(spec.get("required", []))
    for name, prop in spec.get("properties", {}).items():
        c = F.col(name)
        if "enum" in prop:
            rules[f"{name} not in vocabulary"] = c.isNull() | c.isin(*prop["enum"])
        if "const" in prop:
            rules[f"{name} is not {prop['const']}"] = c.isNull() | (c == F.lit(prop["const"]))
        if "minimum" in prop:
            rules[f"{name} below {prop['minimum']}"] = c.isNull() | (c >= F.lit(prop["minimum"]))
    return rules


def validate(df: DataFrame, rules: Rules, column: str = "failed_rules") -> DataFrame:
    """Adds the names of the rules each row breaks; an empty array means valid."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(column, F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reasons); together they are the input."""
    checked = validate(df, rules)
    good = checked.filter(F.size("failed_rules") == 0).drop("failed_rules")
    return good, checked.filter(F.size("failed_rules") > 0)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent does not exist; a NULL key is an orphan too."""
    keys = parent.select(F.col(parent_key).alias("_pk"))
    return child.join(keys, F.col(child_key) == F.col("_pk"), "left_anti")


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children that survive when only the given parents remain."""
    keys = parent.select(F.col(parent_key).alias("_pk"))
    return child.join(keys, F.col(child_key) == F.col("_pk"), "left_semi")


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    )


def out_of_vocab(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is filled and not in the list."""
    return df.filter(filled(column) & ~F.col(column).isin(*allowed))


def resolve_path(column: str) -> Column:
    """struct(path, escapes): '.' and '..' applied segment by segment from the root."""

    def step(acc: Column, seg: Column) -> Column:
        up = seg == ".."
        empty = F.size(acc["s"]) == 0
        stack = (
            F.when((seg == "") | (seg == "."), acc["s"])
            .when(up & empty, acc["s"])
            .when(up, F.slice(acc["s"], F.lit(1), F.greatest(F.size(acc["s"]) - 1, F.lit(0))))
            .otherwise(F.array_append(acc["s"], seg))
        )
        return F.struct(stack.alias("s"), (acc["e"] | (up & empty)).alias("e"))

    start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(False).alias("e"))
    return F.aggregate(
        F.split(F.col(column), "/"),
        start,
        step,
        lambda acc: F.struct(F.array_join(acc["s"], "/").alias("path"), acc["e"].alias("escapes")),
    )


def audit_doc_paths(docs: DataFrame, files: DataFrame, column: str = "file_slug") -> DataFrame:
    """Adds resolved_path and path_status to document rows.

    Status, first that applies: bad_encoding, not_pdf, outside_root, missing,
    ok. files holds the landed paths relative to the root, as column path. The
    check works on path segments, so a sibling folder with the same prefix
    does not pass.
    """
    decoded = F.try_url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))
    known = files.select(F.col("path").alias("_file")).distinct()
    checked = docs.withColumn("_decoded", decoded).withColumn("_r", resolve_path("_decoded"))
    status = (
        F.when(F.col("_decoded").isNull(), "bad_encoding")
        .when(~F.lower("_decoded").endswith(".pdf"), "not_pdf")
        .when(F.col("_r.escapes"), "outside_root")
        .when(F.col("_file").isNull(), "missing")
        .otherwise("ok")
    )
    return (
        checked.withColumn("resolved_path", F.col("_r.path"))
        .join(known, F.col("resolved_path") == F.col("_file"), "left")
        .withColumn("path_status", status)
        .drop("_decoded", "_r", "_file")
    )
