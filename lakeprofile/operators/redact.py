"""Redaction of published values: masked, dropped or hashed."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "[redacted]"


def digest(value: Column, salt: str) -> Column:
    """Sixteen hex digits of the salted value; equal values stay equal under one salt."""
    if not salt:
        raise ValueError("a hash needs a salt")
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\x1f"), value), 256), 1, 16)


def redact(values: DataFrame, column: str, rule: str, salt: str = "", rank: tuple[str, ...] = ()) -> DataFrame:
    """``values`` with ``column`` masked or hashed, or its literals dropped; nulls stay null."""
    c = F.col(f"`{column}`")
    if rule == "mask":
        return values.withColumn(column, F.when(c.isNotNull(), MASK))
    if rule == "hash":
        return values.withColumn(column, digest(c, salt))
    if rule == "drop":
        return values.drop(column)
    raise ValueError(f"unknown rule {rule}")


#: Statistics whose numbers are values of the column: a redacted column does not publish them.
WITHHELD = ("range", "percentiles", "mean", "sum")


def redact_profile(profile: DataFrame, rules: list[tuple[str, str]], salt: str = "") -> DataFrame:
    """A long profile (table_name, column_name, stat, number, text) with the values of the columns that ``rules`` name redacted.

    The last rule that matches ``table.column`` holds.  Listed values are masked,
    hashed or dropped, numbers that are values are withheld, and each redacted
    column says by which rule, so that drift leaves it alone.
    """
    name = F.lower(F.concat_ws(".", "table_name", F.regexp_replace("column_name", r"[.\[].*$", "")))
    like = lambda pattern: "^" + re.escape(pattern.lower()).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    rule = F.coalesce(*[F.when(name.rlike(like(p)), r) for p, r in reversed(rules)], F.lit(None).cast("string"))
    marked = profile.withColumn("_rule", F.when(F.col("column_name").isNotNull(), rule)).withColumn("_head", F.regexp_extract("stat", r"^[^.\[]+", 0))
    said = F.when(F.col("_rule") == "mask", F.lit(MASK))
    if salt:
        said = said.when(F.col("_rule") == "hash", digest(F.col("text"), salt))
    elif any(r == "hash" for _, r in rules):
        raise ValueError("a hash needs a salt")
    kept = marked.where(F.col("_rule").isNull() | ~F.col("_head").isin(*WITHHELD) & ~((F.col("_rule") == "drop") & (F.col("_head") == "values")))
    plain = kept.withColumn("text", F.when(F.col("_rule").isNotNull() & (F.col("_head") == "values"), said).otherwise(F.col("text"))).select(profile.columns)
    notes = marked.where("_rule IS NOT NULL").select("table_name", "column_name", F.lit("redacted").alias("stat"), F.lit(None).cast("double").alias("number"), F.col("_rule").alias("text")).distinct()
    return plain.unionByName(notes)


def rule_for(fqn: str, rules: list[tuple[str, str]]) -> str | None:
    """The rule of the last pattern that matches a column's lower-cased full name."""
    found = [rule for pattern, rule in rules if fnmatchcase(fqn.lower(), pattern)]
    return found[-1] if found else None


def coarsened(days: Column) -> Column:
    """A day count floored to ninety days."""
    return (F.floor(days / 90) * 90).cast("long")
