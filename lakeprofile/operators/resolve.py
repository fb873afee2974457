"""Finding values and columns in a stored profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.expressions import folded

FLOOR, NEAREST = 0.3, 5


def trigrams(text: Column) -> Column:
    """The distinct three-character pieces of a folded text between two spaces on either side."""
    padded = F.concat(F.lit("  "), folded(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def resolve_value(values: DataFrame, asked: str, floor: float = FLOOR, most: int = NEAREST) -> DataFrame:
    """(value, n, match, score): the stored spelling if there is one, else the nearest by trigrams."""
    scored = values.select("value", "n", F.when(F.col("value") == asked, "stored").when(folded(F.col("value")) == folded(F.lit(asked)), "folded").otherwise("nearest").alias("match"), F.round(similarity(trigrams(F.col("value")), trigrams(F.lit(asked))), 6).alias("score"))
    best = scored.agg(F.min(F.when(F.col("match") == "stored", 0).when(F.col("match") == "folded", 1).otherwise(2)).alias("best"))
    rank = F.when(F.col("match") == "stored", 0).when(F.col("match") == "folded", 1).otherwise(2)
    kept = scored.crossJoin(F.broadcast(best)).where((rank == F.col("best")) & ((F.col("best") < 2) | (F.col("score") >= floor)))
    return kept.orderBy(F.desc("score"), "value").limit(most).select("value", "n", "match", "score")


def search_columns(profile: DataFrame, pattern: str | None = None, **equal: object) -> DataFrame:
    """The columns of a profile whose name matches ``pattern`` and whose fields equal what is asked."""
    found = profile if pattern is None else profile.where(F.lower("column_name").rlike(pattern))
    for field, wanted in equal.items():
        found = found.where(F.col(field) == F.lit(wanted))
    return found
