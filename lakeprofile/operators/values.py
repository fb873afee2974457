"""Value lists and what follows from them: coverage, distribution, frequencies, spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.functions import expressions as X

#: The rows of ``value_list``.
LISTED = "column_name string, value string, n long, rank long, exhaustive boolean"


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): how often each non-null value of each column occurs; one narrow aggregate a column."""
    each = []
    for name in columns:
        kind = df.schema[name].dataType
        counted = df.select(F.col(f"`{name}`").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        each.append(counted.select(F.lit(name).alias("column_name"), X.published(F.col("v"), kind).alias("value"), "n"))
    return reduce(DataFrame.unionByName, each)


def most_frequent(df: DataFrame, columns: list[str], most: int, text: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """The ``most`` first rows of each column's frequencies, by count, then by the text; and how many spelling groups each of ``text`` has, where there are any.

    One job counts each column once for both.
    """
    freq = {c: frequencies(df, [c]) for c in columns}
    best = [f.orderBy(F.desc("n"), "value").limit(most) for f in freq.values()]
    spelt = [spelling_groups(freq[c]).groupBy("column_name").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")) for c in text]  # with n, both read one shuffle
    shown = [f.select("column_name", "value", "n", F.lit(None).cast("long").alias("groups")) for f in best]
    rows = reduce(DataFrame.unionByName, shown + [f.select("column_name", F.lit(None).cast("string").alias("value"), "n", "groups") for f in spelt]).collect()
    top = df.sparkSession.createDataFrame([tuple(r)[:3] for r in rows if r["groups"] is None], "column_name string, value string, n long")
    return top, {r["column_name"]: r["groups"] for r in rows if r["groups"] is not None}


def value_list(freq: DataFrame, top_n: int = 20, threshold: int = 50) -> DataFrame:
    """(column_name, value, n, rank, exhaustive): every value of a column of few, else the ``top_n`` most frequent.

    Ranked by count, then by the text.
    """
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    most = max(threshold, top_n)
    ranked = freq.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most + 1)
    whole = ranked.withColumn("exhaustive", F.count(F.lit(1)).over(Window.partitionBy("column_name")) <= most)
    return whole.where("exhaustive OR rank <= " + str(top_n))


def distribution(freq: DataFrame, top_n: int = 20, threshold: int = 50) -> DataFrame:
    """(column_name, top_count, bottom_count, listed, listed_count, non_null, values_coverage, distribution), one row per column."""
    totals = freq.groupBy("column_name").agg(F.sum("n").alias("non_null"))
    return distribution_of(value_list(freq, top_n, threshold), totals)


def distribution_of(listed: DataFrame, totals: DataFrame) -> DataFrame:
    """``distribution`` from a value list, and (column_name, non_null)."""
    listed = listed.groupBy("column_name").agg(F.max("n").alias("top_count"), F.min("n").alias("bottom_count"), F.count(F.lit(1)).alias("listed"), F.sum("n").alias("listed_count"), F.first("exhaustive").alias("exhaustive"))
    both = listed.join(totals, "column_name")
    share = F.col("listed_count") / F.col("non_null")
    shape = F.when(F.col("top_count") / F.col("non_null") >= 0.95, "dominant_value").when(~F.col("exhaustive") & (share < 0.30), "long_tail").when(F.col("top_count") > 2 * F.col("bottom_count"), "imbalanced").otherwise("uniform")
    return both.select("column_name", "top_count", "bottom_count", "listed", "listed_count", "non_null", F.when(F.col("exhaustive"), 1.0).otherwise(F.least(F.round(share, 6), F.lit(X.RATE_CEILING))).alias("values_coverage"), shape.alias("distribution"))


def spelling_groups(freq: DataFrame) -> DataFrame:
    """(column_name, folded, canonical, spellings, n): values that differ in case or surrounding spaces only."""
    key = X.folded(F.col("value"))
    groups = freq.groupBy("column_name", key.alias("folded")).agg(F.min(F.struct((-F.col("n")).alias("o"), "value")).alias("best"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    return groups.where("spellings > 1").select("column_name", "folded", F.col("best.value").alias("canonical"), "spellings", "n")


def normalized_cardinality(df: DataFrame, column: str) -> DataFrame:
    """(column_name, cardinality, normalized_cardinality) of a text column."""
    once = df.select(F.col(f"`{column}`").alias("v")).where("v IS NOT NULL").distinct()
    return once.agg(F.lit(column).alias("column_name"), F.count(F.lit(1)).alias("cardinality"), F.count_distinct(X.folded(F.col("v"))).alias("normalized_cardinality"))


def distinct_sample(df: DataFrame, column: str, n: int = 1000, seed: str = "") -> DataFrame:
    """Up to ``n`` distinct values in the order of their seeded hash: the same sample from the same values, however they lie."""
    text = X.published(F.col(f"`{column}`"), df.schema[column].dataType)
    once = df.select(text.alias("value")).where("value IS NOT NULL").distinct()
    return once.orderBy(F.md5(F.concat(F.lit(seed), F.col("value"))), "value").limit(n)
