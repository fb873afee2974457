"""Key sketches: the k least hashes of a column's distinct values, and what two of them tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions import expressions as X

K = 1024


def canonical(c: Column, kind: T.DataType) -> Column:
    """The text under which equal keys of any table are equal; floating-point columns have none."""
    if isinstance(kind, X.FLOATING):
        raise TypeError("a floating-point column is no key")
    if isinstance(kind, T.BooleanType):
        return F.when(c, "true").otherwise("false")
    return X.published(c, kind)


def key_sketch(df: DataFrame, column: str, k: int = K) -> DataFrame:
    """(h): the ``k`` least hashes of the distinct values; the column's all if it has fewer."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    h = F.unhex(F.substring(F.md5(c), 17, 16)) if isinstance(kind, T.BinaryType) else None
    value = X.low64(canonical(c, kind)) if h is None else F.conv(F.hex(h), 16, 10).cast("decimal(20,0)")
    return df.where(c.isNotNull()).select(value.alias("h")).distinct().orderBy("h").limit(k)


def summary(sketch: DataFrame, k: int = K) -> DataFrame:
    """(n, threshold, exhaustive) of a sketch; the threshold of an exhaustive one is two to the 64."""
    full = F.count(F.lit(1)) >= k
    return sketch.agg(F.count(F.lit(1)).alias("n"), F.when(full, F.max("h")).otherwise(F.lit(str(2**64)).cast("decimal(20,0)")).alias("threshold"), (~full).alias("exhaustive"))


def member(sketch: DataFrame, value: Column, kind: T.DataType, k: int = K) -> DataFrame:
    """(known, present): whether the column holds ``value``; only a sketch of all its values, or a hash below the largest kept, can tell."""
    h = X.low64(canonical(value, kind))
    facts = sketch.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("top"), F.max(F.col("h") == h).alias("hit"))
    return facts.select(F.coalesce((F.col("n") < k) | (h <= F.col("top")), F.lit(True)).alias("known"), F.coalesce("hit", F.lit(False)).alias("hit")).select("known", F.when(F.col("known"), F.col("hit")).alias("present"))


def compare(child: DataFrame, parent: DataFrame, k: int = K) -> DataFrame:
    """(common, answerable, estimate, containment): of the child's keys below both thresholds, those the parent has."""
    c, p = summary(child, k), summary(parent, k)
    limits = c.select(F.col("threshold").alias("tc")).crossJoin(p.select(F.col("threshold").alias("tp")))  # a row each
    theta = F.broadcast(limits.select(F.least("tc", "tp").alias("theta"), "tp"))
    marked = child.join(parent.select("h", F.lit(True).alias("there")), "h", "left").crossJoin(theta)
    common = F.count_if((F.col("h") < F.col("theta")) & F.col("there").isNotNull())
    answerable, contained = F.count_if(F.col("h") < F.col("tp")), F.count_if((F.col("h") < F.col("tp")) & F.col("there").isNotNull())
    return marked.agg(common.alias("common"), answerable.alias("answerable"), F.round(common * F.lit(2.0**64) / F.max("theta").cast("double"), 2).alias("estimate"), F.round(contained / answerable, 6).alias("containment"))
