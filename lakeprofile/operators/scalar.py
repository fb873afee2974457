"""Scalar measurements of all columns in one fused pass, and distinct counts by frequency.

``base`` makes one aggregate over the table for everything that needs no
distinct values.  Distinct counts come from one narrow aggregate for each
column, which reads that column alone and sums before it shuffles, where many
distinct counts in one aggregate would multiply the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions import expressions as X

#: Columns in one aggregate, so that generated code stays small enough to be compiled.
WIDE = 4


def _long(v: Column) -> Column:
    return v.cast("long")


def _base_of(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    group, none = X.family(kind), F.lit(None)
    fv = X.finite(c, kind)
    text = group in ("text", "binary")
    size = F.length(c) if group == "text" else F.octet_length(c) if group == "binary" else none.cast("int")
    number = group == "numeric"
    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(kind.simpleString()).alias("sql_type"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(c.isNull()).alias("null_count"),
        (F.count_if(c == 0) if number else _long(none)).alias("zero_count"),
        (F.count_if(fv < 0) if number else _long(none)).alias("negative_count"),
        (F.count_if(fv == F.floor(fv)) if number else F.count_if(X.whole_day(c, kind)) if isinstance(kind, X.CLOCKED) else _long(none)).alias("quantized_count"),
        (F.count(c) - F.count(fv) if isinstance(kind, X.FLOATING) else _long(none)).alias("non_finite_count"),
        (F.count_if(size == 0) if text else _long(none)).alias("empty_count"),
        (_long(F.min(size)) if text else _long(none)).alias("length_min"),
        (_long(F.max(size)) if text else _long(none)).alias("length_max"),
        (F.round(F.avg(size), 6) if text else none.cast("double")).alias("length_avg"),
        _long(none).cast("double").alias("length_p95"),
    )


def _lengths(df: DataFrame, field: T.StructField) -> DataFrame:
    """(column_name, p95): the 95th percentile of a column's lengths, from how often each occurs."""
    c = F.col(f"`{field.name}`")
    size = F.length(c) if X.family(field.dataType) == "text" else F.octet_length(c)
    counted = df.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.round(F.percentile("size", 0.95, F.col("n")), 6).alias("p95")).select(F.lit(field.name).alias("column_name"), "p95")


def base(df: DataFrame) -> DataFrame:
    """One row per column: counts and lengths, null where a measure does not apply."""
    fields = df.schema.fields
    parts = [df.agg(F.array(*[_base_of(f) for f in fields[at : at + WIDE]]).alias("each")).select(F.inline("each")) for at in range(0, len(fields), WIDE)]
    found = reduce(DataFrame.unionByName, parts)
    if each := [_lengths(df, f) for f in fields if X.family(f.dataType) in ("text", "binary")]:  # kept apart: the aggregate of all columns would not be compiled
        lengths = F.broadcast(reduce(DataFrame.unionByName, each))
        found = found.join(lengths, "column_name", "left").withColumn("length_p95", F.col("p95")).drop("p95")
    return found


def cardinalities(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, cardinality) by exact distinct counts; nested columns are left out."""
    fields = [f for f in df.schema.fields if X.family(f.dataType) not in ("nested", "json", "unsupported") and (columns is None or f.name in columns)]
    each = [df.select(F.col(f"`{f.name}`").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("cardinality")).select(F.lit(f.name).alias("column_name"), "cardinality") for f in fields]
    return reduce(DataFrame.unionByName, each) if each else df.sparkSession.createDataFrame([], "column_name string, cardinality long")


def approximate_cardinalities(df: DataFrame, error: float = 0.02, settle: float = 0.85) -> DataFrame:
    """(column_name, cardinality, method): estimates, but exact counts for columns that look nearly unique."""
    fields = [f for f in df.schema.fields if X.family(f.dataType) not in ("nested", "json", "unsupported")]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, cardinality long, method string")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"`{f.name}`", error).alias(f"c{i}") for i, f in enumerate(fields)]).first()
    near = [f.name for i, f in enumerate(fields) if row["n"] and row[f"c{i}"] / row["n"] >= settle]
    rough = df.sparkSession.createDataFrame([(f.name, row[f"c{i}"], "approximate") for i, f in enumerate(fields) if f.name not in near], "column_name string, cardinality long, method string")
    return rough.unionByName(cardinalities(df, near).withColumn("method", F.lit("exact")))


def phase_a(df: DataFrame, name: str, threshold: int = 50, foreign_keys: frozenset[str] = frozenset(), parts: bool = False) -> DataFrame:
    """The base measurements of a table with rates, cardinality, candidate key and class."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = base(df).join(F.broadcast(cardinalities(df)), "column_name", "left")  # a row per column
    cls = F.coalesce(*[F.when(F.col("column_name") == n, X.classification(k, F.col("cardinality"), threshold, n in foreign_keys, parts)) for n, k in kinds.items()])
    share = X.ratio(F.col("cardinality"), F.col("row_count"))
    return found.select(
        F.lit(name).alias("table_name"),
        "column_name",
        "row_count",
        "null_count",
        X.rate(F.col("null_count"), F.col("row_count")).alias("null_rate"),
        "cardinality",
        F.when(F.col("cardinality").isNotNull(), share).alias("cardinality_ratio"),
        "zero_count",
        "negative_count",
        "quantized_count",
        "non_finite_count",
        "empty_count",
        "length_min",
        "length_max",
        "length_avg",
        "length_p95",
        F.coalesce((F.col("cardinality") > 0) & (share >= X.CANDIDATE_KEY_RATIO), F.lit(False)).alias("candidate_key"),
        cls.alias("classification"),
    )


def numeric_block(df: DataFrame) -> DataFrame:
    """(column_name, min_value, max_value, mean_value, sum_value, sum_exact, unmeasured) of the numeric columns' finite values.

    Totals of floating columns are doubles; those of exact columns are decimals,
    ``sum_exact`` as text.  A total that overflows is null and named in
    ``unmeasured``.
    """
    each = []
    for f in df.schema.fields:
        if X.family(f.dataType) != "numeric":
            continue
        v = X.finite(F.col(f"`{f.name}`"), f.dataType)
        if isinstance(f.dataType, X.FLOATING):
            v = v.cast("double")
            total, mean, exact = F.sum(v), F.avg(v), F.lit(None).cast("string")
        else:
            scale = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else 0
            exact_sum = F.try_sum(v.cast(f"decimal(38,{scale})"))
            total, exact = exact_sum.cast("double"), exact_sum.cast("string")
            mean = total / F.nullif(F.count(v), F.lit(0))
        total, mean = X.finite(total, T.DoubleType()), X.finite(mean, T.DoubleType())
        lost = lambda x, name: F.when((F.count(v) > 0) & x.isNull(), name)  # noqa: E731, B023
        unmeasured = F.array_join(F.array(lost(mean, "mean"), lost(total, "sum")), ",")
        bound = lambda x: X.rounded(x.cast("double"))
        each.append(F.struct(F.lit(f.name).alias("column_name"), bound(F.min(v)).alias("min_value"), bound(F.max(v)).alias("max_value"), X.rounded(mean).alias("mean_value"), X.rounded(total).alias("sum_value"), exact.alias("sum_exact"), unmeasured.alias("unmeasured")))
    return df.agg(F.array(*each).alias("each")).select(F.inline("each")) if each else df.sparkSession.createDataFrame([], "column_name string, min_value double, max_value double, mean_value double, sum_value double, sum_exact string, unmeasured string")


def temporal_block(df: DataFrame, profiled_at: str) -> DataFrame:
    """(column_name, min_value, max_value, span_days, quantized_count, max_age_days, freshness, unrepresentable) of date and time columns.

    ``quantized_count``, of columns with a time of day, counts whole UTC days;
    ``unrepresentable`` names the bounds whose year has not four digits.
    """
    each = []
    for f in df.schema.fields:
        if X.family(f.dataType) == "temporal":
            c, kind = F.col(f"`{f.name}`"), f.dataType
            low, high = F.min(c), F.max(c)
            now = X.micros(F.lit(profiled_at).cast("timestamp_ntz"), T.TimestampNTZType())
            age = F.greatest(F.lit(0), F.floor((now - X.micros(high, kind)) / X.DAY)).cast("long")
            quantized = F.count_if(X.whole_day(c, kind)) if isinstance(kind, X.CLOCKED) else F.lit(None).cast("long")
            strange = F.array_join(F.array(*[F.when(~X.representable(x, kind), n) for n, x in (("min", low), ("max", high))]), ",")
            each.append(F.struct(F.lit(f.name).alias("column_name"), X.published(low, kind).alias("min_value"), X.published(high, kind).alias("max_value"), F.floor((X.micros(high, kind) - X.micros(low, kind)) / X.DAY).cast("long").alias("span_days"), quantized.alias("quantized_count"), age.alias("max_age_days"), F.when(age < 7, "live").when(age < 90, "stale").otherwise("dormant").alias("freshness"), strange.alias("unrepresentable")))
    return df.agg(F.array(*each).alias("each")).select(F.inline("each")) if each else df.sparkSession.createDataFrame([], "column_name string, min_value string, max_value string, span_days long, quantized_count long, max_age_days long, freshness string, unrepresentable string")
