"""Drift: the differences of two long profiles (table_name, column_name, stat, value) as events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["table_name", "column_name", "stat"]
#: Statistics that describe shape; a change of any other is one of data.
SHAPE = ("sql_type", "nullable", "physical_name", "collation", "default", "table_type", "external", "grain", "physical_layout", "depends_on", "comment", "relationship")
KINDS = {"sql_type": "column_type_changed", "nullable": "column_nullable_changed", "default": "column_default_changed", "collation": "column_collation_changed", "physical_name": "column_physical_name_changed", "row_count": "table_row_count_changed", "grain": "grain_changed", "physical_layout": "physical_layout_changed", "depends_on": "depends_on_changed", "table_type": "table_type_changed", "external": "external_changed", "comment": "comment_changed"}


def long_profile(wide: DataFrame, stats: list[str]) -> DataFrame:
    """A row for each statistic of each column of a wide profile; absent ones are left out."""
    each = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("string").alias("value")) for s in stats])
    return wide.select("table_name", "column_name", F.inline(each)).where("value IS NOT NULL")


def events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, column_name, kind, stat, before, after, delta, delta_pct, family) of every difference.

    Tables and columns on one side only are one event each; a statistic is
    compared where both sides have it, and NaN equals NaN.
    """

    def only(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
        gone = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
        named = gone if "column_name" in keys else gone.withColumn("column_name", F.lit(None).cast("string"))
        return named.select("table_name", "column_name", F.lit(kind).alias("kind"))

    tables, columns = ["table_name"], ["table_name", "column_name"]
    shared = before.select("table_name").distinct().join(after.select("table_name").distinct(), "table_name")
    b, a = (x.where("column_name IS NOT NULL").join(shared, "table_name", "left_semi") for x in (before, after))
    one_sided = only(after, before, tables, "table_added").unionByName(only(before, after, tables, "table_removed")).unionByName(only(a, b, columns, "column_added")).unionByName(only(b, a, columns, "column_removed"))
    for name, kind in (("stat", "string"), ("before", "string"), ("after", "string"), ("delta", "double"), ("delta_pct", "double")):
        one_sided = one_sided.withColumn(name, F.lit(None).cast(kind))
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), KEYS).where(~F.col("before").eqNullSafe(F.col("after")))
    x, y = F.col("before").try_cast("double"), F.col("after").try_cast("double")
    kind = F.coalesce(*[F.when(F.col("stat") == s, k) for s, k in KINDS.items()], F.lit("statistic_changed"))
    changed = both.select("table_name", "column_name", kind.alias("kind"), "stat", "before", "after", F.round(y - x, 6).alias("delta"), F.when(x != 0, F.round((y - x) / F.abs(x), 6)).alias("delta_pct"))
    family = F.when(F.col("kind").isin("statistic_changed", "table_row_count_changed"), "data").otherwise("shape")
    return one_sided.unionByName(changed).withColumn("family", family)


#: Statistics that count rows of the whole table, so that those of a sample or a filter don't compare.
ABSOLUTE = ("row_count", "null_count", "cardinality", "cardinality_ratio", "candidate_key", "zero_count", "negative_count", "quantized_count", "non_finite_count", "empty_count", "sum", "values", "null_patterns", "grain", "dependencies", "timeline")
#: What an estimated distinct count makes uncertain, and what redaction hides.
ESTIMATED = ("cardinality", "cardinality_ratio", "candidate_key", "classification")
HIDDEN = ("values", "range", "percentiles", "mean", "sum")
#: Statistics that tell how a profile was made; they are no drift themselves.
MARKERS = ("scope", "rows_scanned", "unmeasured", "unrepresentable", "redacted", "cardinality_method", "coverage_incoherent")
#: Families in which one side's value may be absent because it was not asked for; presence alone is no drift.
GATED = ("values", "percentiles", "null_patterns", "timeline", "inferred", "spelling_groups")


def _told(profile: DataFrame) -> DataFrame:
    """A long profile (table_name, column_name, stat, number, text) with one ``value`` and the ``head`` of each statistic's name."""
    value = F.coalesce(F.when(F.col("number").isNotNull() & F.col("text").isNotNull(), F.concat_ws(" ", F.col("number").cast("string"), "text")), F.col("text"), F.col("number").cast("string"))
    return profile.select("table_name", F.coalesce("column_name", F.lit("")).alias("column_name"), "stat", "number", value.alias("value"), F.regexp_extract("stat", r"^[^.\[]+", 0).alias("head"))


def _pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every statistic of the columns that both sides have, with ``withheld``: whether it must not be compared."""
    b, a = _told(before), _told(after)
    keys = ["table_name", "column_name", "stat", "head"]
    both = b.select(*keys, F.col("value").alias("before"), F.col("number").alias("x")).join(a.select(*keys, F.col("value").alias("after"), F.col("number").alias("y")), keys, "full_outer")
    shared = b.select("table_name", "column_name").distinct().join(a.select("table_name", "column_name").distinct(), ["table_name", "column_name"])
    marks = b.unionByName(a).where(F.col("stat").isin(*MARKERS))
    scoped = marks.where("stat = 'scope'").select("table_name", F.lit(True).alias("scoped")).distinct()
    of_column = marks.groupBy("table_name", "column_name").agg(
        F.flatten(F.collect_set(F.when(F.col("stat") == "unmeasured", F.split("value", ",")))).alias("unmeasured"),
        F.max(F.col("stat") == "redacted").alias("hidden"),
        F.max((F.col("stat") == "cardinality_method") & (F.col("value") == "approximate")).alias("rough"),
    )
    whole = both.join(shared, ["table_name", "column_name"]).join(scoped, "table_name", "left").join(of_column, ["table_name", "column_name"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    one_side = F.col("before").isNull() | F.col("after").isNull()
    withheld = (
        yes(F.col("scoped")) & F.col("head").isin(*ABSOLUTE)
        | yes(F.array_contains("unmeasured", F.col("head")))
        | yes(F.col("hidden")) & F.col("head").isin(*HIDDEN)
        | yes(F.col("rough")) & F.col("head").isin(*ESTIMATED)
        | one_side & F.col("head").isin(*GATED)
    )
    return whole.where(~F.col("head").isin(*MARKERS)).select(*keys, "before", "after", "x", "y", withheld.alias("withheld"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, column_name, kind, stat, before, after, delta, delta_pct, family): the drift between two whole profiles.

    Tables and columns of one side are one event each; parts of nested columns,
    whose names are paths, are compared where both sides have them.  Not
    compared is what either side did not measure, estimated, redacted, or read
    in a sample or a filter; ``outcome`` counts it.
    """
    b, a = _told(before), _told(after)

    def only(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
        return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").select("table_name", (F.col("column_name") if len(keys) > 1 else F.lit(None).cast("string")).alias("column_name"), F.lit(kind).alias("kind"))

    tables, columns = ["table_name"], ["table_name", "column_name"]
    shared = b.select("table_name").distinct().join(a.select("table_name").distinct(), "table_name")
    of_columns = [x.where(~F.col("column_name").rlike(r"[.\[]") & (F.col("column_name") != "")).join(shared, "table_name", "left_semi") for x in (b, a)]
    one_sided = only(a, b, tables, "table_added").unionByName(only(b, a, tables, "table_removed")).unionByName(only(of_columns[1], of_columns[0], columns, "column_added")).unionByName(only(*of_columns, columns, "column_removed"))
    for name, kind in (("stat", "string"), ("before", "string"), ("after", "string"), ("delta", "double"), ("delta_pct", "double")):
        one_sided = one_sided.withColumn(name, F.lit(None).cast(kind))
    moved = _pairs(before, after).where("NOT withheld").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.coalesce(*[F.when(F.col("stat") == s, k) for s, k in KINDS.items()], F.when(F.col("head") == "grain", "grain_changed"), F.when(F.col("head") == "foreign_key", F.when(F.col("before").isNull(), "relationship_added").when(F.col("after").isNull(), "relationship_removed").otherwise("relationship_modified")), F.lit("statistic_changed"))
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    x, y = number(F.col("x")), number(F.col("y"))
    changed = moved.select("table_name", F.nullif("column_name", F.lit("")).alias("column_name"), kind.alias("kind"), "stat", "before", "after", F.round(y - x, 6).alias("delta"), F.when(x != 0, F.round((y - x) / F.abs(x), 6)).alias("delta_pct"))
    return one_sided.unionByName(changed).withColumn("family", F.when(F.col("kind").isin("statistic_changed", "table_row_count_changed"), "data").otherwise("shape"))


def outcome(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, changed, unchanged, unevaluated): how many statistics of the columns on both sides moved, stayed, or were not compared."""
    differ = ~F.col("before").eqNullSafe(F.col("after"))
    return _pairs(before, after).groupBy("table_name").agg(F.count_if(~F.col("withheld") & differ).alias("changed"), F.count_if(~F.col("withheld") & ~differ).alias("unchanged"), F.count_if("withheld").alias("unevaluated"))


def summary(found: DataFrame) -> DataFrame:
    """(kind, family, n)."""
    return found.groupBy("kind", "family").agg(F.count(F.lit(1)).alias("n"))


def relationships(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, source_column, target, target_column, kind): edges added, removed, or found another way."""
    keys = ["source", "source_column", "target", "target_column"]
    both = before.withColumnRenamed("detection", "was").join(after.withColumnRenamed("detection", "now"), keys, "full_outer")
    kind = F.when(F.col("was").isNull(), "relationship_added").when(F.col("now").isNull(), "relationship_removed").when(F.col("was") != F.col("now"), "relationship_modified")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "kind")
