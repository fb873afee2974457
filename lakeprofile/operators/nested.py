"""Parts of nested columns: array elements, struct members, map entries, JSON documents, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PARTS, MAX_DEPTH = 20, 3


def plan_parts(schema: T.StructType, max_depth: int = MAX_DEPTH) -> list[str]:
    """Paths of all parts that the schema declares, parents before children."""
    found: list[str] = []

    def walk(path: str, kind: T.DataType, depth: int) -> None:
        if depth >= max_depth:
            return
        if isinstance(kind, T.ArrayType):
            children = [(f"{path}[*]", kind.elementType)]
        elif isinstance(kind, T.StructType):
            children = [(f"{path}.{f.name}", f.dataType) for f in kind.fields]
        elif isinstance(kind, T.MapType):
            children = [(f"{path}[keys]", kind.keyType)]
        else:
            return
        for p, k in children:
            found.append(p)
            walk(p, k, depth + 1)

    for f in schema.fields:
        walk(f.name, f.dataType, 0)
    return found


def keep_parts(parts: list[tuple[str, int]], most: int = MAX_PARTS) -> list[str]:
    """The paths of most occurrences, then by path."""
    return [p for p, _ in sorted(parts, key=lambda x: (-x[1], x[0]))[:most]]


def array_elements(df: DataFrame, column: str) -> DataFrame:
    """One row for each element, null elements included."""
    return df.select(F.explode(F.col(f"`{column}`")).alias("element"))


def array_shape(df: DataFrame, column: str) -> DataFrame:
    """(column_name, rows, size_min, size_max, size_avg, size_p95, empties): p95 is by nearest rank."""
    c = F.col(f"`{column}`")
    size = F.when(c.isNotNull(), F.size(c))
    sizes = df.select(size.alias("s"))
    return sizes.agg(F.lit(column).alias("column_name"), F.count("s").alias("rows"), F.min("s").cast("long").alias("size_min"), F.max("s").cast("long").alias("size_max"), F.round(F.avg("s"), 6).alias("size_avg"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY s)").cast("long").alias("size_p95"), F.count_if(F.col("s") == 0).alias("empties"))


def vector_norms(df: DataFrame, column: str) -> DataFrame:
    """(column_name, dimension, norm_min, norm_max, zero_count): dimension is null unless one length is all there is."""
    c = F.col(f"`{column}`")
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    measured = df.where(c.isNotNull()).select(F.size(c).alias("d"), norm.alias("norm"))
    positive = F.when(F.col("norm") > 0, F.col("norm"))
    return measured.agg(F.lit(column).alias("column_name"), F.when(F.min("d") == F.max("d"), F.min("d")).cast("long").alias("dimension"), F.round(F.min(positive), 4).alias("norm_min"), F.round(F.max(positive), 4).alias("norm_max"), F.count_if(F.col("norm") == 0).alias("zero_count"))


def struct_members(df: DataFrame, column: str) -> DataFrame:
    """(path, occurrences, nulls) of each member, rows without the struct left out; a name given twice counts once."""
    kind = df.schema[column].dataType
    names = list(dict.fromkeys(f.name for f in kind.fields))
    here = df.where(F.col(f"`{column}`").isNotNull())
    each = [F.struct(F.lit(f"{column}.{n}").alias("path"), F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col(f"`{column}`.`{n}`").isNull()).alias("nulls")) for n in names]
    return here.agg(F.array(*each).alias("each")).select(F.inline("each"))


def map_keys(df: DataFrame, column: str, top_n: int = MAX_PARTS) -> DataFrame:
    """(key, n, distinct_keys): the most frequent keys and how many there are in all."""
    counted = df.select(F.explode(F.map_keys(F.col(f"`{column}`"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.count(F.lit(1)).alias("distinct_keys"))
    return counted.orderBy(F.desc("n"), "key").limit(top_n).crossJoin(F.broadcast(total))


def map_values(df: DataFrame, column: str, key: str) -> DataFrame:
    """The values under one key."""
    return df.where(F.map_contains_key(F.col(f"`{column}`"), F.lit(key))).select(F.col(f"`{column}`")[key].alias("value"))


def document_entries(df: DataFrame, column: str) -> DataFrame:
    """(key, type, value): the top-level entries of each JSON document, with the engine's type names."""
    docs = df.select(F.try_parse_json(F.col(f"`{column}`")).alias("d")).where("d IS NOT NULL")
    entries = docs.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("d").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z_]+", 0)
    return entries.select("key", kind.alias("type"), F.to_json("value").alias("value"))


def document_types(df: DataFrame, column: str) -> DataFrame:
    """(type, n) of the documents themselves; unparsable ones are ``INVALID``, nulls are left out."""
    c = F.col(f"`{column}`")
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_parse_json(c)), "^[A-Z_]+", 0), F.lit("INVALID"))
    return df.where(c.isNotNull()).groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
