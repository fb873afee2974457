"""Relationships between tables: by name, by value, and what following them costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX = "_id"


@dataclass(frozen=True)
class Table:
    """What is declared of a table: column types, and its keys of one column, the primary one first."""

    name: str
    columns: dict[str, str]
    keys: tuple[str, ...] = ()
    namespace: str = ""


def _plurals(stem: str) -> list[str]:
    more = [stem + "s", stem + "es"]
    return [stem, *more, stem[:-1] + "ies"] if stem.endswith("y") else [stem, *more]


def _kind(t: str) -> str:
    return "integer" if t in ("tinyint", "smallint", "int", "bigint") else t.partition("(")[0]


def by_name(tables: list[Table]) -> list[tuple[str, str, str, str]]:
    """(table, column, target, key) where ``x_id`` names one table x with one declared key of a compatible type."""
    found = []
    for t in tables:
        for column, kind in t.columns.items():
            if not column.lower().endswith(SUFFIX) or len(column) == len(SUFFIX):
                continue
            names = _plurals(column.lower()[: -len(SUFFIX)])
            near = [x for x in tables if x.name.lower() in names and x.namespace == t.namespace] or [x for x in tables if x.name.lower() in names]
            if len(near) != 1 or not near[0].keys:
                continue
            target, key = near[0], near[0].keys[0]
            if (target.name, key) != (t.name, column) and _kind(kind) == _kind(target.columns.get(key, "")):
                found.append((t.name, column, target.name, key))
    return found


def by_value(children: list[dict], parents: list[dict], threshold: int = 50, least: float = 0.95, answerable: int = 400) -> list[tuple[str, str]]:
    """(child, parent) where sketches show the child's keys inside a larger parent key of the same kind.

    Each side has name, kind, cardinality, hashes (sorted), exhaustive, dense; a
    dense parent is referred to by columns named ``_id`` only.
    """
    found = []
    for c in children:
        if c["cardinality"] <= threshold or c["kind"] in ("temporal", "boolean"):
            continue
        for p in parents:
            if p["name"] == c["name"] or p["kind"] != c["kind"] or p["cardinality"] <= c["cardinality"] or p["dense"] and not c["name"].lower().endswith(SUFFIX):
                continue
            limit = 2**64 if p["exhaustive"] else p["hashes"][-1]
            inside, there = [h for h in c["hashes"] if h < limit], set(p["hashes"])
            hits = sum(h in there for h in inside)
            if hits == len(inside) > 0 if c["exhaustive"] and p["exhaustive"] else len(inside) >= answerable and hits / len(inside) >= least:
                found.append((c["name"], p["name"]))
    return found


def observed(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """(rows, nulls, distinct_fk, fanout_avg, fanout_max, contained, containment, target_coverage) of one edge, exactly.

    The child is summed to its distinct keys before it meets the parent.
    """
    each = child.groupBy(F.col(f"`{fk}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(f"`{key}`").alias("k")).where("k IS NOT NULL").distinct()
    met = each.join(keys.withColumn("there", F.lit(True)), "k", "left")
    known = F.col("k").isNotNull()
    total = met.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"), F.count_if(known).alias("distinct_fk"), F.max(F.when(known, F.col("n"))).alias("fanout_max"), F.count_if(known & F.col("there")).alias("contained"))
    size = keys.agg(F.count(F.lit(1)).alias("keys"))
    card = F.col("distinct_fk")
    return total.crossJoin(F.broadcast(size)).select("rows", "nulls", "distinct_fk", F.round(F.greatest(F.col("rows") - F.col("nulls"), card) / card, 6).alias("fanout_avg"), "fanout_max", "contained", F.round(F.col("contained") / card, 6).alias("containment"), F.round(F.col("contained") / F.col("keys"), 6).alias("target_coverage"))


def referenced_by(edges: DataFrame) -> DataFrame:
    """The mirror of (source, source_column, target, target_column): one row a target, its sources in order."""
    return edges.groupBy("target", "target_column").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "source", "source_column"))), ",").alias("sources"), F.count(F.lit(1)).alias("n_sources"))


def with_human(edges: DataFrame, added: DataFrame, rejected: DataFrame) -> DataFrame:
    """Edges with what people added and without what they rejected."""
    keys = ["source", "source_column", "target", "target_column"]
    return edges.unionByName(added).distinct().join(rejected.select(*keys), keys, "left_anti")


def dense_sequences(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, min, max, cardinality, dense): integers without a gap."""
    each = [F.struct(F.lit(c).alias("column_name"), F.min(f"`{c}`").cast("long").alias("min_value"), F.max(f"`{c}`").cast("long").alias("max_value")) for c in columns]
    from lakeprofile.operators.scalar import cardinalities

    ends = df.agg(F.array(*each).alias("each")).select(F.inline("each"))
    return ends.join(cardinalities(df, columns), "column_name").withColumn("dense", F.col("max_value") - F.col("min_value") + 1 == F.col("cardinality"))
