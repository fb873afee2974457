"""Facts of a whole table: null patterns, grain, dependencies, timeline, populated windows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.functions import expressions as X

GRAIN_PAIRS, DEPENDENCY_PAIRS, STRONG = 32, 300, 0.95
#: About so many rows of a table are tried before it is counted whole.
PART = 1_000_000


def null_patterns(df: DataFrame, top_n: int = 20, whole: frozenset[str] = frozenset()) -> DataFrame:
    """(pattern, n, coverage): the most frequent combinations of null columns, one character a column; ``whole`` are known to hold no null and are not read."""
    flags = F.concat(*[F.lit("0") if c in whole else F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    counted = df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "pattern").limit(top_n)
    rows = counted.agg(F.sum("n").alias("rows"))
    return top.crossJoin(F.broadcast(rows)).select("pattern", "n", F.round(F.sum("n").over(Window.partitionBy()) / F.col("rows"), 6).alias("coverage"))


def pair_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, distinct_pairs): one two-column aggregate for each pair."""
    each = [df.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).groupBy("x", "y").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("distinct_pairs")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "distinct_pairs") for a, b in pairs]
    return reduce(DataFrame.unionByName, each) if each else df.sparkSession.createDataFrame([], "a string, b string, distinct_pairs long")


def grain_candidates(cards: dict[str, int], nulls: dict[str, int], rows: int, most: int = GRAIN_PAIRS) -> list[tuple[str, str]]:
    """Pairs of null-free columns that could tell all rows apart, by descending product of cardinalities."""
    clean = [c for c in cards if not nulls.get(c) and cards[c] < rows]
    fit = [(a, b) for a, b in combinations(clean, 2) if cards[a] * cards[b] >= rows]
    return sorted(fit, key=lambda p: (-cards[p[0]] * cards[p[1]], p))[:most]


def unrefuted(df: DataFrame, pairs: list[tuple[str, str]], cards: dict[str, int], rows: int) -> list[tuple[str, str]]:
    """The pairs that a part of the table does not show to be no key; what is left is to be counted whole.

    A part holds every row of some values of a pair's column of more values.  Rows
    that agree in a pair there agree in the table, so a pair that is a key is never
    lost, and most that are none cost no count of the table.
    """
    parts, hub = rows // PART, lambda p: max(p, key=lambda c: (cards[c], c))
    if parts < 2:
        return pairs
    again = set()
    for h in sorted({hub(p) for p in pairs}):
        mine = [p for p in pairs if hub(p) == h]
        names = sorted({c for p in mine for c in p})
        some = df.where(F.pmod(F.xxhash64(F.col(f"`{h}`")), F.lit(parts)) == 0).select(*[F.col(f"`{c}`") for c in names]).persist()
        again |= {(r["a"], r["b"]) for r in grain(some, mine).where("NOT is_key").collect()}
        some.unpersist()
    return [p for p in pairs if p not in again]


def grain(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, distinct_pairs, rows, is_key): whether a pair identifies every row."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return pair_counts(df, pairs).crossJoin(F.broadcast(rows)).withColumn("is_key", F.col("distinct_pairs") == F.col("rows"))


def adjacent(a: str, b: str) -> bool:
    """Whether the words of one name begin the other."""
    x, y = sorted((a.split("_"), b.split("_")), key=len)
    return len(x) < len(y) and y[: len(x)] == x


def dependency_candidates(facts: dict[str, tuple[str, int, int, bool]], most: int = DEPENDENCY_PAIRS) -> list[tuple[str, str]]:
    """(determinant, dependent) pairs worth counting, from (class, cardinality, null count, candidate key) of each column.

    Columns without nulls, both of few values or of adjacent names; the
    determinant has as many values at least and is no key, the dependent more
    than one.  Adjacent names come first, then the cheapest pairs.
    """
    few = ("categorical", "boolean")
    clean = [c for c, (_, card, nulls, _) in facts.items() if not nulls and card is not None]
    fit = lambda a, b: facts[a][1] >= facts[b][1] > 1 and not facts[a][3] and (adjacent(a, b) or facts[a][0] in few and facts[b][0] in few)
    pairs = [p for a, b in combinations(clean, 2) for p in ((a, b), (b, a)) if fit(*p)]
    return sorted(pairs, key=lambda p: (not adjacent(*p), facts[p[0]][1] * facts[p[1]][1]))[:most]


def dependencies(df: DataFrame, pairs: list[tuple[str, str]], cards: DataFrame) -> DataFrame:
    """(determinant, dependent, strength): how nearly the first column decides the second, 1.0 exactly."""
    counted = pair_counts(df, pairs[:DEPENDENCY_PAIRS])
    det = cards.select(F.col("column_name").alias("a"), F.col("cardinality").alias("of_a"))
    return counted.join(F.broadcast(det), "a").select(F.col("a").alias("determinant"), F.col("b").alias("dependent"), F.round(F.least(F.lit(1.0), F.col("of_a") / F.col("distinct_pairs")), 6).alias("strength"))


def timeline_unit(span_days: int) -> str:
    return "day" if span_days <= 90 else "week" if span_days <= 730 else "month"


def timeline_anchor(facts: list[tuple[str, float, int]]) -> str | None:
    """The column that dates rows best: (name, null rate, cardinality) with fewest nulls, then most values, then by name."""
    return min(facts, key=lambda f: (f[1], -f[2], f[0]))[0] if facts else None


def timeline(df: DataFrame, column: str, unit: str) -> DataFrame:
    """(bucket, n): rows by day, week from Monday, or month; empty buckets are absent."""
    day = X.local(F.col(f"`{column}`"), df.schema[column].dataType).cast("date")
    days = df.where(F.col(f"`{column}`").isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))  # a date is cheaper than its text
    bucket = F.col("day") if unit == "day" else F.trunc("day", unit)
    return days.groupBy(bucket.cast("string").alias("bucket")).agg(F.sum("n").alias("n"))


def populated_windows(df: DataFrame, anchor: str, columns: list[str]) -> DataFrame:
    """(column_name, populated_from, populated_to): the time span in which a column has values."""
    kind = df.schema[anchor].dataType
    at = F.col(f"`{anchor}`")
    each = [F.struct(F.lit(c).alias("column_name"), X.published(F.min(F.when(F.col(f"`{c}`").isNotNull(), at)), kind).alias("populated_from"), X.published(F.max(F.when(F.col(f"`{c}`").isNotNull(), at)), kind).alias("populated_to")) for c in columns]
    return df.agg(F.array(*each).alias("each")).select(F.inline("each"))
