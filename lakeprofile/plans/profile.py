"""The profile of many tables: what is measured of which column is decided from cheaper measurements."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions import expressions as X
from lakeprofile.functions import shapes
from lakeprofile.functions.sensitivity import sensitivity
from lakeprofile.operators import edges, nested, quantiles, scalar, sketch, tablewide, values
from lakeprofile.plans.settings import Rule, Settings, resolve
from lakeprofile.sources import tables as source

LONG = "table_name string, column_name string, stat string, number double, text string"
#: Columns of at most so many distinct values have their percentiles in one aggregate; others by brackets.
AGGREGATED = 50_000
#: Classes whose values are listed, and those whose distinct values are sampled for shapes.
LISTED = ("categorical", "boolean", "text", "foreign_key_candidate", "binary")
SAMPLED = ("categorical", "text", "foreign_key_candidate", "binary")
#: What keys of services and private keys begin with.
_SECRET = re.compile(r"\bAKIA[A-Z0-9]{14,}|\bgh[pousr]_[A-Za-z0-9]{36}|\bxox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bsk_live_[A-Za-z0-9]{16,}")
#: Characters of a sampled value that reach the driver.
SHOWN = 200
_COUNTS = ("null_count", "null_rate", "cardinality", "cardinality_ratio", "zero_count", "negative_count", "quantized_count", "non_finite_count", "empty_count", "length_min", "length_max", "length_avg", "length_p95")


@dataclass(frozen=True)
class Source:
    """A table to profile: its rows, and what is known of it without reading them."""

    name: str
    df: DataFrame
    comment: str | None = None
    layout: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()


def profile(spark: SparkSession, tables: dict[str, DataFrame], declared: list[edges.Table] = (), threshold: int = 50) -> DataFrame:
    """One row per column of every table; declared keys make name-inferred foreign keys of their own class."""
    named = edges.by_name(list(declared))
    keys = {t: frozenset(c for s, c, *_ in named if s == t) for t in tables}
    return reduce(DataFrame.unionByName, [scalar.phase_a(df, name, threshold, keys[name]) for name, df in tables.items()])


class _Table:
    """The measurements of one table, as long rows on the driver: some for each column, none for each row of the table."""

    def __init__(self, given: Source, settings: Settings, foreign_keys: dict[str, str], profiled_at: str) -> None:
        self.given, self.settings, self.profiled_at = given, settings, profiled_at
        self.name, self.rows = given.name, []
        self.estimate = source.row_estimate(given.df)
        share = settings.sample
        if share is None and settings.max_rows is not None:
            share = source.fraction(self.estimate, settings.max_rows)
        self.scoped = share is not None or settings.condition is not None
        self.df = source.scoped(given.df, given.name, share, settings.condition)
        self.foreign_keys = foreign_keys
        self.kinds = {f.name: f.dataType for f in given.df.schema.fields}
        self.facts: dict[str, Row] = {}
        self.suppressed: set[str] = set()

    def add(self, column: str | None, stat: str, value: object, text: str | None = None) -> None:
        """A statistic, unless it does not apply."""
        number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        said = text if text is not None else str(value).lower() if isinstance(value, bool) else value if isinstance(value, str) else None
        if number is not None or said is not None:
            self.rows.append((self.name, column, stat, number, said))

    def number(self, column: str, stat: str) -> float | None:
        return next((r[3] for r in self.rows if r[1:3] == (column, stat)), None)

    def catalogue(self) -> None:
        for f in self.given.df.schema.fields:
            self.add(f.name, "sql_type", f.dataType.simpleString())
            self.add(f.name, "nullable", f.nullable)
            self.add(f.name, "comment", f.metadata.get("comment"))
        self.add(None, "comment", self.given.comment)
        self.add(None, "physical_layout", ", ".join(self.given.layout) or None)
        self.add(None, "depends_on", ", ".join(self.given.depends_on) or None)
        for column, target in self.foreign_keys.items():
            self.add(column, "foreign_key", target)

    def base(self) -> None:
        found = scalar.phase_a(self.df, self.name, self.settings.enumeration_threshold, frozenset(self.foreign_keys), parts=True).collect()
        self.facts = {r["column_name"]: r for r in found}
        self.scanned = found[0]["row_count"] if found else 0
        self.add(None, "row_count", self.scanned)
        if self.scoped:  # the rows that were read are not those of the table
            whole = self.estimate if self.estimate is not None else self.given.df.count()
            self.rows[-1] = (self.name, None, "row_count", float(whole), "estimated" if self.estimate is not None else None)
            self.add(None, "rows_scanned", self.scanned)
            self.add(None, "scope", self.settings.condition or "sample")
        for name, r in self.facts.items():
            for stat in _COUNTS:
                self.add(name, stat, r[stat])
            self.add(name, "candidate_key", r["candidate_key"])
            self.add(name, "classification", r["classification"])

    def of_class(self, *classes: str) -> list[str]:
        return [c for c, r in self.facts.items() if r["classification"] in classes]

    def numeric(self) -> None:
        names = self.of_class("numeric")
        if not names or not self.scanned:
            return
        levels = [p / 100 for p in self.settings.percentiles]
        df = self.df.select(*[F.col(f"`{c}`") for c in names])
        ranged = {r["column_name"]: r for r in scalar.numeric_block(df).collect()}
        few = [c for c in names if self.facts[c]["cardinality"] <= AGGREGATED]
        weighed = lambda c: F.percentile(X.finite(F.col("v"), self.kinds[c]).cast("double"), levels, F.col("n"))
        each = [df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(weighed(c).alias("at")).select(F.lit(c).alias("column_name"), "at") for c in few]
        at = {r["column_name"]: r["at"] for r in reduce(DataFrame.unionByName, each).collect()} if each else {}
        for c in names:
            r, low, high = ranged[c], ranged[c]["min_value"], ranged[c]["max_value"]
            for stat, field in (("range.min", "min_value"), ("range.max", "max_value"), ("mean", "mean_value")):
                self.add(c, stat, r[field])
            self.add(c, "sum", r["sum_value"], r["sum_exact"])
            self.add(c, "unmeasured", r["unmeasured"] or None)
            found = dict(zip(levels, at[c] or ())) if c in at else quantiles.interpolated(df, X.finite(F.col(f"`{c}`"), self.kinds[c]), levels)
            for p, v in found.items():
                self.add(c, f"percentiles.p{round(100 * p):02d}", round(quantiles.coherent(v, low, high), 6))

    def temporal(self) -> None:
        names = self.of_class("temporal")
        if not names or not self.scanned:
            return
        levels = [p / 100 for p in self.settings.percentiles]
        for r in scalar.temporal_block(self.df.select(*[F.col(f"`{c}`") for c in names]), self.profiled_at).collect():
            c, kind = r["column_name"], self.kinds[r["column_name"]]
            strange = r["unrepresentable"].split(",")
            for stat, field in (("range.min", "min_value"), ("range.max", "max_value")):
                self.add(c, stat, None if stat[-3:] in strange else r[field])
            self.add(c, "unrepresentable", r["unrepresentable"] or None)
            for stat in ("span_days", "freshness", "max_age_days"):
                self.add(c, stat, r[stat])
            if self.facts[c]["cardinality"] <= AGGREGATED:
                counted = self.df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
                found = quantiles.nearest_of([tuple(x) for x in counted.select(X.micros(F.col("v"), kind), "n").collect()], levels)
            else:
                found = quantiles.nearest(self.df, X.micros(F.col(f"`{c}`"), kind), levels)
            at = F.timestamp_micros(F.col("us"))
            shown = X.published(X.local(at, T.TimestampType()) if isinstance(kind, T.TimestampNTZType) else at.cast(kind), kind)
            spark = self.df.sparkSession
            for p, text in spark.createDataFrame([(p, int(v)) for p, v in found.items()], "p double, us long").select("p", shown).collect():
                self.add(c, f"percentiles.p{round(100 * p):02d}", text)

    def listed(self) -> None:
        names = [c for c in self.of_class(*LISTED) if c not in self.suppressed]
        if not names or not self.scanned:
            return
        s = self.settings
        text = [c for c in names if X.family(self.kinds[c]) == "text"]
        top, spelt = values.most_frequent(self.df, names, max(s.enumeration_threshold, s.top_n_values) + 1, text)
        listed = values.value_list(top, s.top_n_values, s.enumeration_threshold).collect()
        for r in listed:
            self.add(r["column_name"], f"values[{r['rank']}]", r["n"], r["value"])
        spark = self.df.sparkSession
        totals = spark.createDataFrame([(c, self.scanned - self.facts[c]["null_count"]) for c in names], "column_name string, non_null long")
        for r in values.distribution_of(spark.createDataFrame([(r["column_name"], None, *r[2:]) for r in listed], values.LISTED), totals).collect():
            self.add(r["column_name"], "distribution", r["distribution"])
            self.add(r["column_name"], "values_coverage", r["values_coverage"])
            if r["listed_count"] > r["non_null"]:  # two reads that disagree
                self.add(r["column_name"], "coverage_incoherent", True)
        for c, n in spelt.items():
            self.add(c, "spelling_groups", n)

    def inferred(self) -> None:
        """Shapes and sensitivity, from a sample of distinct values."""
        names, n = [c for c in self.of_class(*SAMPLED) if X.family(self.kinds[c]) in ("text", "binary")], self.settings.looks_like_sample_size
        text = [c for c in names if X.family(self.kinds[c]) == "text"]
        each = [values.distinct_sample(self.df, c, n, self.name).select(F.lit(c).alias("column_name"), F.substring("value", 1, SHOWN).alias("value"), shapes.shape(F.col("value")).alias("shape")) for c in text]
        sampled: dict[str, list[Row]] = {c: [] for c in text}
        for r in reduce(DataFrame.unionByName, each).collect() if each and self.scanned else ():
            sampled[r["column_name"]].append(r)
        for c, r in self.facts.items():
            rows = sampled.get(c, [])
            tally: dict[str, int] = {}
            for x in rows:
                if x["shape"]:
                    tally[x["shape"]] = tally.get(x["shape"], 0) + 1
            v = shapes.verdict(tally, len(rows), r["cardinality"] or 0, self.scanned, c)
            self.add(c, "inferred.looks_like", v.get("looks_like"))
            if v.get("looks_like") == "prose":
                self.suppressed.add(c)
            share = {k: t / len(rows) for k, t in tally.items()}
            found = sensitivity(c, [x["value"] for x in rows], share, X.family(self.kinds[c]) == "boolean")
            self.add(c, "inferred.sensitivity", found)
            if text_secrets := sum(bool(_SECRET.search(x["value"])) for x in rows):
                self.add(c, "inferred.secrets", text_secrets)
            low, high = self.number(c, "range.min"), self.number(c, "range.max")
            if isinstance(self.kinds[c], X.INTEGRAL) and low is not None:
                self.add(c, "inferred.epoch_unit", next((unit for unit, k in (("seconds", 1), ("milliseconds", 1000)) if low >= 1e9 * k and high <= 2e9 * k), None))
        for c in self.of_class("binary"):
            kinds = self.df.where(F.col(f"`{c}`").isNotNull()).groupBy(shapes.binary_kind(F.col(f"`{c}`")).alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").first()
            self.add(c, "inferred.binary_kind", kinds["k"] if kinds else None)

    def whole_table(self) -> None:
        """Null patterns; and of tables that were read whole and hold rows: grain, dependencies, timeline."""
        if self.scanned:
            whole = frozenset(c for c, r in self.facts.items() if not r["null_count"])
            for r in tablewide.null_patterns(self.df, self.settings.top_n_null_patterns, whole).collect():
                self.add(None, f"null_patterns[{r['pattern']}]", r["n"])
        if self.scoped or not self.scanned:
            return
        plain = {c: r for c, r in self.facts.items() if r["cardinality"] is not None}
        clean_key = any(r["candidate_key"] and not r["null_count"] for r in plain.values())
        if not clean_key:
            found = tablewide.grain_candidates({c: r["cardinality"] for c, r in plain.items()}, {c: r["null_count"] for c, r in plain.items()}, self.scanned)
            found = tablewide.unrefuted(self.df, found, {c: r["cardinality"] for c, r in plain.items()}, self.scanned)
            for r in tablewide.grain(self.df, found).where("is_key").collect() if found else ():
                self.add(None, f"grain[{r['a']},{r['b']}]", r["distinct_pairs"])
        pairs = tablewide.dependency_candidates({c: (r["classification"], r["cardinality"], r["null_count"], r["candidate_key"]) for c, r in plain.items()})
        cards = self.df.sparkSession.createDataFrame([(c, r["cardinality"]) for c, r in plain.items()], "column_name string, cardinality long")
        for r in tablewide.dependencies(self.df, pairs, cards).where(F.col("strength") >= tablewide.STRONG).collect() if pairs else ():
            self.add(None, f"dependencies[{r['determinant']}->{r['dependent']}]", r["strength"])
        spans = {r[1]: r[3] for r in self.rows if r[2] == "span_days"}
        anchor = next((c for c in self.given.layout if c in spans), None) or tablewide.timeline_anchor([(c, self.facts[c]["null_rate"], self.facts[c]["cardinality"]) for c in spans])
        if anchor:
            unit = tablewide.timeline_unit(int(spans[anchor]))
            self.add(None, "timeline", None, f"{anchor} by {unit}")
            for r in tablewide.timeline(self.df, anchor, unit).collect():  # at most a bucket a month beyond two years
                self.add(None, f"timeline[{r['bucket']}]", r["n"])
            gaps = [c for c, r in self.facts.items() if r["null_count"] and c != anchor]
            for r in tablewide.populated_windows(self.df, anchor, gaps).collect() if gaps else ():
                self.add(r["column_name"], "populated.from", r["populated_from"])
                self.add(r["column_name"], "populated.to", r["populated_to"])

    def parts(self) -> None:
        """Array sizes, vectors, struct members, map keys, and the elements of arrays of plain values."""
        for c, kind in self.kinds.items():
            if not self.scanned or not isinstance(kind, X.NESTED):
                continue
            if isinstance(kind, T.ArrayType):
                r = nested.array_shape(self.df, c).first()
                for stat in ("size_min", "size_max", "size_avg", "size_p95", "empties"):
                    self.add(c, stat, r[stat])
                if X.is_vector(kind):
                    v = nested.vector_norms(self.df, c).first()
                    for stat in ("dimension", "norm_min", "norm_max", "zero_count"):
                        self.add(c, f"vector.{stat}", v[stat])
                elements = nested.array_elements(self.df, c)
                path = f"{c}[*]"
                if X.family(kind.elementType) not in ("nested", "unsupported"):
                    self.part(elements.withColumnRenamed("element", path), path, listed=not X.is_vector(kind))
            elif isinstance(kind, T.StructType):
                for f in kind.fields[: self.settings.max_parts]:
                    if X.family(f.dataType) not in ("nested", "unsupported"):
                        inside = self.df.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`.`{f.name}`").alias(f"{c}.{f.name}"))
                        self.part(inside, f"{c}.{f.name}")
            else:
                for r in nested.map_keys(self.df, c, self.settings.max_parts).collect():
                    self.add(f"{c}[{r['key']}]", "occurrences", r["n"])

    def part(self, df: DataFrame, path: str, listed: bool = True) -> None:
        r = scalar.phase_a(df, self.name, self.settings.enumeration_threshold).first()
        for stat in ("row_count", *_COUNTS):
            self.add(path, stat, r[stat])
        self.add(path, "classification", r["classification"])
        if listed and r["classification"] in LISTED:
            for v in values.value_list(values.frequencies(df, [path]), self.settings.top_n_values, self.settings.enumeration_threshold).collect():
                self.add(path, f"values[{v['rank']}]", v["n"], v["value"])


def by_value(given: list[Source], facts: dict[str, dict[str, Row]], dense: set[str] = frozenset(), k: int = sketch.K) -> list[tuple[str, str]]:
    """(child, parent), as ``table.column``: foreign keys that the key sketches of whole tables show.

    Parents are candidate keys, children the other columns of few thousand values
    or whose names end as keys' do; one job makes all sketches, of at most ``k`` numbers each.
    """
    sides, each = {}, []
    for s in given:
        for f in s.df.schema.fields:
            r = facts.get(s.name, {}).get(f.name)
            if r is None or not isinstance(f.dataType, (*X.INTEGRAL, T.StringType)) or not r["cardinality"]:
                continue
            if r["candidate_key"] or r["cardinality"] <= k or f.name.lower().endswith(edges.SUFFIX):
                label = f"{s.name}.{f.name}"
                kind = "integer" if isinstance(f.dataType, X.INTEGRAL) else "text"
                sides[label] = {"name": label, "kind": kind, "cardinality": r["cardinality"], "hashes": [], "exhaustive": r["cardinality"] < k, "dense": label in dense, "key": r["candidate_key"]}
                each.append(sketch.key_sketch(s.df, f.name, k).select(F.lit(label).alias("label"), "h"))
    for r in reduce(DataFrame.unionByName, each).collect() if each else ():
        sides[r["label"]]["hashes"].append(int(r["h"]))
    for side in sides.values():
        side["hashes"].sort()
    return edges.by_value([x for x in sides.values() if not x["key"]], [x for x in sides.values() if x["key"]])


def full(spark: SparkSession, given: list[Source], rules: list[Rule] = (), declared: list[edges.Table] = (), profiled_at: str = "1970-01-01 00:00:00", infer: bool = True, defaults: Settings = Settings(), parallelism: int = 4) -> DataFrame:
    """(table_name, column_name, stat, number, text): every statistic of every table, by its settings.

    Statistics of a table have no column; a part of a nested column is a column
    of its own, named by its path.  Tables in the mode ``catalog`` are not read.
    Of a scoped table nothing is published that holds for whole tables only.
    What comes to the driver is bounded by columns and settings; so many tables
    as ``parallelism`` says have jobs at one time.
    """
    named = edges.by_name(list(declared))

    def measure(s: Source) -> _Table:
        settings = resolve(s.name, rules, source.row_estimate(s.df), defaults)
        t = _Table(s, settings, {c: f"{target}.{key}" for name, c, target, key in named if name == s.name}, profiled_at)
        t.catalogue()
        if settings.mode != "catalog":
            t.base()
            t.numeric()
            t.temporal()
            if infer:
                t.inferred()
            t.listed()
            t.whole_table()
            t.parts()
        return t

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(measure), given))
    rows = [r for t in done for r in t.rows]
    dense = {f"{t.name}.{c}" for t in done for c, r in t.facts.items() for low, high in [(t.number(c, "range.min"), t.number(c, "range.max"))] if low is not None and high - low + 1 == r["cardinality"]}
    links = [(name, c, target, key) for name, c, target, key in named]
    if infer:
        whole = [t for t in done if t.facts and not t.scoped]
        by_sketch = [(*child.split(".", 1), *parent.split(".", 1)) for child, parent in by_value([t.given for t in whole], {t.name: t.facts for t in whole}, dense)]
        rows += [(name, c, "foreign_key.by_value", None, f"{target}.{key}") for name, c, target, key in by_sketch]
        links += [e for e in by_sketch if e not in links]
    known = {t.name: t for t in done if t.facts and not t.scoped}
    for name, c, target, key in links:
        if name in known and target in known:
            cost = edges.observed(known[name].df, c, known[target].df, key).first()
            rows += [(name, c, f"edge[{target}.{key}].{stat}", float(cost[stat]), None) for stat in ("fanout_avg", "fanout_max", "containment", "target_coverage") if cost[stat] is not None]
            rows.append((target, key, f"referenced_by[{name}.{c}]", None, f"{name}.{c}"))
    return spark.createDataFrame(rows, LONG)
