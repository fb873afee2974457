"""What a reader asks of published profiles: seven read-only questions, each answered from the stored table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.operators import context, drift, resolve
from lakeprofile.sources import store


class Lookup:
    """The published versions of long profiles (table_name, column_name, stat, number, text) in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _profile(self, version: int | None = None) -> DataFrame:
        return store.load(self.spark, self.folder, version)

    def manifest(self) -> DataFrame:
        """(version, tables, columns, statistics) of every published version."""
        each = [self._profile(v).agg(F.lit(v).alias("version"), F.count_distinct("table_name").alias("tables"), F.count_distinct("table_name", "column_name").alias("columns"), F.count(F.lit(1)).alias("statistics")).first() for v in store.versions(self.spark, self.folder)]
        return self.spark.createDataFrame([tuple(r) for r in each], "version long, tables long, columns long, statistics long")

    def list_tables(self) -> DataFrame:
        """(table_name, row_count, columns) of the last version."""
        rows = F.max(F.when(F.col("column_name").isNull() & (F.col("stat") == "row_count"), F.col("number")))
        return self._profile().groupBy("table_name").agg(rows.cast("long").alias("row_count"), F.count_distinct("column_name").alias("columns"))

    def table_context(self, table: str, budget: int = 4000) -> str:
        """One table as Markdown within a budget of tokens; its questions come last."""
        found = self._profile().where(F.col("table_name") == table).collect()  # some rows a column
        stats: dict[str | None, dict[str, object]] = {}
        for r in found:
            stats.setdefault(r["column_name"], {})[r["stat"]] = r["text"] if r["text"] is not None else r["number"]
        whole = stats.pop(None, {})
        head = context.Section("header", f"# {table}\n{int(whole.get('row_count') or 0)} rows, {len(stats)} columns", pinned=True)
        facts = context.Section("table", "\n".join(f"- {k}: {v}" for k, v in sorted(whole.items()) if k.split("[")[0] in ("grain", "dependencies", "comment", "depends_on", "timeline", "scope") and "[20" not in k), 0)
        lines = [context.Section(c, f"- {c}: " + ", ".join(f"{k} {s[k]}" for k in ("classification", "cardinality", "null_rate", "range.min", "range.max", "foreign_key", "inferred.looks_like", "inferred.sensitivity") if k in s), 1 + i) for i, (c, s) in enumerate(sorted(stats.items()))]
        kept, dropped = context.select([head, facts, *lines], budget)
        return "\n".join(s.text for s in kept if s.text) + (f"\n({len(dropped)} sections left out)" if dropped else "")

    def search_columns(self, pattern: str | None = None, **equal: object) -> DataFrame:
        """(table_name, column_name) of the columns whose name matches and whose statistics equal what is asked."""
        found = self._profile().where("column_name IS NOT NULL")
        for stat, wanted in equal.items():
            said = F.coalesce("text", F.col("number").cast("string"))
            has = found.where((F.col("stat") == stat) & (said == F.lit(wanted).cast("string"))).select("table_name", "column_name")
            found = found.join(has.distinct(), ["table_name", "column_name"], "left_semi")
        return resolve.search_columns(found, pattern).select("table_name", "column_name").distinct()

    def resolve_value(self, table: str, column: str, asked: str) -> DataFrame:
        """(value, n, match, score, complete, scoped): the stored spellings nearest to ``asked``, whether the list holds every value, and whether only part of the table was read."""
        of = self._profile().where((F.col("table_name") == table) & ((F.col("column_name") == column) | F.col("column_name").isNull()))
        listed = of.where(F.col("stat").startswith("values[")).select(F.col("text").alias("value"), F.col("number").cast("long").alias("n"))
        facts = of.agg(F.coalesce(F.max(F.when(F.col("stat") == "values_coverage", F.col("number") == 1)), F.lit(False)).alias("complete"), F.coalesce(F.max(F.col("stat") == "scope"), F.lit(False)).alias("scoped"))
        return resolve.resolve_value(listed, asked).crossJoin(F.broadcast(facts))  # one row

    def diff(self, before: int, after: int | None = None) -> DataFrame:
        """The drift between two versions, by default to the last."""
        return drift.compare(self._profile(before), self._profile(after))

    def reference(self, topic: str) -> str:
        """What a statistic or a rule means."""
        rules = context.COLUMN_RULES | context.TABLE_RULES
        if topic in rules:
            return f"{topic}: must hold {rules[topic]}"
        said = {"values": "frequent values with their counts, by count, then text", "grain": "a pair of columns that tells all rows apart", "dependencies": "how nearly one column decides another", "timeline": "rows by day, week or month of the column that dates rows best", "null_patterns": "which columns are null together: 1 is null, by column order", "inferred.looks_like": "the shape that 95 % of the sampled values have", "inferred.sensitivity": "the kind of personal data that the name and the values suggest"}
        return f"{topic}: {said.get(topic, 'a statistic of the column or the table')}"
