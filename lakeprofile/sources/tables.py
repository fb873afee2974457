"""Tables as they lie: discovery, catalogue facts, and the scope that is read of them."""

from __future__ import annotations

import math
import re
import zlib
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.operators import edges

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """A table of a folder in one of ``FORMATS``; csv has a header line."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return reader.format(kind).load(f"{folder}/{name}.{kind}")


def write(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{folder}/{name}.{kind}")


def list_tables(spark: SparkSession, folder: str, include: list[str] = ("*",), exclude: list[str] = (), kind: str = "parquet") -> list[str]:
    """Names below ``folder`` that a pattern includes and none excludes, through the file system that Spark reads with."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(n[: -len(kind) - 1] for s in found if (n := s.getPath().getName()).endswith("." + kind))
    matches = lambda n, patterns: any(fnmatchcase(n.lower(), p) for p in patterns)
    return [n for n in names if matches(n, include) and not matches(n, exclude)]


def columns(df: DataFrame, name: str) -> DataFrame:
    """(table_name, ordinal, column_name, sql_type, nullable, comment) from the schema; an empty one is an error."""
    if not df.schema.fields:
        raise ValueError(f"{name} has no columns")
    rows = [(name, i, f.name.lower(), f.dataType.simpleString(), f.nullable, f.metadata.get("comment")) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "table_name string, ordinal long, column_name string, sql_type string, nullable boolean, comment string")


def quoted(name: str) -> str:
    """A name as SQL reads it back: in backquotes unless it is plain."""
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame, name: str) -> str:
    """A CREATE TABLE text that does not depend on where the table lies."""
    inside = ",\n".join(f"  {quoted(f.name)} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)
    return f"CREATE TABLE {quoted(name)} (\n{inside}\n)"


def row_estimate(df: DataFrame) -> int | None:
    """The optimiser's row count where it has one."""
    found = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(found.get())) if found.isDefined() else None


def physical_layout(spark: SparkSession, table: str) -> list[str]:
    """Partition columns of a catalogue table."""
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def view_dependencies(df: DataFrame) -> list[str]:
    """Names of the catalogue tables that a DataFrame's plan reads, through views too; without any, the files that it reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    named = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.catalogTable().isDefined():
            named.add(leaf.catalogTable().get().identifier().unquotedString())
    return sorted(named or set(df.inputFiles()))


def comments(df: DataFrame) -> dict[str, str]:
    """The comments of columns that have one."""
    return {f.name: f.metadata["comment"] for f in df.schema.fields if f.metadata.get("comment")}


def declared(df: DataFrame, name: str, constraints: DataFrame) -> edges.Table:
    """What is declared of a table: its column types, and its one-column keys from ``constraints`` (table_name, key_columns, is_primary), the primary one first.

    Spark enforces no keys, so the caller supplies them.
    """
    rows = constraints.where(F.col("table_name") == name).select("key_columns", "is_primary").collect()  # a few for each table
    keys = [r["key_columns"][0] for r in sorted(rows, key=lambda r: (not r["is_primary"], r["key_columns"])) if len(r["key_columns"]) == 1]
    return edges.Table(name, {f.name: f.dataType.simpleString() for f in df.schema.fields}, tuple(keys))


def foreign_keys(name: str, constraints: DataFrame) -> list[tuple[tuple[str, ...], str, tuple[str, ...]]]:
    """(columns, target, target columns) of a table's declared foreign keys, composite ones too, from ``constraints`` (table_name, key_columns, target, target_columns)."""
    rows = constraints.where((F.col("table_name") == name) & F.col("target").isNotNull()).select("key_columns", "target", "target_columns").collect()  # a few for each table
    return sorted((tuple(r["key_columns"]), r["target"], tuple(r["target_columns"])) for r in rows)


def unique_keys(name: str, constraints: DataFrame) -> list[tuple[tuple[str, ...], bool]]:
    """(columns, is primary) of a table's declared keys, composite ones too, the primary one first."""
    rows = constraints.where(F.col("table_name") == name).select("key_columns", "is_primary").collect()
    return sorted(((tuple(r["key_columns"]), bool(r["is_primary"])) for r in rows), key=lambda k: (not k[1], k[0]))


def read_catalogue(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the session's catalogue."""
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """A table of another database; ``partition`` (column, low, high, parts) lets several tasks read it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def table_comment(spark: SparkSession, name: str) -> str | None:
    """The comment of a catalogue table."""
    return spark.catalog.getTable(name).description


def statements(sql: str) -> list[str]:
    """The statements of a text: semicolons in literals, quoted names and comments part nothing."""
    parts = re.findall(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", sql, re.S)
    found, now = [], []
    for p in [*parts, ";"]:
        if p == ";":
            text = "".join(now).strip()
            if re.sub(r"--[^\n]*|/\*.*?\*/", "", text, flags=re.S).strip():
                found.append(text)
            now = []
        else:
            now.append(p)
    return found


def execute(spark: SparkSession, sql: str) -> DataFrame:
    """The rows of the last statement of ``sql``."""
    out = None
    for statement in statements(sql):
        out = spark.sql(statement)
    if out is None:
        raise ValueError("no statement")
    return out


def lineage(df: DataFrame) -> DataFrame:
    """(column_name, source, source_column): the columns of stored relations that each output column is computed from.

    Read from the analysed plan; a column of constants has no row, and filters and joins add none.
    """
    analysed = df._jdf.queryExecution().analyzed()
    parents: dict[int, set[int]] = {}
    leaves: dict[int, tuple[str, str]] = {}

    def each(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    def walk(node) -> None:
        kind, children = node.getClass().getSimpleName(), list(each(node.children()))
        if not children:
            name = kind
            if kind == "LogicalRelation":
                name = _relation_name(node)
            for a in each(node.output()):
                leaves[a.exprId().id()] = (name, a.name())
        if kind == "Union":
            for child in children:
                for out, a in zip(each(node.output()), each(child.output())):
                    parents.setdefault(out.exprId().id(), set()).add(a.exprId().id())
        for e in each(node.expressions()):
            note(e)
        if kind == "Generate":
            used = {r.exprId().id() for r in each(node.generator().references().toSeq())}
            for a in each(node.generatorOutput()):
                parents.setdefault(a.exprId().id(), set()).update(used)
        for child in children:
            walk(child)

    def note(e) -> None:
        if e.getClass().getSimpleName() == "Alias":
            parents.setdefault(e.exprId().id(), set()).update(r.exprId().id() for r in each(e.references().toSeq()))
        for child in each(e.children()):
            note(child)

    walk(analysed)
    rows = set()
    for a in each(analysed.output()):
        todo, seen = [a.exprId().id()], set()
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            if i in leaves:
                rows.add((a.name(), *leaves[i]))
            todo += parents.get(i, ())
    return df.sparkSession.createDataFrame(sorted(rows), "column_name string, source string, source_column string")


def _relation_name(node) -> str:
    """A catalogue table's name, else the names of the files' folder."""
    if node.catalogTable().isDefined():
        return node.catalogTable().get().identifier().unquotedString()
    paths = node.relation().location().rootPaths()
    return ",".join(sorted(paths.apply(i).getName().partition(".")[0] for i in range(paths.size())))


def seed_of(name: str) -> int:
    """A seed that only the table's name decides."""
    return zlib.crc32(name.encode()) & 0x7FFFFFFF


def scoped(df: DataFrame, name: str, sample: float | None = None, condition: str | None = None) -> DataFrame:
    """A filter or a repeatable sample of a table; asking for both is an error.

    The sample is drawn by the hash of a row's own values, so every statement,
    retry and partitioning reads the same rows.
    """
    if sample is not None and condition is not None:
        raise ValueError("a scope is a sample or a filter")
    if condition is not None:
        return df.where(condition)
    if sample is None:
        return df
    plain = [F.col(f"`{f.name}`") if f.dataType.typeName() not in ("map", "variant") else F.to_json(f"`{f.name}`") for f in df.schema.fields]
    return df.where(F.pmod(F.xxhash64(F.lit(seed_of(name)), *plain), F.lit(1 << 30)) < int(sample * (1 << 30)))


def fraction(estimate: int | None, most: int) -> float | None:
    """The share that keeps about ``most`` rows, on a grid of steps of a tenth, so that small growth changes nothing."""
    if estimate is None or estimate <= most:
        return None
    return 1.1 ** math.floor(math.log(most / estimate, 1.1))
