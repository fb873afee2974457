"""Every registered query of the profiling operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions import expressions as X
from lakeprofile.functions import shapes
from lakeprofile.functions.sensitivity import sensitivity
from lakeprofile.operators import assertions, context, drift, edges, nested, quantiles, redact, resolve, scalar, sketch, tablewide, values
from lakeprofile.plans import settings
from lakeprofile.plans.profile import Source, full, profile
from lakeprofile.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2026-06-01 00:00:00"

#: Column families of the driver's tables, for the oracle's text: n number, f float, s text, t local time, x nested.
SCHEMAS = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:f c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:f",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:f",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:f props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "pages": "page_id:n url:s html:s",
    "conversations": "conv_id:n turn:n role:s text:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in SCHEMAS[table].split()]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, sf_dir, name)


def union_sql(table: str, select: Callable[[str, str], str | None], source: str | None = None) -> str:
    return "\nUNION ALL ".join(f"SELECT {s} FROM {source or table}" for c, k in columns_of(table) if (s := select(c, k)))


# --- phase A ----------------------------------------------------------------

_RATE = "CASE WHEN {w} = 0 THEN 0.0 WHEN {p} > 0 AND round({p} / {w}, 6) < 1e-6 THEN 1e-6 WHEN {p} < {w} AND round({p} / {w}, 6) > 0.999999 THEN 0.999999 ELSE round({p} / {w}, 6) END"


def phase_a_sql(table: str, source: str | None = None) -> str:
    def one(c: str, k: str) -> str:
        number, text = k in "nf", k == "s"
        ratio = f"CASE WHEN count(*) = 0 OR count(DISTINCT {c}) = 0 THEN 0.0 ELSE greatest(round(count(DISTINCT {c}) / count(*), 6), 1e-6) END"
        cls = {"n": "numeric", "f": "numeric", "s": "text", "t": "temporal"}[k]
        return ", ".join(
            [
                f"'{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count",
                _RATE.format(p=f"(count(*) - count({c}))", w="count(*)") + " AS null_rate",
                f"count(DISTINCT {c}) AS cardinality, {ratio} AS cardinality_ratio",
                (f"count(*) FILTER ({c} = 0)" if number else "NULL::BIGINT") + " AS zero_count",
                (f"count(*) FILTER ({c} < 0)" if number else "NULL::BIGINT") + " AS negative_count",
                (f"count(*) FILTER ({c} = floor({c}))" if number else f"count(*) FILTER ({c} = date_trunc('day', {c}))" if k == "t" else "NULL::BIGINT") + " AS quantized_count",
                (f"count({c}) - count(*) FILTER (isfinite({c}))" if k == "f" else "NULL::BIGINT") + " AS non_finite_count",
                (f"count(*) FILTER ({c} = '')" if text else "NULL::BIGINT") + " AS empty_count",
                (f"min(length({c}))::BIGINT" if text else "NULL::BIGINT") + " AS length_min",
                (f"max(length({c}))::BIGINT" if text else "NULL::BIGINT") + " AS length_max",
                (f"round(avg(length({c})), 6)" if text else "NULL::DOUBLE") + " AS length_avg",
                (f"round(quantile_cont(length({c}), 0.95), 6)" if text else "NULL::DOUBLE") + " AS length_p95",
                f"count(DISTINCT {c}) > 0 AND {ratio} >= 0.9999 AS candidate_key",
                f"CASE WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE '{cls}' END AS classification",
            ]
        )

    return union_sql(table, one, source)


for _t in SCHEMAS:
    query(f"phase_a_{_t}", phase_a_sql(_t))(lambda spark, sf, t=_t: scalar.phase_a(load(spark, sf, t), t))

PROFILED = ("customer", "nation", "orders", "part")


@query("profile_tables", "\nUNION ALL ".join(phase_a_sql(t) for t in PROFILED))
def _profile_tables(spark, sf):
    return profile(spark, {t: load(spark, sf, t) for t in PROFILED})


@query("classify_all", "SELECT table_name, column_name, classification FROM (" + "\nUNION ALL ".join(phase_a_sql(t) for t in PROFILED) + ")")
def _classify_all(spark, sf):
    return profile(spark, {t: load(spark, sf, t) for t in PROFILED}).select("table_name", "column_name", "classification")


@query("candidate_keys", "SELECT table_name, column_name FROM (" + "\nUNION ALL ".join(phase_a_sql(t) for t in PROFILED) + ") WHERE candidate_key")
def _candidate_keys(spark, sf):
    return profile(spark, {t: load(spark, sf, t) for t in PROFILED}).where("candidate_key").select("table_name", "column_name")


#: events with nulls, spelling variants, non-finite values and an epoch: the driver's tables have none.
HOLES = "SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) WHEN event_id % 5 = 0 THEN concat(' ', event_type, ' ') WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 19 <> 0 THEN value END AS value FROM events"


def holes(spark, sf) -> DataFrame:
    return spark.sql(HOLES.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))


_HOLE_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")


@query("null_counts", f"WITH h AS ({HOLES}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, {_RATE.format(p=f'(count(*) - count({c}))', w='count(*)')} AS null_rate FROM h" for c in _HOLE_COLUMNS))
def _null_counts(spark, sf):
    return scalar.base(holes(spark, sf)).select("column_name", "row_count", "null_count", X.rate(F.col("null_count"), F.col("row_count")).alias("null_rate"))


@query("non_finite_counts", f"WITH h AS ({HOLES}) SELECT 'value' AS column_name, count(value) - count(*) FILTER (isfinite(value)) AS non_finite_count, count(*) FILTER (isfinite(value) AND value < 0) AS negative_count FROM h")
def _non_finite(spark, sf):
    return scalar.base(holes(spark, sf).select("value")).select("column_name", "non_finite_count", "negative_count")


@query("zero_negative_counts", union_sql("lineitem", lambda c, k: f"'{c}' AS column_name, count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count" if k in "nf" else None))
def _zero_negative(spark, sf):
    return scalar.base(load(spark, sf, "lineitem")).where("zero_count IS NOT NULL").select("column_name", "zero_count", "negative_count")


@query("quantized_numeric", union_sql("part", lambda c, k: f"'{c}' AS column_name, count(*) FILTER ({c} = floor({c})) AS quantized_count" if k in "nf" else None))
def _quantized(spark, sf):
    return scalar.base(load(spark, sf, "part")).where("zero_count IS NOT NULL").select("column_name", "quantized_count")


@query("empty_counts", "SELECT 'e' AS column_name, count(*) FILTER (coalesce(nullif(event_type, 'click'), '') = '') AS empty_count FROM events")
def _empty(spark, sf):
    return scalar.base(load(spark, sf, "events").select(F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("")).alias("e"))).select("column_name", "empty_count")


@query("text_lengths_documents", union_sql("documents", lambda c, k: f"'{c}' AS column_name, min(length({c}))::BIGINT AS length_min, max(length({c}))::BIGINT AS length_max, round(avg(length({c})), 6) AS length_avg, round(quantile_cont(length({c}), 0.95), 6) AS length_p95" if k == "s" else None))
def _lengths(spark, sf):
    return scalar.base(load(spark, sf, "documents")).where("length_min IS NOT NULL").select("column_name", "length_min", "length_max", "length_avg", "length_p95")


def numeric_sql(table: str) -> str:
    def one(c: str, k: str) -> str | None:
        if k not in "nf":
            return None
        mean, total = (f"avg({c})", f"sum({c})") if k == "f" else (f"sum({c}::DECIMAL(38, 0))::DOUBLE / count({c})", f"sum({c}::DECIMAL(38, 0))::DOUBLE")
        return f"'{c}' AS column_name, round(min({c})::DOUBLE, 6) AS min_value, round(max({c})::DOUBLE, 6) AS max_value, round({mean}, 6) AS mean_value, round({total}, 2) AS sum_value, {f'sum({c})::VARCHAR' if k == 'n' else 'NULL::VARCHAR'} AS sum_exact, '' AS unmeasured"

    return union_sql(table, one)


for _t in ("lineitem", "orders", "part"):  # a sum of doubles depends on its order in its last figures
    query(f"numeric_block_{_t}", numeric_sql(_t))(lambda spark, sf, t=_t: scalar.numeric_block(load(spark, sf, t)).withColumn("sum_value", F.round("sum_value", 2)))

_ODD_NUMBERS = {"tiny": "l_quantity * 1e-9", "huge": "l_quantity * 1e30", "flawed": "CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END", "money": "CAST(l_extendedprice AS DECIMAL(18,2))", "wide": "l_orderkey * CAST(1000000000 AS BIGINT)", "lost": "CAST('1e308' AS DOUBLE)"}


@query("numeric_block_odd", f"""WITH e AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _ODD_NUMBERS.items())} FROM lineitem), six AS (SELECT min(tiny) AS a, max(tiny) AS b, avg(tiny) AS m FROM e)
SELECT 'tiny' AS column_name, printf('%.5e', a)::DOUBLE AS min_value, printf('%.5e', b)::DOUBLE AS max_value, printf('%.5e', m)::DOUBLE AS mean_value, '' AS unmeasured, NULL::VARCHAR AS sum_exact FROM six
UNION ALL SELECT 'huge', min(huge), max(huge), printf('%.9e', avg(huge))::DOUBLE, '', NULL FROM e
UNION ALL SELECT 'flawed', min(flawed) FILTER (NOT isnan(flawed)), max(flawed) FILTER (NOT isnan(flawed)), round(avg(flawed) FILTER (NOT isnan(flawed)), 6), '', NULL FROM e
UNION ALL SELECT 'money', min(money)::DOUBLE, max(money)::DOUBLE, round(sum(money)::DOUBLE / count(*), 6), '', sum(money)::VARCHAR FROM e
UNION ALL SELECT 'wide', min(wide)::DOUBLE, max(wide)::DOUBLE, round(sum(wide::DECIMAL(38, 0))::DOUBLE / count(*), 6), '', sum(wide)::VARCHAR FROM e
UNION ALL SELECT 'lost', 1e308, 1e308, NULL, 'mean,sum', NULL""")
def _numeric_odd(spark, sf):
    df = spark.sql(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _ODD_NUMBERS.items())} FROM {{e}}", e=load(spark, sf, "lineitem"))
    mean = F.when(F.col("column_name") == "huge", F.format_string("%.9e", "mean_value").cast("double")).otherwise(F.col("mean_value"))
    return scalar.numeric_block(df).withColumn("mean_value", mean).drop("sum_value")


@query("zoned_times", "SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS min_value, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS max_value, count(*) FILTER (ts::DATE = ts) AS quantized_count, (SELECT count(DISTINCT ts::DATE) FROM events) AS days FROM events")
def _zoned(spark, sf):
    """Instants, read as UTC whatever the session's zone is."""
    df = load(spark, sf, "events").select(F.timestamp_micros(X.micros(F.col("ts"), T.TimestampNTZType())).alias("at"))
    days = tablewide.timeline(df, "at", "day").agg(F.count(F.lit(1)).alias("days"))
    return scalar.temporal_block(df, NOW).select("min_value", "max_value", "quantized_count").crossJoin(F.broadcast(days))  # a row each

LEVELS = (0.01, 0.25, 0.5, 0.75, 0.99)


@query("percentiles_numeric", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {p} AS level, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem" for c in ("l_extendedprice", "l_quantity") for p in LEVELS))
def _percentiles_numeric(spark, sf):
    df = load(spark, sf, "lineitem")
    rows = [(c, p, float(v)) for c in ("l_extendedprice", "l_quantity") for p, v in quantiles.interpolated(df, F.col(c), LEVELS).items()]
    return spark.createDataFrame(rows, "column_name string, level double, value double").withColumn("value", F.round("value", 4))


@query("percentiles_temporal", " UNION ALL ".join(f"SELECT 'ts' AS column_name, {p} AS level, strftime(quantile_disc(ts, {p}), '%Y-%m-%dT%H:%M:%S.%f') AS value FROM events" for p in LEVELS))
def _percentiles_temporal(spark, sf):
    df = load(spark, sf, "events")
    found = quantiles.nearest(df, X.micros(F.col("ts"), df.schema["ts"].dataType), LEVELS)
    rows = spark.createDataFrame([(p, int(v)) for p, v in found.items()], "level double, us long")
    return rows.select(F.lit("ts").alias("column_name"), "level", X.written(X.local(F.timestamp_micros("us"), T.TimestampType())).alias("value"))


def temporal_sql(table: str) -> str:
    day = "86400000000"
    at = f"TIMESTAMP '{NOW}'"
    return union_sql(table, lambda c, k: f"'{c}' AS column_name, strftime(min({c}), '%Y-%m-%dT%H:%M:%S.%f') AS min_value, strftime(max({c}), '%Y-%m-%dT%H:%M:%S.%f') AS max_value, ((epoch_us(max({c})) - epoch_us(min({c}))) // {day})::BIGINT AS span_days, count(*) FILTER ({c} = date_trunc('day', {c})) AS quantized_count, greatest(0, (epoch_us({at}) - epoch_us(max({c}))) // {day})::BIGINT AS max_age_days, CASE WHEN greatest(0, (epoch_us({at}) - epoch_us(max({c}))) // {day}) < 7 THEN 'live' WHEN greatest(0, (epoch_us({at}) - epoch_us(max({c}))) // {day}) < 90 THEN 'stale' ELSE 'dormant' END AS freshness, '' AS unrepresentable" if k == "t" else None)


for _t in ("events", "orders", "lineitem"):
    query(f"temporal_block_{_t}", temporal_sql(_t))(lambda spark, sf, t=_t: scalar.temporal_block(load(spark, sf, t), NOW))

# --- values -----------------------------------------------------------------


def freq_sql(table: str, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}" for c in names)


def list_sql(freq: str, top_n: int = 20) -> str:
    return f"WITH f AS ({freq}), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY column_name) <= 50 AS exhaustive FROM f) SELECT column_name, value, n, rank, exhaustive FROM r WHERE exhaustive OR rank <= {top_n}"


_LISTED = ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
_SHAPED = {"events": ("event_type", "user_id"), "documents": ("lang", "source"), "lineitem": _LISTED, "orders": ("o_orderpriority", "o_custkey")}
query("value_list_event_type", list_sql(freq_sql("events", ("event_type",))))(lambda spark, sf: values.value_list(values.frequencies(load(spark, sf, "events"), ["event_type"])))
query("value_list_lineitem", list_sql(freq_sql("lineitem", _LISTED)))(lambda spark, sf: values.value_list(values.frequencies(load(spark, sf, "lineitem"), list(_LISTED))))
query("top_n_events_user", list_sql(freq_sql("events", ("user_id",)), 10))(lambda spark, sf: values.value_list(values.frequencies(load(spark, sf, "events"), ["user_id"]), 10))


def distribution_sql(table: str, names: tuple[str, ...]) -> str:
    return distribution_sql_of(freq_sql(table, names))


def distribution_sql_of(freq: str) -> str:
    return f"""WITH l AS ({list_sql(freq)}), t AS (SELECT column_name, sum(n)::BIGINT AS non_null FROM ({freq}) GROUP BY 1),
a AS (SELECT column_name, max(n) AS top_count, min(n) AS bottom_count, count(*) AS listed, sum(n)::BIGINT AS listed_count, bool_and(exhaustive) AS ex FROM l GROUP BY 1)
SELECT column_name, top_count, bottom_count, listed, listed_count, non_null, CASE WHEN ex THEN 1.0 ELSE least(round(listed_count / non_null, 6), 0.999999) END AS values_coverage,
CASE WHEN top_count / non_null >= 0.95 THEN 'dominant_value' WHEN NOT ex AND listed_count / non_null < 0.30 THEN 'long_tail' WHEN top_count > 2 * bottom_count THEN 'imbalanced' ELSE 'uniform' END AS distribution FROM a JOIN t USING (column_name)"""


for _t, _c in _SHAPED.items():
    query(f"distribution_{_t}", distribution_sql(_t, _c))(lambda spark, sf, t=_t, c=_c: values.distribution(values.frequencies(load(spark, sf, t), list(c))))


@query("spelling_groups", f"WITH h AS ({HOLES}), f AS (SELECT event_type AS value, count(*) AS n FROM h WHERE event_type IS NOT NULL GROUP BY 1) SELECT 'event_type' AS column_name, lower(trim(value)) AS folded, arg_min(value, (-n, value)) AS canonical, count(*) AS spellings, sum(n)::BIGINT AS n FROM f GROUP BY 2 HAVING count(*) > 1")
def _spelling(spark, sf):
    return values.spelling_groups(values.frequencies(holes(spark, sf), ["event_type"]))


@query("normalized_cardinality", f"WITH h AS ({HOLES}) SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS cardinality, count(DISTINCT lower(trim(event_type))) AS normalized_cardinality FROM h")
def _normalized(spark, sf):
    return values.normalized_cardinality(holes(spark, sf), "event_type")


@query("distinct_sample", "SELECT value FROM (SELECT DISTINCT p_name AS value FROM part) ORDER BY md5(concat('part', value)), value LIMIT 25")
def _distinct_sample(spark, sf):
    return values.distinct_sample(load(spark, sf, "part"), "p_name", 25, "part")


@query("approx_cardinality", union_sql("lineitem", lambda c, k: f"'{c}' AS column_name, count(DISTINCT {c}) AS exact, true AS close"))
def _approx(spark, sf):
    """Estimates stand within a twentieth of the exact counts."""
    df = load(spark, sf, "lineitem")
    near = scalar.approximate_cardinalities(df).select("column_name", F.col("cardinality").alias("estimate"))
    both = scalar.cardinalities(df).join(near, "column_name")
    return both.select("column_name", F.col("cardinality").alias("exact"), (F.abs(F.col("estimate") / F.col("cardinality") - 1) <= 0.05).alias("close"))


# --- whole tables -----------------------------------------------------------

_FLAGS = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _HOLE_COLUMNS)


@query("null_patterns", f"WITH h AS ({HOLES}), p AS (SELECT {_FLAGS} AS pattern, count(*) AS n FROM h GROUP BY 1), t AS (SELECT * FROM p ORDER BY n DESC, pattern LIMIT 3) SELECT pattern, n, round((SELECT sum(n) FROM t) / (SELECT sum(n) FROM p), 6) AS coverage FROM t")
def _null_patterns(spark, sf):
    return tablewide.null_patterns(holes(spark, sf), 3)


_PAIRS = [("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey"), ("l_orderkey", "l_extendedprice")]


@query("grain_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(DISTINCT ({a}, {b})) AS distinct_pairs, count(*) AS rows, count(DISTINCT ({a}, {b})) = count(*) AS is_key FROM lineitem" for a, b in _PAIRS))
def _grain(spark, sf):
    return tablewide.grain(load(spark, sf, "lineitem"), _PAIRS)


_GRAIN_SQL = """WITH c AS (SELECT * FROM (VALUES ('conv_id', (SELECT count(DISTINCT conv_id) FROM conversations)), ('turn', (SELECT count(DISTINCT turn) FROM conversations)), ('role', (SELECT count(DISTINCT role) FROM conversations))) AS v(name, card))
SELECT 'conv_id' AS a, 'turn' AS b, count(DISTINCT (conv_id, turn)) AS distinct_pairs, count(*) AS rows, count(DISTINCT (conv_id, turn)) = count(*) AS is_key FROM conversations"""


@query("grain_search", _GRAIN_SQL)
def _grain_search(spark, sf):
    df = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    facts = scalar.phase_a(df, "conversations").select("column_name", "cardinality", "null_count", "row_count").collect()  # a row a column
    found = tablewide.grain_candidates({r["column_name"]: r["cardinality"] for r in facts}, {r["column_name"]: r["null_count"] for r in facts}, facts[0]["row_count"])
    return tablewide.grain(df, found)


_DEPENDENT = [("event_type", "label"), ("user_id", "event_type"), ("event_type", "user_id")]
_LABELLED = "SELECT event_type, upper(event_type) AS label, user_id FROM events"


@query("dependency_strengths", f"WITH e AS ({_LABELLED}) " + " UNION ALL ".join(f"SELECT '{a}' AS determinant, '{b}' AS dependent, round(least(1.0, count(DISTINCT {a}) / count(DISTINCT ({a}, {b}))), 6) AS strength FROM e" for a, b in _DEPENDENT))
def _dependencies(spark, sf):
    df = spark.sql(_LABELLED.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))
    return tablewide.dependencies(df, _DEPENDENT, scalar.cardinalities(df))


for _n, _t, _c, _u in (("timeline_events_day", "events", "ts", "day"), ("timeline_orders_month", "orders", "o_orderdate", "month"), ("timeline_lineitem_week", "lineitem", "l_shipdate", "week")):
    query(_n, f"SELECT strftime(date_trunc('{_u}', {_c}), '%Y-%m-%d') AS bucket, count(*) AS n FROM {_t} WHERE {_c} IS NOT NULL GROUP BY 1")(lambda spark, sf, t=_t, c=_c, u=_u: tablewide.timeline(load(spark, sf, t), c, u))


@query("populated_windows", f"WITH h AS ({HOLES}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, strftime(min(ts) FILTER ({c} IS NOT NULL), '%Y-%m-%dT%H:%M:%S.%f') AS populated_from, strftime(max(ts) FILTER ({c} IS NOT NULL), '%Y-%m-%dT%H:%M:%S.%f') AS populated_to FROM h" for c in ("user_id", "event_type", "value")))
def _populated(spark, sf):
    return tablewide.populated_windows(holes(spark, sf), "ts", ["user_id", "event_type", "value"])


# --- nested -----------------------------------------------------------------


@query("array_shape", "SELECT 'embedding' AS column_name, count(embedding) AS rows, min(len(embedding))::BIGINT AS size_min, max(len(embedding))::BIGINT AS size_max, round(avg(len(embedding)), 6) AS size_avg, quantile_disc(len(embedding), 0.95)::BIGINT AS size_p95, count(*) FILTER (len(embedding) = 0) AS empties FROM embeddings")
def _array_shape(spark, sf):
    return nested.array_shape(load(spark, sf, "embeddings"), "embedding")


@query("array_elements", "WITH e AS (SELECT unnest(embedding) AS x FROM embeddings) SELECT count(*) AS occurrences, count(*) - count(x) AS null_count, round(min(x)::DOUBLE, 4) AS min_value, round(max(x)::DOUBLE, 4) AS max_value, count(*) FILTER (x < 0) AS negative_count FROM e")
def _array_elements(spark, sf):
    e = nested.array_elements(load(spark, sf, "embeddings"), "embedding")
    return e.agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("element").isNull()).alias("null_count"), F.round(F.min("element").cast("double"), 4).alias("min_value"), F.round(F.max("element").cast("double"), 4).alias("max_value"), F.count_if(F.col("element") < 0).alias("negative_count"))


@query("vector_norms", "WITH v AS (SELECT len(embedding) AS d, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings) SELECT 'embedding' AS column_name, CASE WHEN min(d) = max(d) THEN min(d) END::BIGINT AS dimension, round(min(norm) FILTER (norm > 0), 4) AS norm_min, round(max(norm) FILTER (norm > 0), 4) AS norm_max, count(*) FILTER (norm = 0) AS zero_count FROM v")
def _vector_norms(spark, sf):
    return nested.vector_norms(load(spark, sf, "embeddings"), "embedding")


@query("json_keys", "WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n, (SELECT count(DISTINCT key) FROM k) AS distinct_keys FROM k GROUP BY key")
def _json_keys(spark, sf):
    e = nested.document_entries(load(spark, sf, "events"), "props").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return e.crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("distinct_keys"))))


@query("json_value_parts", "SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 2")
def _json_values(spark, sf):
    return nested.document_entries(load(spark, sf, "events"), "props").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query("json_types", "SELECT CASE json_type(props) WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' END AS type, count(*) AS n FROM events GROUP BY 1")
def _json_types(spark, sf):
    return nested.document_types(load(spark, sf, "events"), "props")


@query("struct_parts", "SELECT 's.flag' AS path, count(*) AS occurrences, count(*) - count(nullif(l_returnflag, 'N')) AS nulls FROM lineitem WHERE l_linenumber > 1 UNION ALL SELECT 's.status', count(*), count(*) - count(l_linestatus) FROM lineitem WHERE l_linenumber > 1")
def _struct_parts(spark, sf):
    s = F.when(F.col("l_linenumber") > 1, F.struct(F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.col("l_linestatus").alias("status")))
    return nested.struct_members(load(spark, sf, "lineitem").select(s.alias("s")), "s")


@query("map_parts", "WITH m AS (SELECT concat('f', l_returnflag) AS key FROM lineitem UNION ALL SELECT concat('s', l_linestatus) FROM lineitem) SELECT key, count(*) AS n, (SELECT count(DISTINCT key) FROM m) AS distinct_keys FROM m GROUP BY key")
def _map_parts(spark, sf):
    m = F.create_map(F.concat(F.lit("f"), "l_returnflag"), F.col("l_linenumber"), F.concat(F.lit("s"), "l_linestatus"), F.col("l_linenumber"))
    return nested.map_keys(load(spark, sf, "lineitem").select(m.alias("m")), "m")


@query("map_values", "SELECT l_linenumber AS value, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _map_values(spark, sf):
    m = F.create_map(F.concat(F.lit("f"), "l_returnflag"), F.col("l_linenumber"))
    return nested.map_values(load(spark, sf, "lineitem").select(m.alias("m")), "m", "fR").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# --- shapes -----------------------------------------------------------------


@query("looks_like_url", f"SELECT coalesce({shapes.shape_sql('url')}, 'none') AS shape, count(*) AS n FROM pages GROUP BY 1")
def _looks_like_url(spark, sf):
    return load(spark, sf, "pages").groupBy(F.coalesce(shapes.shape(F.col("url"), False), F.lit("none")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


_TALLIED = (("customer", "c_name"), ("part", "p_brand"), ("pages", "url"), ("events", "props"), ("documents", "lang"), ("nation", "n_name"))


@query("looks_like_tally", " UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, coalesce({shapes.shape_sql(c)}, 'none') AS shape, count(*) AS n FROM (SELECT DISTINCT {c} FROM {t}) GROUP BY 2" for t, c in _TALLIED))
def _tally(spark, sf):
    from functools import reduce

    each = [load(spark, sf, t).select(F.col(c).alias("v")).distinct().groupBy(F.lit(f"{t}.{c}").alias("column_name"), F.coalesce(shapes.shape(F.col("v"), False), F.lit("none")).alias("shape")).agg(F.count(F.lit(1)).alias("n")) for t, c in _TALLIED]
    return reduce(DataFrame.unionByName, each)


CHECKED_VALUES = {"isbn": "978-0-306-40615-7", "ean": "4006381333931", "imei": "490154203237518", "card_number": "4111111111111111", "iban": "GB82WEST12345698765432", "vin": "1M8GDM9AXKP042788"}


@query("shape_checksums", " UNION ALL ".join(f"SELECT '{v}' AS value, '{k}' AS shape" for k, v in CHECKED_VALUES.items()))
def _checksums(spark, sf):
    return spark.createDataFrame([(v,) for v in CHECKED_VALUES.values()], "value string").select("value", shapes.shape(F.col("value")).alias("shape"))


@query("binary_kinds", " UNION ALL ".join(f"SELECT '{k}' AS kind, '{m}' AS head" for k, m in shapes.BINARY.items()))
def _binary_kinds(spark, sf):
    return spark.createDataFrame([(m,) for m in shapes.BINARY.values()], "head string").select(shapes.binary_kind(F.unhex(F.concat("head", F.lit("00000000")))).alias("kind"), "head")


@query("epoch_units", "SELECT CASE WHEN min(s) >= 1000000000 AND max(s) <= 2000000000 THEN 'seconds' END AS seconds, CASE WHEN min(s) * 1000 >= 1000000000000 AND max(s) * 1000 <= 2000000000000 THEN 'milliseconds' END AS millis FROM (SELECT epoch_us(ts) // 1000000 AS s FROM events)")
def _epoch(spark, sf):
    df = load(spark, sf, "events")
    s = F.floor(X.micros(F.col("ts"), df.schema["ts"].dataType) / 1_000_000)
    return df.agg(F.min(s).alias("a"), F.max(s).alias("b")).select(shapes.epoch_unit(F.col("a"), F.col("b")).alias("seconds"), shapes.epoch_unit(F.col("a") * 1000, F.col("b") * 1000).alias("millis"))


_NAMES = {"contactEmail": "contact", "home_address": "postal_address", "latitude": "geolocation", "DOB": "date_of_birth", "ssn": "national_id", "iban": "financial_account", "userPassword": "credential", "diagnosis": "health", "gender": "demographic", "salary": "employment", "first_name": "personal_name", "ip_address": "online_identifier", "l_quantity": None}


@query("sensitivity_columns", " UNION ALL ".join(f"SELECT '{n}' AS column_name, {'NULL' if c is None else repr(c)}::VARCHAR AS sensitivity" for n, c in _NAMES.items()))
def _sensitivity(spark, sf):
    return spark.createDataFrame([(n, sensitivity(n)) for n in _NAMES], "column_name string, sensitivity string")


# --- relationships ----------------------------------------------------------

_HASH = "('0x' || substr(md5({c}::VARCHAR), 17, 16))::UBIGINT"


def sketch_sql(table: str, c: str, k: int = sketch.K) -> str:
    return f"SELECT DISTINCT {_HASH.format(c=c)}::DECIMAL(20, 0) AS h FROM {table} WHERE {c} IS NOT NULL ORDER BY h LIMIT {k}"


query("key_sketch_orders", sketch_sql("orders", "o_orderkey"))(lambda spark, sf: sketch.key_sketch(load(spark, sf, "orders"), "o_orderkey"))


def compare_sql(child: tuple[str, str], parent: tuple[str, str], k: int) -> str:
    return f"""WITH c AS ({sketch_sql(*child, k)}), p AS ({sketch_sql(*parent, k)}),
t AS (SELECT (SELECT CASE WHEN count(*) >= {k} THEN max(h) ELSE 18446744073709551616::DECIMAL(20, 0) END FROM c) AS tc, (SELECT CASE WHEN count(*) >= {k} THEN max(h) ELSE 18446744073709551616::DECIMAL(20, 0) END FROM p) AS tp)
SELECT count(*) FILTER (c.h < least(tc, tp) AND p.h IS NOT NULL) AS common, count(*) FILTER (c.h < tp) AS answerable,
round(count(*) FILTER (c.h < least(tc, tp) AND p.h IS NOT NULL) * 18446744073709551616::DOUBLE / max(least(tc, tp))::DOUBLE, 2) AS estimate,
round(count(*) FILTER (c.h < tp AND p.h IS NOT NULL) / count(*) FILTER (c.h < tp), 6) AS containment FROM c LEFT JOIN p ON c.h = p.h CROSS JOIN t"""


for _n, _a, _b in (("sketch_intersection", ("lineitem", "l_orderkey"), ("orders", "o_orderkey")), ("sketch_containment", ("orders", "o_custkey"), ("customer", "c_custkey"))):
    query(_n, compare_sql(_a, _b, sketch.K))(lambda spark, sf, a=_a, b=_b: sketch.compare(sketch.key_sketch(load(spark, sf, a[0]), a[1]), sketch.key_sketch(load(spark, sf, b[0]), b[1])))


_KEYED = {"l_order_id": ("lineitem", "l_orderkey"), "o_customer_id": ("orders", "o_custkey"), "e_user_id": ("events", "user_id"), "l_line_id": ("lineitem", "l_linenumber")}
_PARENTS = {"orders.o_orderkey": ("orders", "o_orderkey"), "customer.c_custkey": ("customer", "c_custkey"), "supplier.s_suppkey": ("supplier", "s_suppkey")}


def _value_edge_sql(child: str, parent: str) -> str:
    (ct, cc), (pt, pc) = _KEYED[child], _PARENTS[parent]
    n, m = f"(SELECT count(DISTINCT {cc}) FROM {ct})", f"(SELECT count(DISTINCT {pc}) FROM {pt})"
    return f"SELECT '{child}' AS child, '{parent}' AS parent FROM ({compare_sql(_KEYED[child], _PARENTS[parent], sketch.K)}) WHERE {n} > 50 AND {n} < {m} AND CASE WHEN {n} < {sketch.K} AND {m} < {sketch.K} THEN containment = 1 ELSE answerable >= 400 AND containment >= 0.95 END"


@query("value_derived_edges", " UNION ALL ".join(_value_edge_sql(c, p) for c in _KEYED for p in _PARENTS))
def _value_edges(spark, sf):
    """Columns under names as keys have, against three keys, by their sketches."""

    def side(table, column, name):
        df = load(spark, sf, table)
        low, high, card = df.agg(F.min(column), F.max(column), F.count_distinct(column)).first()
        hashes = sorted(int(r[0]) for r in sketch.key_sketch(df, column).collect())  # k numbers at most
        return {"name": name, "kind": "integer", "cardinality": card, "hashes": hashes, "exhaustive": len(hashes) < sketch.K, "dense": high - low + 1 == card}

    found = edges.by_value([side(*at, n) for n, at in _KEYED.items()], [side(*at, n) for n, at in _PARENTS.items()])
    return spark.createDataFrame(found, "child string, parent string")


@query("naming_edges", "SELECT 'sale' AS source, 'customer_id' AS source_column, 'customers' AS target, 'id' AS target_column UNION ALL SELECT 'sale', 'category_id', 'categories', 'id'")
def _naming(spark, sf):
    t = [edges.Table("customers", {"id": "bigint", "name": "string"}, ("id",)), edges.Table("categories", {"id": "int"}, ("id",)), edges.Table("sale", {"id": "bigint", "customer_id": "int", "category_id": "bigint", "vendor_id": "int"}, ("id",))]
    return spark.createDataFrame(edges.by_name(t), "source string, source_column string, target string, target_column string")


def observed_sql(child: str, fk: str, parent: str, key: str) -> str:
    return f"""WITH e AS (SELECT {fk} AS k, count(*) AS n FROM {child} GROUP BY 1), p AS (SELECT DISTINCT {key} AS k FROM {parent} WHERE {key} IS NOT NULL)
SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (e.k IS NULL), 0)::BIGINT AS nulls, count(e.k) AS distinct_fk, round(greatest(sum(n) - coalesce(sum(n) FILTER (e.k IS NULL), 0), count(e.k)) / count(e.k), 6) AS fanout_avg,
max(n) FILTER (e.k IS NOT NULL) AS fanout_max, count(p.k) AS contained, round(count(p.k) / count(e.k), 6) AS containment, round(count(p.k) / (SELECT count(*) FROM p), 6) AS target_coverage FROM e LEFT JOIN p ON e.k = p.k"""


_EDGES = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("nation", "n_regionkey", "region", "r_regionkey"))
for _e in _EDGES:
    query(f"edge_{_e[0]}_{_e[2]}", observed_sql(*_e))(lambda spark, sf, e=_e: edges.observed(load(spark, sf, e[0]), e[1], load(spark, sf, e[2]), e[3]))


def edge_table(spark) -> DataFrame:
    return spark.createDataFrame([*_EDGES, ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey")], "source string, source_column string, target string, target_column string")


_EDGE_SQL = " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS source_column, '{c}' AS target, '{d}' AS target_column" for a, b, c, d in [*_EDGES, ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey")])


@query("referenced_by", f"WITH e AS ({_EDGE_SQL}) SELECT target, target_column, string_agg(source || '.' || source_column, ',' ORDER BY source, source_column) AS sources, count(*) AS n_sources FROM e GROUP BY 1, 2")
def _referenced(spark, sf):
    return edges.referenced_by(edge_table(spark))


@query("human_edges", f"WITH e AS ({_EDGE_SQL}) SELECT * FROM e WHERE source <> 'supplier' UNION ALL SELECT 'events', 'user_id', 'customer', 'c_custkey'")
def _human(spark, sf):
    e = edge_table(spark)
    return edges.with_human(e, spark.createDataFrame([("events", "user_id", "customer", "c_custkey")], e.schema), e.where("source = 'supplier'"))


@query("dense_sequences", " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::BIGINT AS min_value, max({c})::BIGINT AS max_value, count(DISTINCT {c}) AS cardinality, max({c}) - min({c}) + 1 = count(DISTINCT {c}) AS dense FROM lineitem" for c in ("l_orderkey", "l_linenumber", "l_suppkey")))
def _dense(spark, sf):
    return edges.dense_sequences(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey"])


# --- the whole profile -------------------------------------------------------


def _profile_sql(table: str) -> str:
    """Every long row of one table's profile, from SQL alone."""
    cols = columns_of(table)
    a, cte = phase_a_sql(table), "pa_" + table
    stats = ("null_count", "null_rate", "cardinality", "cardinality_ratio", "zero_count", "negative_count", "quantized_count", "non_finite_count", "empty_count", "length_min", "length_max", "length_avg", "length_p95")
    row = lambda col, stat, number, text, src: f"SELECT '{table}' AS table_name, {col} AS column_name, {stat} AS stat, ({number})::DOUBLE AS number, ({text})::VARCHAR AS text FROM {src}"
    out = [row("column_name", f"'{s}'", s, "NULL", f"(SELECT * FROM {cte} WHERE {s} IS NOT NULL)") for s in stats]
    out += [row("column_name", "'candidate_key'", "NULL", "candidate_key", cte), row("column_name", "'classification'", "NULL", "classification", cte), row("NULL", "'row_count'", "count(*)", "NULL", table)]
    out.append(row("NULL", f"'null_patterns[{'0' * len(cols)}]'", "count(*)", "NULL", table))
    is_class = lambda c, k: f"(SELECT classification FROM {cte} WHERE column_name = '{c}') {k}"
    for c, k in cols:
        src = f"{table} HAVING {is_class(c, '= ' + repr({'n': 'numeric', 'f': 'numeric', 't': 'temporal', 's': 'text'}[k]))}"
        if k in "nf":
            out += [row(f"'{c}'", f"'{s}'", v, "NULL", src) for s, v in (("range.min", f"round(min({c})::DOUBLE, 6)"), ("range.max", f"round(max({c})::DOUBLE, 6)"), ("mean", f"round(avg({c}), 6)"), *((f"percentiles.p{p:02d}", f"round(quantile_cont({c}, {p / 100}), 6)") for p in (1, 25, 50, 75, 99)))]
        if k == "t":
            shown = lambda e: f"strftime({e}, '%Y-%m-%dT%H:%M:%S.%f')"
            age = f"greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max({c}))) // 86400000000)"
            out += [row(f"'{c}'", f"'{s}'", "NULL", v, src) for s, v in (("range.min", shown(f"min({c})")), ("range.max", shown(f"max({c})")), ("freshness", f"CASE WHEN {age} < 7 THEN 'live' WHEN {age} < 90 THEN 'stale' ELSE 'dormant' END"), *((f"percentiles.p{p:02d}", shown(f"quantile_disc({c}, {p / 100})")) for p in (1, 25, 50, 75, 99)))]
            out += [row(f"'{c}'", "'span_days'", f"(epoch_us(max({c})) - epoch_us(min({c}))) // 86400000000", "NULL", src), row(f"'{c}'", "'max_age_days'", age, "NULL", src)]
    listed = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL AND {is_class(c, "IN ('categorical', 'text')")} GROUP BY {c}" for c, _ in cols)
    out.append(row("column_name", "'values[' || rank || ']'", "n", "value", f"({list_sql(listed)})"))
    shape = distribution_sql_of(listed)
    out += [row("column_name", "'distribution'", "NULL", "distribution", f"({shape})"), row("column_name", "'values_coverage'", "values_coverage", "NULL", f"({shape})")]
    card = lambda c: f"(SELECT cardinality FROM {cte} WHERE column_name = '{c}')"
    key = lambda c: f"(SELECT candidate_key FROM {cte} WHERE column_name = '{c}')"
    grain = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, {card(x)} * {card(y)} AS product, count(DISTINCT ({x}, {y})) AS pairs, count(*) AS rows FROM {table} HAVING {card(x)} < count(*) AND {card(y)} < count(*) AND {card(x)} * {card(y)} >= count(*)" for (x, _), (y, _) in combinations(cols, 2))
    out.append(row("NULL", "'grain[' || a || ',' || b || ']'", "pairs", "NULL", f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY product DESC, a, b) AS place FROM ({grain})) WHERE place <= {tablewide.GRAIN_PAIRS} AND pairs = rows AND NOT EXISTS (SELECT 1 FROM {cte} WHERE candidate_key))"))
    few = lambda c: is_class(c, "= 'categorical'")
    for x, y in permutations([c for c, _ in cols], 2):
        close = "true" if tablewide.adjacent(x, y) else f"({few(x)} AND {few(y)})"
        strength = f"round(least(1.0, {card(x)} / count(DISTINCT ({x}, {y}))), 6)"
        out.append(row("NULL", f"'dependencies[{x}->{y}]'", strength, "NULL", f"{table} HAVING {close} AND {card(x)} >= {card(y)} AND {card(y)} > 1 AND NOT {key(x)} AND {strength} >= {tablewide.STRONG}"))
    for c, k in cols:
        if k == "t":  # one such column a table here
            span = f"(SELECT (epoch_us(max({c})) - epoch_us(min({c}))) // 86400000000 FROM {table})"
            for unit, fits in (("day", f"{span} <= 90"), ("week", f"{span} > 90 AND {span} <= 730"), ("month", f"{span} > 730")):
                out.append(row("NULL", "'timeline[' || b || ']'", "n", "NULL", f"(SELECT strftime(date_trunc('{unit}', {c}), '%Y-%m-%d') AS b, count(*) AS n FROM {table} WHERE {fits} GROUP BY 1)"))
                out.append(row("NULL", "'timeline'", "NULL", f"'{c} by {unit}'", f"(SELECT 1 WHERE {fits})"))
    return f"SELECT * FROM (WITH {cte} AS MATERIALIZED ({a}) " + "\nUNION ALL ".join(out) + ")"


@query("profile_full", "\nUNION ALL ".join(map(_profile_sql, SCHEMAS)))
def _profile_full(spark, sf):
    """Every table without nested columns; types, sums of doubles and spellings, which the engines say differently, are left out."""
    found = full(spark, [Source(t, load(spark, sf, t)) for t in SCHEMAS], profiled_at=NOW, infer=False)
    return found.where("stat NOT IN ('sql_type', 'nullable', 'sum', 'spelling_groups')")


@query("profile_nested", "SELECT 'embedding' AS column_name, stat, number FROM (SELECT min(len(embedding)) AS size_min, max(len(embedding)) AS size_max, avg(len(embedding)) AS size_avg, quantile_disc(len(embedding), 0.95) AS size_p95, count(*) FILTER (len(embedding) = 0) AS empties FROM embeddings) UNPIVOT (number FOR stat IN (size_min, size_max, size_avg, size_p95, empties))" + " UNION ALL SELECT 'embedding[*]', 'row_count', sum(len(embedding)) FROM embeddings UNION ALL SELECT 'embedding[*]', 'cardinality', count(DISTINCT x) FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def _profile_nested(spark, sf):
    found = full(spark, [Source("embeddings", load(spark, sf, "embeddings"))], infer=False)
    wanted = "column_name = 'embedding' AND (stat LIKE 'size%' OR stat = 'empties') OR column_name = 'embedding[*]' AND stat IN ('row_count', 'cardinality')"
    return found.where(wanted).select("column_name", "stat", "number")


# --- drift, assertions, redaction, lookup -----------------------------------

_STATS = ("row_count", "null_count", "cardinality", "classification")


def _long_sql(source: str, drop: str | None = None) -> str:
    wide = "\nUNION ALL ".join(s for s in phase_a_sql("orders", source).split("\nUNION ALL ") if not drop or f"'{drop}' AS column_name" not in s)
    return " UNION ALL ".join(f"SELECT table_name, column_name, '{s}' AS stat, {s}::VARCHAR AS value FROM ({wide}) WHERE {s} IS NOT NULL" for s in _STATS)


_DRIFT_SQL = f"""WITH b AS ({_long_sql("(SELECT * FROM orders WHERE o_orderkey % 2 = 0)", "o_orderstatus")}), a AS ({_long_sql("orders", "o_orderpriority")}),
x AS (SELECT 'orders' AS table_name, 'o_orderstatus' AS column_name, 'column_added' AS kind, NULL::VARCHAR AS stat, NULL::VARCHAR AS before, NULL::VARCHAR AS after, NULL::DOUBLE AS delta, NULL::DOUBLE AS delta_pct
UNION ALL SELECT 'orders', 'o_orderpriority', 'column_removed', NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT b.table_name, b.column_name, CASE b.stat WHEN 'row_count' THEN 'table_row_count_changed' ELSE 'statistic_changed' END, b.stat, b.value, a.value,
 round(try_cast(a.value AS DOUBLE) - try_cast(b.value AS DOUBLE), 6), CASE WHEN try_cast(b.value AS DOUBLE) <> 0 THEN round((try_cast(a.value AS DOUBLE) - try_cast(b.value AS DOUBLE)) / abs(try_cast(b.value AS DOUBLE)), 6) END
 FROM b JOIN a USING (table_name, column_name, stat) WHERE b.value <> a.value)
SELECT *, CASE WHEN kind IN ('statistic_changed', 'table_row_count_changed') THEN 'data' ELSE 'shape' END AS family FROM x"""


def _drifted(spark, sf) -> DataFrame:
    df = load(spark, sf, "orders")
    before = drift.long_profile(scalar.phase_a(df.where("o_orderkey % 2 = 0").drop("o_orderstatus"), "orders"), list(_STATS))
    after = drift.long_profile(scalar.phase_a(df.drop("o_orderpriority"), "orders"), list(_STATS))
    return drift.events(before, after)


query("drift_events", _DRIFT_SQL)(_drifted)
query("drift_summary", f"SELECT kind, family, count(*) AS n FROM ({_DRIFT_SQL}) GROUP BY 1, 2")(lambda spark, sf: drift.summary(_drifted(spark, sf)))


@query("drift_relationships", "SELECT 'events' AS source, 'user_id' AS source_column, 'customer' AS target, 'c_custkey' AS target_column, 'relationship_added' AS kind UNION ALL SELECT 'nation', 'n_regionkey', 'region', 'r_regionkey', 'relationship_removed' UNION ALL SELECT 'orders', 'o_custkey', 'customer', 'c_custkey', 'relationship_modified'")
def _drift_relationships(spark, sf):
    before = edge_table(spark).withColumn("detection", F.lit("declared"))
    after = before.where("source <> 'nation'").withColumn("detection", F.when(F.col("source") == "orders", "measured").otherwise(F.col("detection")))
    more = spark.createDataFrame([("events", "user_id", "customer", "c_custkey", "inferred")], after.schema)
    return drift.relationships(before, after.unionByName(more))


_BOUNDS = [("orders", "o_orderkey", "null_count", 0.0, 0.0), ("orders", "o_orderstatus", "cardinality", 1.0, 2.0), ("orders", "o_custkey", "cardinality", 10.0, None)]
_BOUNDS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{s}' AS stat, {a}::DOUBLE AS min_value, {'NULL' if b is None else b}::DOUBLE AS max_value" for t, c, s, a, b in _BOUNDS)


@query("assertion_predicates", f"WITH p AS ({_long_sql('orders')}), b AS ({_BOUNDS_SQL}) SELECT table_name, column_name, stat, round(try_cast(value AS DOUBLE), 6) AS value, min_value, max_value, coalesce((min_value IS NULL OR try_cast(value AS DOUBLE) >= min_value) AND (max_value IS NULL OR try_cast(value AS DOUBLE) <= max_value), false) AS passed FROM p JOIN b USING (table_name, column_name, stat)")
def _predicates(spark, sf):
    found = drift.long_profile(scalar.phase_a(load(spark, sf, "orders"), "orders"), list(_STATS))
    return assertions.check_ranges(found, spark.createDataFrame(_BOUNDS, "table_name string, column_name string, stat string, min_value double, max_value double"))


def _issues(spark, found) -> DataFrame:
    return spark.createDataFrame([(i.code, i.path) for i in found], "code string, path string")


@query("sql_assertions", "SELECT 'assertion_failed' AS code, 'has_rows' AS path UNION ALL SELECT 'assertion_failed', 'not_zero' UNION ALL SELECT 'type_error', 'text'")
def _sql_assertions(spark, sf):
    load(spark, sf, "region").createOrReplaceTempView("asserted_region")
    return _issues(spark, [*assertions.sql_zero(spark, "SELECT count(*) - 5 FROM asserted_region", "zero"), *assertions.sql_zero(spark, "SELECT count(*) FROM asserted_region", "not_zero"), *assertions.sql_zero(spark, "SELECT 'x'", "text"), *assertions.sql_empty(spark, "SELECT * FROM asserted_region WHERE r_regionkey < 0", "empty"), *assertions.sql_empty(spark, "SELECT * FROM asserted_region", "has_rows")])


_NATIONS = "SELECT n_nationkey, n_name FROM nation"
query("redact_mask", f"SELECT n_nationkey, '[redacted]' AS n_name FROM ({_NATIONS})")(lambda spark, sf: redact.redact(load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", "mask"))
query("redact_drop", "SELECT n_nationkey FROM nation")(lambda spark, sf: redact.redact(load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", "drop"))
query("redact_hash", f"SELECT n_nationkey, substr(sha256('pepper' || chr(31) || n_name), 1, 16) AS n_name FROM ({_NATIONS})")(lambda spark, sf: redact.redact(load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", "hash", "pepper"))
query("coarsened_ages", "SELECT n_nationkey, (n_nationkey * 31 // 90 * 90)::BIGINT AS days FROM nation")(lambda spark, sf: load(spark, sf, "nation").select("n_nationkey", redact.coarsened(F.col("n_nationkey") * 31).alias("days")))


def _tri(e: str) -> str:
    p = f"concat('  ', lower(trim({e})), '  ')"
    return f"list_distinct(list_transform(range(1, length({p}) - 1), lambda i: substr({p}, i, 3)))"


_ASKED = "AUTOMOBIL"


@query("resolve_value", f"WITH v AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT value, n, round(len(list_intersect({_tri('value')}, {_tri(repr(_ASKED))})) / len(list_distinct(list_concat({_tri('value')}, {_tri(repr(_ASKED))}))), 6) AS score FROM v) SELECT value, n, 'nearest' AS match, score FROM s WHERE score >= 0.3 ORDER BY score DESC, value LIMIT 5")
def _resolve(spark, sf):
    return resolve.resolve_value(values.frequencies(load(spark, sf, "customer"), ["c_mktsegment"]), _ASKED)


@query("search_columns", f"SELECT table_name, column_name FROM ({phase_a_sql('orders')}) WHERE classification = 'categorical' AND regexp_matches(lower(column_name), 'order')")
def _search(spark, sf):
    return resolve.search_columns(scalar.phase_a(load(spark, sf, "orders"), "orders"), "order", classification="categorical").select("table_name", "column_name")


def _small_profile(spark, sf) -> DataFrame:
    return full(spark, [Source(t, load(spark, sf, t)) for t in ("nation", "region", "supplier")], profiled_at=NOW, infer=False)


@query("validate_profile", "SELECT 'x' AS table_name, 'x' AS column_name, 'x' AS code WHERE false")
def _validate(spark, sf):
    return context.validate(scalar.phase_a(load(spark, sf, "orders"), "orders")).unionByName(context.audit(_small_profile(spark, sf)))


@query("audit_planted", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{code}' AS code FROM {t} HAVING count(*) > 0" for t, cols in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("region", ("r_regionkey", "r_name"))) for c in cols for code in ("null_count_exceeds_rows", "null_rate_disagrees", "null_rate_of_none")) + " UNION ALL SELECT 'nation', 'n_name', 'length_min_negative' UNION ALL SELECT 'region', 'r_name', 'length_min_negative'")
def _audit_planted(spark, sf):
    """Null counts beyond the rows, and lengths below zero, planted in a profile of two tables."""
    found = full(spark, [Source(t, load(spark, sf, t)) for t in ("nation", "region")], profiled_at=NOW, infer=False)
    wrong = F.when(F.col("stat") == "null_count", 1e6).when(F.col("stat") == "length_min", -1.0).otherwise(F.col("number"))
    codes = ("null_count_exceeds_rows", "null_rate_disagrees", "null_rate_of_none", "length_min_negative")
    return context.audit(found.withColumn("number", wrong)).where(F.col("code").isin(*codes))


_HALF = "(SELECT * FROM orders WHERE o_orderkey % 2 = 0)"
_KEPT = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("drift_profiles", f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM {_HALF})::DOUBLE AS x, count(DISTINCT {c})::DOUBLE AS y FROM orders" for c in _KEPT)})
SELECT 'orders' AS table_name, 'o_orderstatus' AS column_name, 'column_added' AS kind, NULL::VARCHAR AS stat, NULL::DOUBLE AS delta, 'shape' AS family
UNION ALL SELECT 'orders', 'o_custkey', 'column_type_changed', 'sql_type', NULL, 'shape'
UNION ALL SELECT 'orders', NULL, 'table_row_count_changed', 'row_count', (count(*) - (SELECT count(*) FROM {_HALF}))::DOUBLE, 'data' FROM orders
UNION ALL SELECT 'orders', column_name, 'statistic_changed', 'cardinality', y - x, 'data' FROM c WHERE x <> y""")
def _drift_profiles(spark, sf):
    """A column more, a type changed, twice the rows: between two whole profiles."""
    df = load(spark, sf, "orders")
    before = full(spark, [Source("orders", df.where("o_orderkey % 2 = 0").drop("o_orderstatus"))], profiled_at=NOW, infer=False)
    after = full(spark, [Source("orders", df.withColumn("o_custkey", F.col("o_custkey").cast("int")))], profiled_at=NOW, infer=False)
    return drift.compare(before, after).where("stat IS NULL OR stat IN ('sql_type', 'row_count', 'cardinality')").select("table_name", "column_name", "kind", "stat", "delta", "family")


@query("scoped_profile", "SELECT 'row_count' AS stat, count(*)::DOUBLE AS number FROM orders UNION ALL SELECT 'rows_scanned', count(*) FILTER (o_orderstatus = 'F')::DOUBLE FROM orders")
def _scoped_profile(spark, sf):
    """Of a table read in part: its whole row count, the rows read, and no fact of the whole table."""
    found = full(spark, [Source("orders", load(spark, sf, "orders"))], [settings.Rule(("orders",), {"mode": "filter", "condition": "o_orderstatus = 'F'"})], profiled_at=NOW, infer=False)
    return found.where("column_name IS NULL AND stat NOT LIKE 'null_patterns%' AND stat <> 'scope'").select("stat", "number")


@query("column_lineage", "SELECT * FROM (VALUES ('name', 'customer', 'c_name'), ('spent', 'orders', 'o_totalprice'), ('spent', 'customer', 'c_acctbal')) AS v(column_name, source, source_column)")
def _lineage(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    joined = spark.sql("SELECT c_name AS name, sum(o_totalprice) - max(c_acctbal) AS spent FROM {c} JOIN {o} ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_name", c=c, o=o)
    return tables.lineage(joined)


@query("open_questions", f"SELECT table_name, column_name, CASE WHEN classification = 'categorical' AND length_max <= 3 THEN 'codes' WHEN candidate_key THEN 'description' END AS question FROM ({phase_a_sql('lineitem')}) WHERE classification = 'categorical' AND length_max <= 3 OR candidate_key")
def _questions(spark, sf):
    return context.open_questions(scalar.phase_a(load(spark, sf, "lineitem"), "lineitem"))


@query("token_budget", "SELECT 'a' AS section UNION ALL SELECT 'pinned' UNION ALL SELECT 'c'")
def _budget(spark, sf):
    kept, _ = context.select([context.Section("a", "x" * 40, 0), context.Section("b", "x" * 400, 1), context.Section("pinned", "x" * 40, 9, True), context.Section("c", "x" * 40, 2)], 30)
    return spark.createDataFrame([(s.name,) for s in kept], "section string")


# --- sources and scope ------------------------------------------------------

query("list_tables", "SELECT unnest(['customer', 'nation', 'orders', 'part', 'region', 'supplier', 'lineitem']) AS table_name")(lambda spark, sf: spark.createDataFrame([(n,) for n in tables.list_tables(spark, sf, ["*"], ["documents", "e*", "pages", "benchmark", "labels", "conv*"])], "table_name string"))
query("column_catalog", " UNION ALL ".join(f"SELECT 'customer' AS table_name, {i}::BIGINT AS ordinal, '{c}' AS column_name" for i, (c, _) in enumerate(columns_of("customer"), 1)))(lambda spark, sf: tables.columns(load(spark, sf, "customer"), "customer").select("table_name", "ordinal", "column_name"))
query("filter_scope", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' GROUP BY 1")(lambda spark, sf: tables.scoped(load(spark, sf, "orders"), "orders", condition="o_totalprice > 100000 AND o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))


_RULES = [settings.Rule(("*",), {"top_n_values": 10}), settings.Rule(("line*",), {"mode": "sample", "sample": 0.1}, min_rows=1000), settings.Rule(("orders",), {"max_age_days": 1})]


@query("settings_explain", " UNION ALL ".join(f"SELECT '{k}' AS setting, '{v}' AS value, '{o}' AS origin" for k, v, o in (("mode", "sample", "line*"), ("sample", "0.1", "line*"), ("condition", "None", "default"), ("max_rows", "None", "default"), ("enumeration_threshold", "50", "default"), ("top_n_values", "10", "*"), ("top_n_null_patterns", "20", "default"), ("looks_like_sample_size", "1000", "default"), ("percentiles", "(1, 25, 50, 75, 99)", "default"), ("max_parts", "20", "default"), ("max_part_depth", "3", "default"), ("max_age_days", "7", "default"))))
def _explain(spark, sf):
    found = settings.explain("lineitem", _RULES, load(spark, sf, "lineitem").count())
    return spark.createDataFrame([(k, str(v), o) for k, v, o in found], "setting string, value string, origin string")


@query("sample_scope_coherent", "SELECT count(*) AS whole, true AS a_tenth, true AS same FROM orders")
def _sample(spark, sf):
    """A tenth of the rows, and the same ones however the table is cut."""
    df = load(spark, sf, "orders")
    once = tables.scoped(df, "orders", sample=0.1)
    again = tables.scoped(df.repartition(7), "orders", sample=0.1)
    share = once.agg(F.count(F.lit(1)).alias("n")).crossJoin(once.exceptAll(again).agg(F.count(F.lit(1)).alias("differ"))).crossJoin(df.agg(F.count(F.lit(1)).alias("whole")))
    return share.select("whole", (F.abs(F.col("n") / F.col("whole") - 0.1) < 0.03).alias("a_tenth"), (F.col("differ") == 0).alias("same"))


query("execute_sql", "SELECT 'a;b' AS x")(lambda spark, sf: tables.execute(spark, "SELECT 1 AS x; -- a; b\nSELECT 'a;b' AS x /* ; */;"))
