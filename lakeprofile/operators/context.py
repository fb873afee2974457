"""A profile as text within a token budget, questions it leaves open, its freshness and its validity."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


@dataclass(frozen=True)
class Section:
    name: str
    text: str
    priority: int = 0
    pinned: bool = False


def select(sections: list[Section], budget: int) -> tuple[list[Section], list[str]]:
    """The sections that fit, in their order, and the names of the others: pinned ones first, then by priority, skipping what is too big."""
    left, kept = budget, set()
    for s in sorted(sections, key=lambda s: (not s.pinned, s.priority)):
        if s.pinned or tokens_of(s.text) <= left:
            kept.add(s.name)
            left -= tokens_of(s.text)
    return [s for s in sections if s.name in kept], [s.name for s in sections if s.name not in kept]


def render(profile: DataFrame, table: str, budget: int = 4000) -> str:
    """One table of a profile as Markdown within ``budget`` tokens."""
    rows = profile.where(F.col("table_name") == table).collect()
    head = Section("header", f"# {table}\n{rows[0]['row_count'] if rows else 0} rows, {len(rows)} columns", pinned=True)
    lines = [Section(r["column_name"], f"- {r['column_name']}: {r['classification']}, {r['cardinality']} distinct, {r['null_rate']} null", i) for i, r in enumerate(rows)]
    kept, dropped = select([head, *lines], budget)
    return "\n".join(s.text for s in kept) + (f"\n({len(dropped)} sections left out)" if dropped else "")


def open_questions(profile: DataFrame) -> DataFrame:
    """(table_name, column_name, question): what the numbers leave to ask."""
    code = (F.col("classification") == "categorical") & (F.col("length_max") <= 3)
    return profile.select("table_name", "column_name", F.when(code, "codes").when(F.col("candidate_key"), "description").alias("question")).where("question IS NOT NULL")


def is_stale(profiled_at: str, now: str, max_age_days: int = 7) -> bool:
    """Whether a profile is at least ``max_age_days`` old."""
    return (datetime.fromisoformat(now) - datetime.fromisoformat(profiled_at)).total_seconds() >= 86_400 * max_age_days


#: (code, condition that must hold) of a wide profile's rows.
INVARIANTS = {
    "null_count_range": "null_count BETWEEN 0 AND row_count",
    "cardinality_range": "cardinality IS NULL OR cardinality <= row_count - null_count",
    "zero_count_range": "zero_count IS NULL OR zero_count <= row_count - null_count",
    "empty_count_range": "empty_count IS NULL OR empty_count <= row_count - null_count",
    "null_rate_value": "row_count = 0 OR abs(null_rate - null_count / row_count) <= 1e-6",
    "ratio_value": "cardinality IS NULL OR row_count = 0 OR abs(cardinality_ratio - cardinality / row_count) <= 1e-6",
    "length_order": "length_min IS NULL OR length_min <= length_avg AND length_avg <= length_max",
    "class_of_few": "classification <> 'categorical' OR cardinality IS NOT NULL",
    "key_ratio": "NOT candidate_key OR cardinality_ratio >= 0.9999",
}


def validate(profile: DataFrame) -> DataFrame:
    """(table_name, column_name, code): every invariant that a row of a wide profile breaks."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(cond), F.lit(True)), F.lit(code)) for code, cond in INVARIANTS.items()]), lambda x: x.isNotNull())
    return profile.select("table_name", "column_name", F.explode(broken).alias("code"))


_COUNTS = ("null_count", "zero_count", "negative_count", "quantized_count", "non_finite_count", "empty_count")
_CLASSES = "('categorical', 'boolean', 'text', 'numeric', 'temporal', 'binary', 'json', 'composite', 'vector', 'spatial', 'foreign_key_candidate', 'unsupported')"
#: (code, condition) of a column's statistics: n[...] are its numbers, t[...] its texts, rows and scanned those of its table.
COLUMN_RULES = {
    **{f"{s}_negative": f"n['{s}'] IS NULL OR n['{s}'] >= 0" for s in (*_COUNTS, "cardinality", "length_min", "size_min")},
    **{f"{s}_exceeds_rows": f"n['{s}'] IS NULL OR rows IS NULL OR n['{s}'] <= rows" for s in ("null_count", "cardinality")},
    **{f"{s}_exceeds_values": f"n['{s}'] IS NULL OR rows IS NULL OR n['{s}'] <= rows - coalesce(n['null_count'], 0)" for s in _COUNTS[1:]},
    **{f"{s}_is_no_count": f"n['{s}'] IS NULL OR n['{s}'] = floor(n['{s}'])" for s in (*_COUNTS, "cardinality", "length_min", "length_max")},
    **{f"{s}_outside_unit": f"n['{s}'] IS NULL OR n['{s}'] BETWEEN 0 AND 1" for s in ("null_rate", "cardinality_ratio", "values_coverage")},
    "null_rate_disagrees": "n['null_rate'] IS NULL OR coalesce(rows, 0) = 0 OR abs(n['null_rate'] - n['null_count'] / rows) <= 1e-6",
    "ratio_disagrees": "n['cardinality_ratio'] IS NULL OR coalesce(rows, 0) = 0 OR abs(n['cardinality_ratio'] - n['cardinality'] / rows) <= 1e-6",
    "null_rate_of_all": "n['null_rate'] IS NULL OR (n['null_rate'] = 1) = (rows > 0 AND n['null_count'] = rows)",
    "null_rate_of_none": "n['null_rate'] IS NULL OR (n['null_rate'] = 0) = (n['null_count'] = 0)",
    "values_without_rows": "coalesce(rows, 1) > 0 OR coalesce(n['cardinality'], 0) = 0",
    "cardinality_without_values": "n['cardinality'] IS NULL OR rows IS NULL OR n['cardinality'] > 0 OR n['null_count'] = rows",
    "class_unknown": f"t['classification'] IS NULL OR t['classification'] IN {_CLASSES}",
    "class_missing": "t['classification'] IS NOT NULL OR n['null_count'] IS NULL",
    "key_ratio": "coalesce(t['candidate_key'], 'false') = 'false' OR n['cardinality_ratio'] >= 0.9999",
    "key_word": "t['candidate_key'] IS NULL OR t['candidate_key'] IN ('true', 'false')",
    "length_order": "n['length_min'] IS NULL OR n['length_min'] <= n['length_avg'] AND n['length_avg'] <= n['length_max']",
    "length_p95_outside": "n['length_p95'] IS NULL OR n['length_p95'] BETWEEN n['length_min'] AND n['length_max']",
    "length_of_empty": "n['empty_count'] IS NULL OR n['length_min'] IS NULL OR (n['empty_count'] > 0) = (n['length_min'] = 0)",
    "zero_and_negative": "n['zero_count'] IS NULL OR rows IS NULL OR n['zero_count'] + n['negative_count'] <= rows - n['null_count']",
    "range_order": "n['range.min'] IS NULL OR n['range.min'] <= n['range.max']",
    "range_order_of_times": "t['range.min'] IS NULL OR t['range.min'] <= t['range.max']",
    "range_half": "(n['range.min'] IS NULL) = (n['range.max'] IS NULL)",
    "mean_outside_range": "n['mean'] IS NULL OR n['range.min'] IS NULL OR n['mean'] BETWEEN n['range.min'] - 1e-6 AND n['range.max'] + 1e-6",
    "negative_without_range": "n['negative_count'] IS NULL OR n['range.min'] IS NULL OR (n['negative_count'] > 0) = (n['range.min'] < 0)",
    **{f"percentile_order_{a}_{b}": f"n['percentiles.p{a}'] IS NULL OR n['percentiles.p{b}'] IS NULL OR n['percentiles.p{a}'] <= n['percentiles.p{b}']" for a, b in (("01", "25"), ("25", "50"), ("50", "75"), ("75", "99"))},
    "percentile_below_range": "n['percentiles.p01'] IS NULL OR n['percentiles.p01'] >= n['range.min'] - 1e-6",
    "percentile_above_range": "n['percentiles.p99'] IS NULL OR n['percentiles.p99'] <= n['range.max'] + 1e-6",
    "total_and_unmeasured": "t['unmeasured'] IS NULL OR (n['sum'] IS NULL) = contains(t['unmeasured'], 'sum')",
    "freshness_word": "t['freshness'] IS NULL OR t['freshness'] IN ('live', 'stale', 'dormant')",
    "freshness_age": "t['freshness'] IS NULL OR n['max_age_days'] IS NULL OR t['freshness'] = CASE WHEN n['max_age_days'] < 7 THEN 'live' WHEN n['max_age_days'] < 90 THEN 'stale' ELSE 'dormant' END",
    "span_negative": "n['span_days'] IS NULL OR n['span_days'] >= 0",
    "distribution_word": "t['distribution'] IS NULL OR t['distribution'] IN ('dominant_value', 'long_tail', 'imbalanced', 'uniform')",
    "list_order": "n['values[2]'] IS NULL OR n['values[1]'] >= n['values[2]']",
    "list_exceeds_values": "n['values[1]'] IS NULL OR rows IS NULL OR n['values[1]'] <= rows - n['null_count']",
    "whole_list_coverage": "n['values_coverage'] IS NULL OR n['values_coverage'] < 1 OR n['cardinality'] IS NULL OR n['cardinality'] <= listed",
    "class_of_many": "t['classification'] IS NULL OR t['classification'] <> 'categorical' OR n['cardinality'] IS NOT NULL",
    "redacted_word": "t['redacted'] IS NULL OR t['redacted'] IN ('mask', 'hash', 'drop')",
    "redacted_range": "t['redacted'] IS NULL OR n['range.min'] IS NULL AND t['range.min'] IS NULL",
    "size_order": "n['size_min'] IS NULL OR n['size_min'] <= n['size_avg'] AND n['size_avg'] <= n['size_max']",
    "norm_order": "n['vector.norm_min'] IS NULL OR n['vector.norm_min'] <= n['vector.norm_max']",
}
#: The same of a table's own statistics.
TABLE_RULES = {
    "row_count_missing": "n['row_count'] IS NOT NULL OR n['null_patterns'] IS NULL",
    "row_count_negative": "n['row_count'] IS NULL OR n['row_count'] >= 0",
    "scope_without_scan": "t['scope'] IS NULL OR n['rows_scanned'] IS NOT NULL",
    "scan_exceeds_rows": "n['rows_scanned'] IS NULL OR t['row_count'] = 'estimated' OR n['rows_scanned'] <= n['row_count']",
    "grain_of_scoped": "t['scope'] IS NULL OR grains = 0",
    "timeline_of_scoped": "t['scope'] IS NULL OR t['timeline'] IS NULL",
}


def audit(profile: DataFrame) -> DataFrame:
    """(table_name, column_name, code): every rule that a long profile (table_name, column_name, stat, number, text) breaks."""
    entries = lambda field: F.map_from_entries(F.collect_list(F.when(F.col(field).isNotNull(), F.struct("stat", field))))
    each = profile.dropDuplicates(["table_name", "column_name", "stat"]).groupBy("table_name", "column_name").agg(
        entries("number").alias("n"), entries("text").alias("t"), F.count_if(F.col("stat").startswith("values[")).alias("listed"), F.count_if(F.col("stat").startswith("grain[")).alias("grains")
    )
    whole = each.where("column_name IS NULL").select("table_name", F.expr("coalesce(n['rows_scanned'], n['row_count'])").alias("rows"))
    of_columns = each.where("column_name IS NOT NULL").join(whole, "table_name", "left").withColumn("rows", F.expr("coalesce(n['row_count'], rows)"))

    def broken(df: DataFrame, rules: dict[str, str]) -> DataFrame:
        found = F.filter(F.array(*[F.when(~F.coalesce(F.expr(cond), F.lit(True)), F.lit(code)) for code, cond in rules.items()]), lambda x: x.isNotNull())
        return df.select("table_name", "column_name", F.explode(found).alias("code"))

    repeated = profile.groupBy("table_name", "column_name", "stat").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("table_name", "column_name", F.lit("statistic_repeated").alias("code")).distinct()
    return broken(of_columns, COLUMN_RULES).unionByName(broken(each.where("column_name IS NULL"), TABLE_RULES)).unionByName(repeated)
