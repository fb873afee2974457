"""Assertions: predicates on published statistics, and SQL that must return nothing or zero."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = frozenset("sql_type nullable null_count null_rate cardinality cardinality_ratio classification distribution accepted_values looks_like candidate_key range.min range.max freshness.classification freshness.max_age_days row_count".split())
_PERCENTILE = re.compile(r"percentiles\.p\d{1,2}(_\d+)?$")
OK, WARNING, FAILED, ERROR = 0, 1, 2, 3


@dataclass(frozen=True)
class Issue:
    code: str
    path: str
    message: str
    severity: int = FAILED


def assertable(stat: str) -> bool:
    return stat in STATS or bool(_PERCENTILE.match(stat))


def _comparable(x: object) -> object:
    if isinstance(x, str):
        try:
            return datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            return x
    return x


def holds(value: object, predicate: object) -> bool | None:
    """Whether ``value`` meets a predicate: a scalar, or a dict of min, max, in, pattern; None if the two can't be compared."""
    if not isinstance(predicate, dict):
        if isinstance(value, bool) != isinstance(predicate, bool):
            return None
        return value == predicate
    if "in" in predicate:
        return any(holds(value, x) for x in predicate["in"])
    if "pattern" in predicate:
        return bool(re.search(predicate["pattern"], value)) if isinstance(value, str) else None
    v = _comparable(value)
    for name, test in (("min", lambda a, b: a >= b), ("max", lambda a, b: a <= b)):
        if name not in predicate:
            continue
        bound = _comparable(predicate[name])
        if isinstance(bound, float) and math.isnan(bound) or isinstance(v, bool) or isinstance(bound, bool):
            return None
        try:
            if not test(v, bound):
                return False
        except TypeError:
            return None
    return True


def check(profile: dict[str, object], predicates: dict[str, object], path: str = "") -> list[Issue]:
    """Issues of one column's published statistics against predicates by statistic."""
    issues = []
    for stat, predicate in predicates.items():
        at = f"{path}.{stat}" if path else stat
        if not assertable(stat):
            issues.append(Issue("unknown_statistic", at, f"{stat} is no statistic", ERROR))
        elif profile.get(stat) is None:
            issues.append(Issue("inapplicable", at, f"{stat} is not published here", WARNING))
        elif stat == "accepted_values":
            if not profile.get("exhaustive"):
                issues.append(Issue("incomplete_values", at, "the list of values is not complete", WARNING))
            elif extra := sorted(set(profile[stat]) - set(predicate)):
                issues.append(Issue("unaccepted_values", at, ", ".join(map(str, extra))))
        elif (verdict := holds(profile[stat], predicate)) is None:
            issues.append(Issue("not_comparable", at, f"{profile[stat]!r} against {predicate!r}", ERROR))
        elif not verdict:
            issues.append(Issue("assertion_failed", at, f"{profile[stat]!r} against {predicate!r}"))
    return issues


def check_ranges(profile: DataFrame, bounds: DataFrame) -> DataFrame:
    """(table_name, column_name, stat, value, min_value, max_value, passed) of a long profile against many range predicates at once."""
    met = profile.join(bounds, ["table_name", "column_name", "stat"])
    v = F.col("value").try_cast("double")
    return met.select("table_name", "column_name", "stat", F.round(v, 6).alias("value"), "min_value", "max_value", F.coalesce((F.col("min_value").isNull() | (v >= F.col("min_value"))) & (F.col("max_value").isNull() | (v <= F.col("max_value"))), F.lit(False)).alias("passed"))


def sql_zero(spark: SparkSession, sql: str, name: str = "query") -> list[Issue]:
    """The first column of the first row must be the number zero."""
    try:
        rows = spark.sql(sql).limit(1).collect()
    except Exception as e:  # what the engine refuses is the author's issue, not ours
        return [Issue("query_error", name, str(e).splitlines()[0], ERROR)]
    value = rows[0][0] if rows else None
    if value is None:
        return [Issue("assertion_failed", name, "no value")]
    if isinstance(value, (bool, str)) or not isinstance(value, (int, float)) and not hasattr(value, "as_tuple") or isinstance(value, float) and not math.isfinite(value):
        return [Issue("type_error", name, f"{value!r} is no finite number", ERROR)]
    return [] if value == 0 else [Issue("assertion_failed", name, f"{value} is not 0")]


def sql_empty(spark: SparkSession, sql: str, name: str = "query", quoted: int = 10) -> list[Issue]:
    """The statement must return no row; the first ones it returns are quoted."""
    try:
        rows = spark.sql(sql).limit(quoted).collect()
    except Exception as e:  # as above
        return [Issue("query_error", name, str(e).splitlines()[0], ERROR)]
    return [Issue("assertion_failed", name, "; ".join(str(r.asDict()) for r in rows))] if rows else []


#: What a run can end with, by code; fixed values.
EXIT_CODES = {"ok": 0, "error": 1, "stale": 2, "drift": 3, "connection": 4, "partial_failure": 5, "assertion_failed": 6, "total_failure": 7}
#: Which of several outcomes a run reports: that of the least trustworthy result first; fixed values.
EXIT_PRECEDENCE = ("error", "connection", "total_failure", "partial_failure", "assertion_failed", "drift", "stale", "ok")


def run_exit_code(outcomes: set[str] = frozenset(), succeeded: int = 0, skipped: int = 0, failed: int = 0, issues: list[Issue] = ()) -> int:
    """The exit code of a run: of its outcomes by name, its tables by how they ended, and its assertion issues."""
    found = {"ok", *outcomes}
    if failed:
        found.add("partial_failure" if succeeded or skipped else "total_failure")
    if any(i.severity >= FAILED for i in issues):
        found.add("assertion_failed")
    return EXIT_CODES[next(o for o in EXIT_PRECEDENCE if o in found)]


def exit_code(issues: list[Issue]) -> int:
    """The worst severity."""
    return max((i.severity for i in issues), default=OK)
