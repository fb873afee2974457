"""Exact order statistics by brackets that narrow.

One pass counts the values of finite numbers in steps of equal width, and the
step that holds a rank is its bracket.  As long as more than ``INSIDE`` values
lie in a bracket, an approximate pass proposes a narrower one and a count tells
whether the rank is still in it; then an exact pass ranks what lies inside.  No
task sees a whole column sorted, and no aggregate holds more than a bracket's
values, however large the column.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from math import ceil, floor, inf, ulp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in a bracket that are ranked at once, and how far around its rank a proposed bracket reaches.
INSIDE, SLACK = 20_000, 0.001
#: The most steps of one count.
STEPS = 65_536


def _steps(df: DataFrame, low: object, high: object, n: int) -> list[tuple[int, object, object]] | None:
    """(rows, least, greatest) of each step that holds values of ``v``, in order; None where steps can't be told."""
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (low, high))
    if not numbers or not low < high or not 0 < (width := float(high) - float(low)) < inf:
        return None
    k = min(STEPS, max(16, 4 * n // INSIDE))
    # every operation keeps the order, so no value of a step is above one of the next
    step = F.floor((F.col("v").cast("double") - F.lit(float(low))) / F.lit(width) * F.lit(float(k)))
    counted = df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    return [(r["n"], r["a"], r["b"]) for r in sorted(counted.collect(), key=lambda r: r["step"])]


def at_ranks(df: DataFrame, value: Column, ranks: dict[str, int], n: int) -> dict[str, object]:
    """The values at zero-based ``ranks`` among the ``n`` that are not null."""
    if not n or not ranks:
        return {}
    df = df.select(value.alias("v")).where("v IS NOT NULL")
    wanted, v = sorted(set(ranks.values())), F.col("v")
    low, high, below, inside, slack = {}, {}, dict.fromkeys(wanted, 0), dict.fromkeys(wanted, n), dict.fromkeys(wanted, SLACK)
    if n > INSIDE:
        ends = df.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        low, high = dict.fromkeys(wanted, ends["a"]), dict.fromkeys(wanted, ends["b"])
        if steps := _steps(df, ends["a"], ends["b"], n):
            upto = list(accumulate(s[0] for s in steps))
            for r in wanted:
                at = bisect_right(upto, r)
                inside[r], low[r], high[r] = steps[at]
                below[r] = upto[at] - inside[r]
    kept = lambda r: F.when((v >= low[r]) & (v <= high[r]), v) if r in low else v
    while todo := [r for r in wanted if inside[r] > INSIDE and low[r] < high[r] and slack[r] < 1]:
        share = {r: (r - below[r] + 0.5) / inside[r] for r in todo}
        shared: dict[tuple, list[int]] = {}
        for r in todo:  # ranks in one bracket, as all are at first, share an aggregate
            shared.setdefault((low[r], high[r]), []).append(r)
        levels = {at: [x for r in rs for x in (max(0.0, share[r] - slack[r]), min(1.0, share[r] + slack[r]))] for at, rs in shared.items()}
        near = df.agg(*[F.percentile_approx(kept(rs[0]), levels[at], 10_000).alias(f"q{i}") for i, (at, rs) in enumerate(shared.items())]).first()
        proposed = {r: near[f"q{i}"][2 * k : 2 * k + 2] for i, rs in enumerate(shared.values()) for k, r in enumerate(rs)}
        todo = list(proposed)
        counts = df.agg(*[F.count_if(v < a).alias(f"below{i}") for i, (a, _) in enumerate(proposed.values())], *[F.count_if((v >= a) & (v <= b)).alias(f"in{i}") for i, (a, b) in enumerate(proposed.values())]).first()
        for i, r in enumerate(todo):
            if not counts[f"below{i}"] <= r < counts[f"below{i}"] + counts[f"in{i}"]:
                slack[r] *= 8  # the estimate missed: look wider
            elif counts[f"in{i}"] < inside[r]:
                (low[r], high[r]), below[r], inside[r] = proposed[r], counts[f"below{i}"], counts[f"in{i}"]
            else:
                slack[r] = 1  # both ends are values of very many rows, and few lie between: rank these
    open_ranks = [r for r in wanted if r not in low or low[r] < high[r]]
    found = {r: low[r] for r in wanted if r not in open_ranks}
    if open_ranks:
        shared = {}
        for r in open_ranks:
            shared.setdefault((low.get(r), high.get(r)), []).append(r)
        ranked = df.select(*[kept(rs[0]).alias(f"w{i}") for i, rs in enumerate(shared.values())])
        if None not in (ends := list(shared))[0]:  # few rows reach the ranking
            ranked = ranked.where(F.coalesce(*[F.col(f"w{i}") for i in range(len(ends))]).isNotNull())
        each = [", ".join(f"{(r - below[r] + 0.5) / inside[r]!r}D" for r in rs) for rs in shared.values()]
        row = ranked.selectExpr(*[f"percentile_disc(array({levels})) WITHIN GROUP (ORDER BY w{i}) AS x{i}" for i, levels in enumerate(each)]).first()
        found |= {r: v for i, rs in enumerate(shared.values()) for r, v in zip(rs, row[f"x{i}"])}
    return {k: found[r] for k, r in ranks.items()}


def interpolated(df: DataFrame, value: Column, levels: list[float]) -> dict[float, float]:
    """Percentiles by linear interpolation between the neighbouring ranks."""
    n = df.select(F.count(value)).first()[0]
    at = {p: p * (n - 1) for p in levels}
    ranks = {f"{p}a": floor(x) for p, x in at.items()} | {f"{p}b": min(ceil(x), n - 1) for p, x in at.items()}
    found = at_ranks(df, value.cast("double"), ranks, n)
    return {p: found[f"{p}a"] + (found[f"{p}b"] - found[f"{p}a"]) * (x - floor(x)) for p, x in at.items()} if n else {}


def coherent(value: float, low: float, high: float, steps: int = 4) -> float:
    """A percentile within its column's bounds: outside them by few floating-point steps, beyond 2^53, it is clamped; else it stays and is wrong."""
    bound = min(max(value, low), high)
    return bound if abs(value) > 2**53 and abs(value - bound) <= steps * ulp(bound) else value


def nearest(df: DataFrame, value: Column, levels: list[float]) -> dict[float, object]:
    """Percentiles that the column holds: the value at rank ceil(p n)."""
    n = df.select(F.count(value)).first()[0]
    found = at_ranks(df, value, {str(p): max(ceil(p * n) - 1, 0) for p in levels}, n)
    return {p: found[str(p)] for p in levels} if n else {}


def nearest_of(counts: list[tuple[object, int]], levels: list[float]) -> dict[float, object]:
    """``nearest`` of values that are few, from how often each occurs."""
    ordered = sorted((v, k) for v, k in counts if v is not None)
    upto = list(accumulate(k for _, k in ordered))
    return {p: ordered[bisect_right(upto, max(ceil(p * upto[-1]) - 1, 0))][0] for p in levels} if ordered else {}
