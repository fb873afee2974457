"""What is measured of which table: defaults, and rules by name that change them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from fnmatch import fnmatchcase

MODES = ("full", "sample", "filter", "catalog")


@dataclass(frozen=True)
class Settings:
    mode: str = "full"
    sample: float | None = None
    condition: str | None = None
    max_rows: int | None = None
    enumeration_threshold: int = 50
    top_n_values: int = 20
    top_n_null_patterns: int = 20
    looks_like_sample_size: int = 1000
    percentiles: tuple[int, ...] = (1, 25, 50, 75, 99)
    max_parts: int = 20
    max_part_depth: int = 3
    max_age_days: int = 7

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if self.sample is not None and self.condition is not None:
            raise ValueError("a scope is a sample or a filter")


@dataclass(frozen=True)
class Rule:
    """Settings for the tables that a pattern matches; with ``min_rows``, only where a table is known to have as many."""

    match: tuple[str, ...]
    set: dict[str, object] = field(default_factory=dict)
    min_rows: int | None = None

    def fits(self, name: str, rows: int | None) -> bool:
        large = self.min_rows is None or rows is not None and rows >= self.min_rows
        return large and any(fnmatchcase(name.lower(), p) for p in self.match)


def resolve(name: str, rules: list[Rule] = (), rows: int | None = None, defaults: Settings = Settings()) -> Settings:
    """The settings of one table: every rule that fits, later ones over earlier ones."""
    changed: dict[str, object] = {}
    for rule in rules:
        if rule.fits(name, rows):
            changed |= rule.set
    return replace(defaults, **changed)


def explain(name: str, rules: list[Rule] = (), rows: int | None = None, defaults: Settings = Settings()) -> list[tuple[str, object, str]]:
    """(setting, value, origin) of each setting of one table; the origin is ``default`` or the patterns of the rule that set it."""
    found = resolve(name, rules, rows, defaults)
    origin = {f.name: "default" for f in fields(Settings)}
    for rule in rules:
        if rule.fits(name, rows):
            origin |= dict.fromkeys(rule.set, ", ".join(rule.match))
    return [(k, getattr(found, k), o) for k, o in origin.items()]


def must_profile(age_days: float | None, before: Settings | None, now: Settings, redacted: tuple = (), redacts: tuple = ()) -> bool:
    """Whether a stored profile can't stand for a new one: there is none, it is stale, or it was made by other settings or redactions."""
    return age_days is None or before is None or age_days >= now.max_age_days or before != now or tuple(redacted) != tuple(redacts)
