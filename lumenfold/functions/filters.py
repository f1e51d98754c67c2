"""Filters as one predicate, and how they are relaxed when nothing matches."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters of the post corpus and the order in which inferred ones are given up (``time`` first).
POST_FILTERS = ("district", "thana", "platform", "sentiment", "category", "sub_category")
POST_DROP_ORDER = ("time", "sub_category", "category", "sentiment", "platform", "thana", "district")


@dataclass(frozen=True)
class TimeFilter:
    """Closed on both ends; None is open."""

    start: date | None = None
    end: date | None = None


def conjunction(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def exact(df: DataFrame, filters: Mapping[str, str]) -> list[Column]:
    """Equality, or containment where the column is an array; a missing column is an error of the caller."""
    kinds = dict(df.dtypes)
    return [F.array_contains(F.col(k), v) if kinds[k].startswith("array") else F.col(k) == v for k, v in filters.items() if v is not None]


def overlaps(time: TimeFilter | None, start_col: str = "date_start", end_col: str = "date_end") -> list[Column]:
    """Spans that touch the filter's days; rows without dates are out. Dates are RFC 3339 text, which sorts by time."""
    tests = []
    if time and time.start:
        tests.append(F.col(end_col) >= f"{time.start.isoformat()}T00:00:00Z")
    if time and time.end:
        tests.append(F.col(start_col) <= f"{time.end.isoformat()}T23:59:59Z")
    return tests


def posted_within(time: TimeFilter | None, column: str = "posted_at") -> list[Column]:
    tests = []
    if time and time.start:
        tests.append(F.col(column) >= F.lit(f"{time.start.isoformat()} 00:00:00").cast("timestamp"))
    if time and time.end:
        tests.append(F.col(column) <= F.lit(f"{time.end.isoformat()} 23:59:59").cast("timestamp"))
    return tests


def levels(names: list[str], order: tuple[str, ...] = POST_DROP_ORDER, fixed: frozenset[str] = frozenset()) -> list[list[str]]:
    """What is kept at each step of dropping one inferred filter after another; explicit ones (``fixed``) stay."""
    kept, out = list(names), [list(names)]
    for name in order:
        if name in kept and name not in fixed:
            kept = [n for n in kept if n != name]
            out.append(list(kept))
    return out


def count_levels(df: DataFrame, tests: Mapping[str, Column], steps: list[list[str]]) -> DataFrame:
    """Rows that match at each step, in one pass: columns level_0, level_1, .."""
    return df.agg(*[F.count_if(conjunction([tests[n] for n in names])).alias(f"level_{i}") for i, names in enumerate(steps)])


def first_that_matches(df: DataFrame, tests: Mapping[str, Column], steps: list[list[str]]) -> list[str]:
    """The filters of the first step with a row; the last step's if none has."""
    counts = count_levels(df, tests, steps).first()
    return next((names for i, names in enumerate(steps) if counts[f"level_{i}"]), steps[-1])
