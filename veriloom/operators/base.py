"""What every check shares: the shape of a raw finding and the registry of checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import canonical

RAW = "doc_id bigint, check string, seq bigint, category string, severity string, target string, reasoning string, suggested_fix string, numbers array<string>, confidence double"
COLUMNS = ["doc_id", "check", "seq", "category", "severity", "target", "reasoning", "suggested_fix", "numbers", "confidence"]


def findings(df: DataFrame, check: str, seq: Column | str, category: Column | str, severity: Column | str, target: Column, reasoning: Column, fix: Column | str, numbers: list[Column] | Column | None, confidence: Column | float) -> DataFrame:
    """Rows of `df` (with doc_id) as raw findings."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    listed = F.array().cast("array<string>") if numbers is None else F.array(*numbers) if isinstance(numbers, list) else numbers
    return df.select(
        F.col("doc_id"), F.lit(check).alias("check"), (F.col(seq) if isinstance(seq, str) else seq).cast("long").alias("seq"), lit(category).alias("category"),
        lit(severity).alias("severity"), target.alias("target"), reasoning.alias("reasoning"), lit(fix).alias("suggested_fix"),
        F.transform(listed, canonical).alias("numbers"), lit(confidence).cast("double").alias("confidence"),
    )


def say(template: str, *values: Column) -> Column:
    """A sentence from a printf template."""
    return F.format_string(template, *values)


def snippet(text: Column, n: int = 120) -> Column:
    return F.substring(F.trim(text), 1, n)


@dataclass(frozen=True)
class Check:
    """A check of manuscripts (doc_id, text, bib) that gives raw findings; `rank` orders checks in a report."""

    name: str
    rank: int
    run: Callable[[DataFrame], DataFrame]
    default: bool = True


CHECKS: dict[str, Check] = {}


def check(name: str, rank: int, default: bool = True):
    def register(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        CHECKS[run.__name__] = Check(name, rank, run, default)
        return run

    return register
