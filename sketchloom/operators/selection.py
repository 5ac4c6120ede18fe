"""Cutpoints of counts, and what lies between them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cutpoints:
    """Inclusive bounds of a count; the percentiles are None if the bounds were given."""

    source: str
    p_low: float | None
    p_high: float | None
    low_cut: float
    high_cut: float

    def to_dict(self) -> dict:
        return asdict(self)


COUNT_COLUMN = {"hash": "sample_count", "sample": "matched_hash_count"}


def cutpoint_row(counts: DataFrame, low: float, high: float, column: str) -> DataFrame:
    """One row (low_cut, high_cut): exact quantiles, linear between neighbours."""
    if not 0 <= low <= high <= 1:
        raise ValueError("percentiles must be from 0 to 1 and in order")
    # few distinct counts: they are grouped first, and weighted, so no task sees all rows
    grouped = counts.groupBy(column).agg(F.count("*").alias("n"))
    return grouped.agg(F.percentile(column, F.lit(low), F.col("n")).alias("low_cut"), F.percentile(column, F.lit(high), F.col("n")).alias("high_cut"))


def cutpoints(counts: DataFrame, source: str, *, percentiles: tuple[float, float] | None = None, cuts: tuple[float, float] | None = None) -> Cutpoints:
    """By percentiles or by given cuts, one of both."""
    if (percentiles is None) == (cuts is None):
        raise ValueError("give either percentiles or cuts")
    if cuts is not None:
        if cuts[0] > cuts[1]:
            raise ValueError("the low cut is over the high one")
        return Cutpoints(source, None, None, float(cuts[0]), float(cuts[1]))
    row = cutpoint_row(counts, *percentiles, COUNT_COLUMN[source]).first()
    if row["low_cut"] is None:
        raise ValueError("no counts to take percentiles of")
    return Cutpoints(source, *percentiles, row["low_cut"], row["high_cut"])


def between_percentiles(counts: DataFrame, low: float, high: float, column: str) -> DataFrame:
    """Rows whose count lies between two percentiles, in one plan: the counts are made once."""
    cuts = cutpoint_row(counts, low, high, column)
    return counts.filter(F.col(column).between(cuts.select("low_cut").scalar(), cuts.select("high_cut").scalar()))


def between(counts: DataFrame, low: float, high: float, column: str) -> DataFrame:
    """Rows with low <= count <= high."""
    return counts.filter(F.col(column).between(F.lit(low), F.lit(high)))
