"""Equal-width histograms of counts with an overflow bar, and statistics of their bins."""

from __future__ import annotations

import html
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

OVERFLOW = -1


def bin_column(value: Column, edges: Column, bins: int) -> Column:
    """The bin of a value from edges[0] to edges[bins]; bins are half open, the last one is closed.

    A division finds the bin up to rounding and the edges themselves decide, so
    that values on an edge fall as a binary search over the edges has them.
    """
    low, high = F.get(edges, F.lit(0)), F.get(edges, F.lit(bins))
    guess = F.least(F.greatest(F.floor((value - low) * F.lit(float(bins)) / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int")
    down = F.when(value < F.get(edges, guess), guess - 1).when((guess < bins - 1) & (value >= F.get(edges, guess + 1)), guess + 1).otherwise(guess)
    return F.when(low == high, F.lit(bins - 1)).otherwise(down).cast("int")


def histogram(counts: DataFrame, *, column: str = "sample_count", bins: int = 100, max_value: float | None = None) -> DataFrame:
    """(bin, low_edge, high_edge, n): every bin, also empty ones, and bin -1 for values of ``max_value`` or more.

    The input is read once and grouped by value; the ends, the edges and the
    bins are all taken from those groups, in one plan. Without values there are
    no rows; if all of them overflow there is only the overflow bar.
    """
    values = counts.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    over = F.lit(False) if max_value is None else F.col("v") >= float(max_value)
    top = F.max("v") if max_value is None else F.least(F.max("v"), F.lit(float(max_value)))
    ends = values.agg(F.min("v").alias("low"), top.alias("top")).filter("low IS NOT NULL")
    if max_value is not None:
        ends = ends.withColumn("top", F.when(F.col("low") < float(max_value), F.col("top")))  # null: nothing is in range
    steps = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.col("top")).otherwise(F.col("low") + i * ((F.col("top") - F.col("low")) / bins)))
    edges = ends.select(steps.alias("edges"))
    number = F.when(over, F.lit(OVERFLOW)).otherwise(bin_column(F.col("v"), edges.scalar(), bins))
    n = values.select(number.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    first = 0 if max_value is None else OVERFLOW
    frame = edges.select("edges", F.explode(F.sequence(F.lit(first), F.lit(bins - 1))).alias("bin"))
    bar = F.col("bin") == OVERFLOW
    frame = frame.filter(bar | F.get("edges", F.lit(0)).isNotNull() & F.get("edges", F.lit(bins)).isNotNull())
    place = F.greatest(F.col("bin"), F.lit(0))
    low_edge = F.when(bar, F.lit(None if max_value is None else float(max_value))).otherwise(F.get("edges", place))
    frame = frame.select("bin", low_edge.alias("low_edge"), F.when(~bar, F.get("edges", place + 1)).alias("high_edge"))
    return frame.join(n, "bin", "left").select("bin", "low_edge", "high_edge", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("bin")


def bin_statistics(counts: DataFrame, *, column: str = "sample_count", bins: int = 100, max_value: float | None = None) -> dict:
    """The figures of a histogram's bins."""
    return figures(histogram(counts, column=column, bins=bins, max_value=max_value).collect())


def figures(rows: list[Row]) -> dict:
    """Figures of the bins: totals and shares, means, median and modal bin. ``approx_mean_ref`` divides the in-range sum by all values, ``approx_mean`` by those in range."""
    inside = [r for r in rows if r["bin"] != OVERFLOW]
    over = sum(r["n"] for r in rows if r["bin"] == OVERFLOW)
    n = np.array([r["n"] for r in inside], np.int64)
    total, in_range = int(n.sum()) + over, int(n.sum())
    out = {"total": total, "in_range": in_range, "overflow": over, "in_range_share": in_range / total if total else 0.0, "overflow_share": over / total if total else 0.0}
    if not inside or not total:
        return out | {"min_edge": None, "max_edge": None, "approx_mean": None, "approx_mean_ref": None, "median_bin": None, "modal_bin": None}
    middle = np.array([(r["low_edge"] + r["high_edge"]) / 2 for r in inside])
    weighted = float(middle @ n)
    median = int(min(np.searchsorted(np.cumsum(n), total / 2), len(n) - 1))
    return out | {"min_edge": inside[0]["low_edge"], "max_edge": inside[-1]["high_edge"], "approx_mean": weighted / in_range if in_range else None, "approx_mean_ref": weighted / total, "median_bin": median, "modal_bin": int(n.argmax())}


def picture(rows: list[Row], *, column: str = "sample_count", log: bool = False, width: int = 1000, height: int = 600) -> str:
    """A histogram's rows as an SVG picture, linear or logarithmic: a bar for each bin, and a red one, apart, for what overflows."""
    inside = [r for r in rows if r["bin"] != OVERFLOW]
    over = next((r for r in rows if r["bin"] == OVERFLOW), None)
    left, bottom, top, right = 90, 60, 40, 20
    slots = len(inside) + (2 if over else 0)  # a gap before the overflow bar
    step = (width - left - right) / max(slots, 1)
    most = max((r["n"] for r in rows), default=0)
    scale = math.log10(most + 1) if log else float(most)
    tall = lambda n: (math.log10(n + 1) if log else n) / scale * (height - top - bottom) if scale else 0.0
    bar = lambda slot, r, color, title: f'<rect x="{left + slot * step:.2f}" y="{height - bottom - tall(r["n"]):.2f}" width="{step * 0.95:.2f}" height="{tall(r["n"]):.2f}" fill="{color}"><title>{title}: {r["n"]}</title></rect>'
    text = lambda x, y, words, more="": f'<text x="{x:.2f}" y="{y:.2f}" font-family="sans-serif" font-size="13" {more}>{html.escape(words)}</text>'
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">', f'<rect width="{width}" height="{height}" fill="white"/>']
    out += [bar(i, r, "steelblue", f"{r['low_edge']:g} to {r['high_edge']:g}") for i, r in enumerate(inside)]
    if over:
        out.append(bar(len(inside) + 1, over, "firebrick", f">= {over['low_edge']:g}"))
        out.append(text(width - right, height - bottom + 20, f">= {over['low_edge']:g}", 'text-anchor="end" fill="firebrick"'))
    marks = [10**i for i in range(int(scale) + 1)] if log else [most * i / 4 for i in range(5)]
    for n in marks if most else []:
        y = height - bottom - tall(n)
        out.append(f'<line x1="{left - 5}" x2="{width - right}" y1="{y:.2f}" y2="{y:.2f}" stroke="lightgray"/>')
        out.append(text(left - 8, y + 4, f"{n:,.0f}", 'text-anchor="end"'))
    out.append(f'<line x1="{left}" x2="{width - right}" y1="{height - bottom}" y2="{height - bottom}" stroke="black"/>')
    for i in sorted({0, len(inside) // 2, len(inside)}) if inside else []:
        edge = inside[i]["low_edge"] if i < len(inside) else inside[-1]["high_edge"]
        out.append(text(left + i * step, height - bottom + 20, f"{edge:g}", 'text-anchor="middle"'))
    out.append(text(width / 2, height - 12, column, 'text-anchor="middle"'))
    out.append(text(left, top - 15, "values (logarithmic)" if log else "values"))
    return "\n".join([*out, "</svg>"])
