"""Numbers, durations and sizes in words, and what a job came to as lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: float) -> str:
    """1234567 as 1,234,567; fractions with up to four digits."""
    return f"{value:,}" if isinstance(value, int) else f"{value:,.4f}".rstrip("0").rstrip(".")


def duration(seconds: float) -> str:
    """3725.4 as 1 h 2 min 5 s; under a minute with one digit after the point."""
    if seconds < 60:
        return f"{seconds:.1f} s"
    minutes, rest = divmod(round(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours} h {minutes} min {rest} s" if hours else f"{minutes} min {rest} s"


def size(count: float) -> str:
    """Bytes with a binary unit."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(count) < 1024:
            return f"{count:.0f} {unit}" if unit == "B" else f"{count:.1f} {unit}"
        count /= 1024
    return f"{count:.1f} PiB"


def number_column(value: Column) -> Column:
    """:func:`number` of whole numbers, over a table."""
    return F.format_number(value.cast("bigint"), 0)


def duration_column(seconds: Column) -> Column:
    """:func:`duration` over a table."""
    whole = F.rint(seconds).cast("bigint")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    parts = F.concat_ws(" ", F.when(hours > 0, F.concat(hours, F.lit(" h"))), F.concat(minutes, F.lit(" min")), F.concat(rest, F.lit(" s")))
    return F.when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit(" s"))).otherwise(parts)


def size_column(count: Column) -> Column:
    """:func:`size` over a table."""
    shown = F.concat(F.format_string("%.1f", count / (1 << 50)), F.lit(" PiB"))
    for power, unit in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB")):
        shown = F.when(F.abs(count) < 1 << power + 10, F.concat(F.format_string("%.1f", count / (1 << power)), F.lit(f" {unit}"))).otherwise(shown)
    return F.when(F.abs(count) < 1024, F.concat(count.cast("bigint"), F.lit(" B"))).otherwise(shown)


def summary(command: str, result: object, seconds: float) -> list[str]:
    """A line for each figure of a job's result, and how long it took."""
    lines = []
    for key, value in (result.items() if isinstance(result, dict) else [("result", result)]):
        if value is None or value == "":
            continue
        shown = ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else number(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)
        lines.append(f"{key.replace('_', ' ')}: {shown}")
    return [*lines, f"{command} took {duration(seconds)}"]
