"""Rounding rules, quantile bands, severity and blends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import col


def round_even(x, digits: int = 0) -> Column:
    """Ties go to the even neighbour."""
    return F.bround(col(x), digits)


def round_up_half(x) -> Column:
    """Ties go toward plus infinity."""
    return F.floor(col(x) + 0.5)


def quantile_name(level: float) -> str:
    """``q`` and the percent; parts of a percent follow an underscore (0.025 is ``q2_5``)."""
    return "q" + f"{round(level * 100, 9):g}".replace(".", "_")


def quantile_key(level: float) -> str:
    """Published key: one decimal for deciles, else the shortest form."""
    return f"{level:.1f}" if abs(round(level, 1) - level) < 1e-9 else f"{level:g}"


def non_crossing(columns: list) -> list[Column]:
    """Clamp at zero and sort across the row; NULLs sort last."""
    clamped = [F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(0.0))) for c in columns]
    ordered = F.array_sort(F.array(*clamped))
    return [F.get(ordered, F.lit(i)) for i in range(len(columns))]


def quantile_map(pairs: dict[float, Column]) -> Column:
    """Map of published key to value without missing levels, plus q30/q70."""
    keys = [quantile_key(q) for q in pairs]
    values = list(pairs.values())
    for level, alias in ((0.3, "q30"), (0.7, "q70")):
        if level in pairs:
            keys.append(alias)
            values.append(pairs[level])
    full = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*values))
    return F.map_filter(full, lambda _, v: v.isNotNull())


def categorical_code(c, vocabulary: list[str]) -> Column:
    """Position in a fixed vocabulary; unknown is NULL."""
    at = F.array_position(F.array(*map(F.lit, vocabulary)), col(c))
    return F.when(at > 0, (at - 1).cast("int"))


def one_hot(c, values: list[str], prefix: str = "") -> dict[str, Column]:
    return {f"{prefix}{v}": F.coalesce((col(c) == v).cast("int"), F.lit(0)) for v in values}


# Dashboard bands: lowest label, then (from this value on, label).
SEVERITY = {
    "queue": ("green", [(10.0, "yellow"), (20.0, "red")]),
    "minutes_since_pull": ("green", [(6.0, "yellow"), (10.0, "red")]),
    "success_rate": ("red", [(0.9, "yellow"), (0.99, "green")]),
    "duration": ("green", [(5.0, "yellow"), (15.0, "red")]),
    "failures": ("green", [(1.0, "red")]),
}


def severity(x, kind: str) -> Column:
    """Threshold band of a dashboard value."""
    base, steps = SEVERITY[kind]
    c = col(x)
    bands = reduce(lambda out, s: out.when(c >= s[0], s[1]), reversed(steps), F.when(c.isNull(), None))
    return bands.otherwise(base)


def trend(current, last_forecast) -> Column:
    """Expected change; 0 when either side is missing."""
    return F.coalesce(col(last_forecast) - col(current), F.lit(0.0))


def trend_arrow(change) -> Column:
    c = col(change)
    return F.when(c > 0.5, "up").when(c < -0.5, "down").otherwise("flat")


def smoothstep(t) -> Column:
    c = col(t)
    return 3.0 * c * c - 2.0 * c * c * c


def eased(last, mean, progress) -> Column:
    """Move from the last value to the forecast; no last value keeps the forecast."""
    b = smoothstep(progress)
    mixed = F.greatest(F.lit(0.0), col(last) * (1.0 - b) + col(mean) * b)
    return F.when(col(last).isNull(), col(mean)).otherwise(mixed)


def pinball(y, pred, level: float) -> Column:
    d = col(y) - col(pred)
    return F.when(d.isNotNull(), F.greatest(d * level, d * (level - 1.0)))
