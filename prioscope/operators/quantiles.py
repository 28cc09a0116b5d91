"""Exact quantiles in few scans: mergeable sketches bracket the wanted ranks, counts settle them.

A first scan sketches every column (KLL), which bounds each wanted rank by two
values close to each other. A second scan counts, map-side, the rows between the
brackets and the rows per value inside them; the counts tell which value holds the
rank, whatever the sketch promised. Brackets that still hold too many different
values are narrowed by further sketches of their inside first, each of which
leaves a few thousandths of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Size of a sketch, and three times the rank error that such a one has with 99 % confidence.
SKETCH = 4096
MARGIN = 3 * 2.296 / SKETCH**0.9021
# Different values of all brackets together that one scan may hand to the driver.
MOST_VALUES = 200_000
_INFINITE = float("inf")


@dataclass
class _Target:
    """A 1-based rank of a column, and two values it lies between."""

    column: int
    rank: int
    low: float = -_INFINITE
    high: float = _INFINITE
    inside: int = 0
    value: float | None = None


def quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], sketch: int = SKETCH,
              most_values: int = MOST_VALUES) -> dict[str, float | None]:
    """The linearly interpolated quantile for each name, which maps to a column and a probability.

    Nulls and NaN are ignored; a column without any value gives None. All columns
    and probabilities share the scans.
    """
    if not wanted:
        return {}
    columns: list[Column] = []
    names: list[str] = []
    at: dict[str, int] = {}
    for column, _ in wanted.values():
        name = column if isinstance(column, str) else str(column)
        if name not in names:
            names.append(name)
            columns.append(F.col(column) if isinstance(column, str) else column)
        at[name] = names.index(name)
    values = df.select(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    margin = MARGIN * (SKETCH / sketch) ** 0.9021
    shares = {i: sorted({p for column, p in wanted.values() if at[_name(column)] == i}) for i in range(len(columns))}
    totals, bounds = _sketched(values, {i: [(-_INFINITE, _INFINITE, [(p, p) for p in shares[i]])] for i in shares}, sketch, margin)

    targets: dict[tuple[int, int], _Target] = {}
    for i, probabilities in shares.items():
        total = totals[i][0][1]
        for share, (low, high) in zip(probabilities, bounds[i][0]):
            for rank in _ranks(share, total):
                targets.setdefault((i, rank), _Target(i, rank, low, high, int(2 * margin * total) + 1))
    while open_ := [t for t in targets.values() if t.value is None]:
        if not _settled(values, open_, most_values):
            _narrowed(values, [t for t in open_ if t.value is None], sketch, min(margin, 0.4))

    out: dict[str, float | None] = {}
    for name, (column, share) in wanted.items():
        i = at[_name(column)]
        total = totals[i][0][1]
        if not total:
            out[name] = None
            continue
        low, high = (targets[i, rank].value for rank in _ranks(share, total))
        spot = (total - 1) * share
        out[name] = low if low == high else low + (high - low) * (spot - int(spot))
    return out


def _name(column: str | Column) -> str:
    return column if isinstance(column, str) else str(column)


def _ranks(share: float, total: int) -> tuple[int, ...]:
    """Ranks of the two values between which a quantile lies."""
    if not total:
        return ()
    spot = (total - 1) * share
    return int(spot) + 1, min(total, int(spot) + 1 + (spot > int(spot)))


def _sketched(
    values: DataFrame, intervals: dict[int, list[tuple[float, float, list[tuple[float, float]]]]], size: int, margin: float,
) -> tuple[dict, dict]:
    """Per column and closed interval: rows below and inside, and per pair of inner rank shares two values around them. One scan."""
    aggregates = []
    for i, listed in intervals.items():
        value = F.col(f"v{i}")
        for j, (low, high, shares) in enumerate(listed):
            inside = (value >= low) & (value <= high)
            kept = F.when(inside, value)
            points = F.array(*[F.lit(min(1.0, max(0.0, s))) for a, b in shares for s in (a - margin, b + margin)])
            # Without values there is no quantile to ask for.
            found = F.when(F.count(kept) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(kept, F.lit(size)), points))
            aggregates.append(F.struct(F.count_if(value < low).alias("below"), F.count(kept).alias("inside"),
                                       found.alias("found")).alias(f"c{i}_{j}"))
    row = values.agg(*aggregates).first()
    counts, bounds = {}, {}
    for i, listed in intervals.items():
        counts[i] = [(row[f"c{i}_{j}"]["below"], row[f"c{i}_{j}"]["inside"]) for j in range(len(listed))]
        bounds[i] = []
        for j, (_, _, shares) in enumerate(listed):
            found = row[f"c{i}_{j}"]["found"]
            bounds[i].append([(found[2 * k], found[2 * k + 1]) if found else (0.0, 0.0) for k in range(len(shares))])
    return counts, bounds


def _merged(targets: Sequence[_Target]) -> dict[int, list[tuple[float, float]]]:
    """Disjoint closed intervals per column that cover those of the targets."""
    out: dict[int, list[tuple[float, float]]] = {}
    for low, high, i in sorted((t.low, t.high, t.column) for t in targets):
        own = out.setdefault(i, [])
        if own and low <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], high))
        else:
            own.append((low, high))
    return out


def _settled(values: DataFrame, targets: Sequence[_Target], most_values: int) -> bool:
    """Finds the values of all targets by one scan; False if the brackets hold too many to look at.

    A target whose bracket turns out not to hold it gets the gap that does.
    """
    if sum(t.inside for t in targets if t.low < t.high) > 4 * most_values:
        return False
    intervals = _merged(targets)
    parts = []
    for i, listed in intervals.items():
        value = F.col(f"v{i}")
        # Odd segments are brackets, even ones the gaps around them.
        segment = None
        for j, (low, high) in enumerate(listed):
            condition = ((value < low, 2 * j), (value <= high, 2 * j + 1))
            for inside, number in condition:
                segment = F.when(inside, number) if segment is None else segment.when(inside, number)
        segment = F.when(value.isNotNull(), segment.otherwise(2 * len(listed)))
        parts.append(F.struct(F.lit(i).alias("i"), segment.alias("segment"), F.when(segment % 2 == 1, value).alias("value")))
    part = parts[0] if len(parts) == 1 else F.explode(F.array(*parts))
    counted = values.select(part.alias("p")).select("p.*").where(F.col("segment").isNotNull()).groupBy("i", "segment", "value").agg(
        F.count("*").alias("n")).orderBy("i", "segment", "value").limit(most_values + 1).collect()
    if len(counted) > most_values:
        return False
    for i, listed in intervals.items():
        own = [r for r in counted if r["i"] == i]
        for t in (t for t in targets if t.column == i):
            reached = 0
            for r in own:
                if reached < t.rank <= reached + r["n"]:
                    gap = r["segment"] // 2
                    if r["segment"] % 2:
                        t.value = r["value"]
                    else:
                        t.low = listed[gap - 1][1] if gap else -_INFINITE
                        t.high = listed[gap][0] if gap < len(listed) else _INFINITE
                        t.inside = r["n"]
                    break
                reached += r["n"]
    return all(t.value is not None for t in targets)


def _narrowed(values: DataFrame, targets: Sequence[_Target], size: int, margin: float) -> None:
    """Closer brackets for all targets: one scan counts what is below, at and between their ends, one sketches the inside.

    Rows at the ends are told apart first, so that a value that many rows share
    either is the one looked for or leaves the bracket.
    """
    spots = sorted({(t.column, t.low, t.high) for t in targets})
    aggregates = []
    for i, low, high in spots:
        value = F.col(f"v{i}")
        aggregates.append(F.array(F.count_if(value < low), F.count_if(value == low), F.count_if((value > low) & (value < high)),
                                  F.count_if(value == high)))
    counted = dict(zip(spots, values.agg(F.array(*aggregates).alias("n")).first()["n"]))
    asked: dict[int, list] = {}
    owners: dict[int, list[list[_Target]]] = {}
    for i, low, high in spots:
        below, at_low, inside, at_high = counted[i, low, high]
        held = []
        for t in (t for t in targets if (t.column, t.low, t.high) == (i, low, high)):
            if t.rank <= below:
                t.low, t.high, t.inside = -_INFINITE, math.nextafter(low, -_INFINITE), below
            elif t.rank <= below + at_low:
                t.value = low
            elif t.rank <= below + at_low + inside:
                held.append(t)
            elif t.rank <= below + at_low + inside + at_high:
                t.value = high
            else:
                t.low, t.high, t.inside = math.nextafter(high, _INFINITE), _INFINITE, t.rank
        if held:
            shares = [((t.rank - below - at_low) / inside,) * 2 for t in held]
            asked.setdefault(i, []).append((math.nextafter(low, _INFINITE), math.nextafter(high, -_INFINITE), shares))
            owners.setdefault(i, []).append(held)
            for t in held:
                t.inside = int(2 * margin * inside) + 1
    if asked:
        _, bounds = _sketched(values, asked, size, margin)
        for i in asked:
            for held, found in zip(owners[i], bounds[i]):
                for t, (low, high) in zip(held, found):
                    t.low, t.high = low, high
