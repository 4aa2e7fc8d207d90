"""Quantiles and ranks of rolling frames from sorted runs of half blocks.

A frame of n rows of a series cut into blocks of n ends in one block and began in the one before: it is the end of that
block and the beginning of this one.  Per block the ranks of its values are found once, and a frame's order statistics
follow from counts in the two runs; no frame is collected or sorted.  A task holds one series, which the calendar bounds
(see ``rolling``; ``split_history`` cuts longer ones).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Quantile:
    """Linear-interpolated quantile ``p`` of the last ``n`` rows; null unless ``least`` (all) of them hold a value."""

    column: str
    p: float
    n: int
    least: int | None = None


@dataclass(frozen=True)
class Share:
    """(rows below + (rows equal + 1) / 2) / n of the last ``n`` rows, the row itself included; null unless all hold a value."""

    column: str
    n: int


def _merged(own: np.ndarray, n: int):
    """For each block of ``n`` values, yield (first row, sorted values of the block and the one before, their rows)."""
    for start in range(0, len(own), n):
        low = max(0, start - n)
        both = own[low:start + n]
        order = np.argsort(both, kind="stable")
        order = order[:len(both) - int(np.isnan(both).sum())]  # missing values sort last
        yield start, both[order], order + low


def _inside(rows: np.ndarray, start: int, stop: int, n: int) -> np.ndarray:
    """(frames, values): whether a sorted value lies in the frame that ends at each row of [start, stop)."""
    ends = np.arange(start, stop)[:, None]
    return (rows[None, :] <= ends) & (rows[None, :] > ends - n)


def quantiles(own: np.ndarray, n: int, stats: list[tuple[float, int]]) -> list[np.ndarray]:
    """For each (p, least number of values) the quantile of every frame of ``n`` rows."""
    out = [np.full(len(own), np.nan) for _ in stats]
    for start, values, rows in _merged(own, n):
        stop = min(len(own), start + n)
        if not len(values):
            continue
        seen = _inside(rows, start, stop, n).cumsum(axis=1, dtype=np.int32)  # values of the frame up to each sorted place
        m = seen[:, -1]
        for (p, least), result in zip(stats, out):
            at = (m - 1) * p
            low = np.floor(at).astype(np.int64)
            first = values[np.minimum((seen <= low[:, None]).sum(axis=1), len(values) - 1)]
            second = values[np.minimum((seen <= np.minimum(low + 1, m - 1)[:, None]).sum(axis=1), len(values) - 1)]
            ok = (m >= least) & (np.arange(start, stop) >= least - 1)
            result[start:stop] = np.where(ok, first + (second - first) * (at - low), np.nan)
    return out


def shares(own: np.ndarray, n: int) -> np.ndarray:
    """Share of every frame of ``n`` rows that lies below its last value, ties by half."""
    out = np.full(len(own), np.nan)
    for start, values, rows in _merged(own, n):
        stop = min(len(own), start + n)
        if not len(values):
            continue
        seen = np.concatenate([np.zeros((stop - start, 1), np.int32), _inside(rows, start, stop, n).cumsum(axis=1, dtype=np.int32)], axis=1)
        frame = np.arange(stop - start)
        below = seen[frame, np.searchsorted(values, own[start:stop], "left")]
        upto = seen[frame, np.searchsorted(values, own[start:stop], "right")]
        result = (below + (upto - below + 1) / 2.0) / n
        out[start:stop] = np.where((seen[:, -1] == n) & ~np.isnan(own[start:stop]), result, np.nan)
    return out


def with_order_statistics(df: DataFrame, stats: dict[str, Quantile | Share], keys=("symbol",), ts: str = "ts") -> DataFrame:
    """``df`` with a column for each statistic; frames are rows of a key in ``ts`` order."""
    fields = [f for f in df.schema.fields if f.name not in stats]
    schema = T.StructType(fields + [T.StructField(name, T.DoubleType()) for name in stats])
    groups: dict[tuple[str, int], list[str]] = {}
    for name, stat in stats.items():
        if isinstance(stat, Quantile):
            groups.setdefault((stat.column, stat.n), []).append(name)

    def add(series: pa.Table) -> pa.Table:
        series = series.take(pc.sort_indices(series[ts]))
        values = {c: series[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in {s.column for s in stats.values()}}
        found = {name: shares(values[s.column], s.n) for name, s in stats.items() if isinstance(s, Share)}
        for (column, n), names in groups.items():
            found.update(zip(names, quantiles(values[column], n, [(stats[k].p, stats[k].least or n) for k in names])))
        out = series.select([f.name for f in fields])
        for name in stats:
            out = out.append_column(name, pa.array(found[name], pa.float64(), mask=np.isnan(found[name])))
        return out
    return df.groupBy(*keys).applyInArrow(add, schema)
