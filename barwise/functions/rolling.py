"""Rolling windows with pandas' counting rule.

A rolling statistic of ``n`` rows is null unless all ``n`` rows of the frame
hold a value.  Frames are ROWS frames that end at or before the current row.
All helpers of one ``Rolling`` share partitioning and order, so Spark sorts and
shuffles once however many statistics are asked for.

One partition holds one series.  A series has at most one row per session
(the duplicate rule in ``operators.validation`` enforces it), which bounds its
length by the session calendar; ``split_history`` cuts series that are longer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.normal import let

TRADING_DAYS = 252


def safe_div(a, b) -> Column:
    """a / b, null when b is zero or either side is null."""
    return F.try_divide(_c(a), _c(b))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def clip(x, low=None, high=None) -> Column:
    """Bounded value; unlike greatest/least a null stays null."""
    x = _c(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


@dataclass(frozen=True)
class Rolling:
    """Window builder for one series layout: ``keys`` identify it, ``ts`` orders it."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"

    @property
    def order(self):
        return Window.partitionBy(*self.keys).orderBy(self.ts)

    def rows(self, n: int, back: int = 0):
        return self.order.rowsBetween(-(n - 1) - back, -back)

    @property
    def so_far(self):
        return self.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(_c(x), n).over(self.order)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(_c(x), n).over(self.order)

    def pct_change(self, x, n: int = 1) -> Column:
        return safe_div(_c(x), self.lag(x, n)) - F.lit(1.0)

    def stat(self, fn, x, n: int, back: int = 0, min_obs: int | None = None) -> Column:
        w = self.rows(n, back)
        seen = F.count(_c(x)).over(w)
        ready = seen == n if min_obs is None else seen >= min_obs
        return F.when(ready, fn(_c(x)).over(w))

    def mean(self, x, n, back=0):
        return self.stat(F.avg, x, n, back)

    def total(self, x, n, back=0):
        return self.stat(F.sum, x, n, back)

    def sd(self, x, n, back=0):
        return self.stat(F.stddev_samp, x, n, back)

    def var(self, x, n, back=0):
        return self.stat(F.var_samp, x, n, back)

    def high(self, x, n, back=0):
        return self.stat(F.max, x, n, back)

    def low(self, x, n, back=0):
        return self.stat(F.min, x, n, back)

    def zscore(self, x, n) -> Column:
        return safe_div(_c(x) - self.mean(x, n), self.sd(x, n))

    def quantile(self, x, p: float, n: int, min_obs: int | None = None) -> Column:
        """Linear-interpolated quantile of the frame.

        Sorting the frame's collected values is several times faster than the
        percentile aggregate, which rebuilds a hash map for every row.
        """
        def pick(v):
            at = (F.size(v) - 1) * F.lit(p)
            low = F.floor(at).cast("int")
            first = F.get(v, low)
            return first + (F.coalesce(F.get(v, low + 1), first) - first) * (at - low)
        return let(F.sort_array(self.stat(F.collect_list, x, n, 0, min_obs)), pick)

    def _pairs(self, x, y, n):
        both = _c(x).isNotNull() & _c(y).isNotNull()
        return F.count(F.when(both, F.lit(1))).over(self.rows(n)) == n

    def corr(self, x, y, n) -> Column:
        w = self.rows(n)
        # Built from covariance: the corr function divides by zero on a flat frame in ANSI mode.
        spread = F.stddev_samp(_c(x)).over(w) * F.stddev_samp(_c(y)).over(w)
        return F.when(self._pairs(x, y, n), safe_div(F.covar_samp(_c(x), _c(y)).over(w), spread))

    def cov(self, x, y, n) -> Column:
        return F.when(self._pairs(x, y, n), F.covar_samp(_c(x), _c(y)).over(self.rows(n)))

    def skew(self, x, n) -> Column:
        """Bias-corrected sample skewness; null on a flat frame."""
        return self.stat(F.skewness, x, n) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))

    def kurt(self, x, n) -> Column:
        """Bias-corrected excess kurtosis; null on a flat frame."""
        return (self.stat(F.kurtosis, x, n) * F.lit(n + 1.0) + F.lit(6.0)) * F.lit((n - 1) / ((n - 2) * (n - 3)))


def split_history(bars: DataFrame, head_rows: int, rows_per_chunk: int,
                  keys=("symbol",), ts: str = "ts", bucket: str = "month") -> DataFrame:
    """Cut each series into chunks that carry the ``head_rows`` rows before them.

    Row numbers come from per-bucket counts plus an in-bucket number, so no task
    ever sorts a whole series.  Add ``chunk`` to the keys of a ``Rolling`` whose
    frames reach back at most ``head_rows`` rows, then keep ``~is_head`` rows.
    """
    if head_rows >= rows_per_chunk:
        raise ValueError("head_rows must be smaller than rows_per_chunk")
    numbered = global_row_number(bars, keys, ts, F.date_trunc(bucket, F.col(ts)))
    own = F.floor((F.col("row_no") - 1) / rows_per_chunk)
    reaches_next = (F.col("row_no") - 1) % rows_per_chunk >= rows_per_chunk - head_rows
    copies = F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own))
    return (numbered.withColumn("own_chunk", own)
            .withColumn("chunk", F.explode(copies))
            .withColumn("is_head", F.col("chunk") != F.col("own_chunk"))
            .drop("own_chunk"))


def global_row_number(df: DataFrame, keys, ts: str, bucket: Column, name: str = "row_no",
                      tie: tuple[str, ...] = ()) -> DataFrame:
    """Exact row number per key in ``ts`` order without one task per key.

    ``bucket`` must not decrease with ``ts``.  Counts per (key, bucket) are
    prefix-summed (one small row per bucket) and added to the in-bucket number.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie)
    return (tagged.withColumn("_in", F.row_number().over(inside))
            .join(starts, [*keys, "_bucket"])
            .withColumn(name, F.col("_start") + F.col("_in"))
            .drop("_bucket", "_in", "_start"))
