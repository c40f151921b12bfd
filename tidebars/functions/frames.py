"""Rolling frames over an instrument's bars, and comparisons and divisions in which missing values behave."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def W() -> WindowSpec:  # noqa: N802
    """An instrument's bars in order. A function, since a window needs a session."""
    return Window.partitionBy("code").orderBy("date")


def roll(func, x: Column | str, n: int, m: int | None = None, k: int = 0) -> Column:
    """func of x over the n bars that end k bars ago, null unless m of them (all, if not given) have a value."""
    frame = W().rowsBetween(-(k + n - 1), -k)
    return F.when(F.count(x).over(frame) >= (n if m is None else m), func(x).over(frame))


def back(x: np.ndarray, k: int) -> np.ndarray:
    """The values k bars ago, NaN before there are any."""
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]]) if k else x


def rolling(func: str, x: np.ndarray, n: int, m: int | None = None, k: int = 0) -> np.ndarray:
    """roll over the values of one instrument in order, NaN for null: avg, sum, std (of the whole frame), max or min. Extremes are doubled up to the
    frame, so they take log n steps; sums add a frame's values from the oldest on, all frames at once."""
    known = ~np.isnan(x)
    counts = np.cumsum(known)
    counts = counts - np.concatenate([np.zeros(min(n, len(x)), int), counts[: max(len(x) - n, 0)]])
    if func in ("max", "min"):
        extreme, out, have = (np.fmax if func == "max" else np.fmin), x, 1
        while have < n:
            step = min(have, n - have)
            out, have = extreme(out, back(out, step)), have + step
    else:
        total = lambda parts: sum_up(parts, len(x), n)
        values = np.where(known, x, 0.0)
        out = total(lambda i: values[: len(x) - i])
        if func == "avg":
            out = out / np.where(counts > 0, counts, np.nan)
        if func == "std":  # by distances from the newest value, so that of values that don't change is exactly 0
            away = lambda i: values[: len(x) - i] - values[i:]
            mean = total(away) / n
            out = np.sqrt(total(lambda i: (away(i) - mean[i:]) ** 2) / n)
    return back(np.where(counts >= (n if m is None else m), out, np.nan), k)


def sum_up(parts: Callable[[int], np.ndarray], rows: int, n: int) -> np.ndarray:
    """At each row the sum of parts(n - 1) to parts(0), of which parts(i) belongs to the rows from i on."""
    out = np.zeros(rows)
    for i in range(min(n, rows) - 1, -1, -1):
        out[i:] += parts(i)
    return out


def ago(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(W())


def pdiv(a: Column, b: Column) -> Column:
    """a / b, where division by zero gives a signed infinity, or null for zero by zero."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.when(b != 0, b)


def pct(a: Column, b: Column) -> Column:
    """By how many per cent a is above b."""
    return (over(a, b) - 1) * 100


def yes(condition: Column) -> Column:
    """The condition, false where it is missing."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return yes(condition).cast("int")


BARS_PER_BLOCK = 1000


def ewm_block(alpha: float) -> int:
    """Bars in a block: few enough that (1 - alpha) ** -bars stays finite, and so many that what lies more than a block back
    weighs nothing in a double."""
    fall = -math.log(1 - alpha)
    return max(math.ceil(40 / fall), min(BARS_PER_BLOCK, int(600 / fall)))


def exponential_means(x: np.ndarray, alpha: float, mean: float = 0.0, n: int = 0) -> np.ndarray:
    """The exponential mean as of each of x, after n values whose mean was `mean`; without any it starts at the first of x.

    Within a block it is one running sum of the distances from the mean before, scaled by (1 - alpha) ** -position, times the power
    of the place. So the mean of values that don't change is that value, without an error of rounding."""
    out, step, q = np.empty(len(x)), ewm_block(alpha), 1 - alpha
    if len(x) and not n:
        mean = x[0]
    for low in range(0, len(x), step):
        power = q ** np.arange(1, min(step, len(x) - low) + 1)
        out[low : low + step] = mean + power * alpha * np.cumsum((x[low : low + step] - mean) / power)
        mean = out[min(low + step, len(x)) - 1]
    return out


def with_ewm(df: DataFrame, out: str, x: str, alpha: float, least: int = 1) -> DataFrame:
    """df with the exponential mean of x, started at its first value, null before `least` values.

    Within a block of bars it is one running sum of values scaled by (1 - alpha) ** -position, times the power of the row. A block
    starts its scale anew and carries the end of the block before, so histories of any length are fine. All windows share one order."""
    q, block = 1 - alpha, F.floor((F.col("_bar") - 1) / ewm_block(alpha))
    df = df.withColumn("_bar", F.row_number().over(W())).withColumn("_block", block)
    line, part = Window.partitionBy("code").orderBy("_block", "date"), Window.partitionBy("code", "_block").orderBy("date")
    so_far = Window.unboundedPreceding, 0
    df = df.withColumn("_n", F.count(x).over(line.rowsBetween(*so_far)))
    df = df.withColumn("_local", F.col("_n") - F.first("_n").over(part.rowsBetween(*so_far)))
    value = F.when(F.col("_n") == 1, F.col(x)).otherwise(F.lit(alpha) * F.col(x)) * F.pow(F.lit(q), -F.col("_local"))
    df = df.withColumn("_scaled", F.when(F.col(x).isNotNull(), value))
    df = df.withColumn("_own", F.coalesce(F.sum("_scaled").over(part.rowsBetween(*so_far)) * F.pow(F.lit(q), "_local"), F.lit(0.0)))
    end = F.struct(F.lag("_own").over(line).alias("value"), F.lag("_n").over(line).alias("n"))
    df = df.withColumn("_end", end).withColumn("_end", F.first("_end").over(part.rowsBetween(*so_far)))
    carried = F.coalesce(F.col("_end.value") * F.pow(F.lit(q), F.col("_n") - F.col("_end.n")), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("_n") >= max(1, least), F.col("_own") + carried)).drop("_bar", "_block", "_n", "_local", "_scaled", "_own", "_end")
