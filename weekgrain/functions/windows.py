"""Strictly-prior window expressions over a panel.

All of them share one (partition, order) spec per call site, so Catalyst plans a
single exchange and sort for any number of columns and frames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain.keys import KEYS, Keys

UNB = Window.unboundedPreceding


def prior(window, n: int | None = None):
    """Frame of the n rows before the current one (all of them when n is None)."""
    return window.rowsBetween(UNB if n is None else -n, -1)


def gated(value: Column, count: Column, minimum: int) -> Column:
    return F.when(count >= minimum, value)


def prior_mean(c: str, window, n: int | None = None, minimum: int = 1) -> Column:
    frame = prior(window, n)
    if minimum <= 1:
        return F.avg(c).over(frame)
    return gated(F.avg(c).over(frame), F.count(c).over(frame), minimum)


def prior_sum(c: str, window, n: int | None = None) -> Column:
    return F.sum(c).over(prior(window, n))


def prior_std(c: str, window, n: int | None = None, minimum: int = 2) -> Column:
    frame = prior(window, n)
    return gated(F.stddev_samp(c).over(frame), F.count(c).over(frame), max(minimum, 2))


def prior_slope(c: str, window, row_no: Column, n: int, minimum: int = 2) -> Column:
    """Least-squares slope of the last n values against their position."""
    frame = prior(window, n)
    return gated(F.regr_slope(F.col(c).cast("double"), row_no.cast("double")).over(frame),
                 F.count(c).over(frame), minimum)


def with_prior_ewm(df: DataFrame, columns: Iterable[str], spans: Iterable[int], keys: Keys = KEYS) -> DataFrame:
    """Adds ``{c}_ewm{span}``: recursive exponential means of the earlier rows (nulls decay the old weight).

    A recursion is no window function, and folding every row's whole past costs the square of the
    history. Each entity's rows (at most one per period) are gathered in order once and folded once;
    the state before a row is its feature.
    """
    columns, spans = list(columns), list(spans)
    rest = [c for c in df.columns if c != keys.entity]
    ordered = F.sort_array(F.collect_list(F.struct(keys.season, keys.week, *[c for c in rest if c not in keys.period])))
    rows = df.groupBy(keys.entity).agg(ordered.alias("_rows"))
    none = F.lit(None).cast("double")
    state = lambda m, w: [x for s in spans for x in (m(s).alias(f"m{s}"), w(s).alias(f"w{s}"))]
    seen = lambda acc: F.struct(*[acc[f"m{s}"].alias(f"e{s}") for s in spans])

    def fold(c: str) -> Column:
        def step(acc, row):
            x = row[c].cast("double")

            def mean(s):
                a = 2.0 / (s + 1.0)
                m, w = acc[f"m{s}"], acc[f"w{s}"]
                return F.when(x.isNull(), m).when(m.isNull(), x).otherwise((w * m + a * x) / (w + a))

            def weight(s):
                a = 2.0 / (s + 1.0)
                return F.when(x.isNotNull(), F.lit(1.0 - a)).when(acc[f"m{s}"].isNull(), F.lit(1.0)).otherwise(acc[f"w{s}"] * (1.0 - a))

            return F.struct(*state(mean, weight), F.concat(acc["out"], F.array(seen(acc))).alias("out"))

        empty = F.array().cast("array<struct<" + ",".join(f"e{s}:double" for s in spans) + ">>")
        zero = F.struct(*state(lambda s: none, lambda s: F.lit(1.0)), empty.alias("out"))
        return F.aggregate("_rows", zero, step, lambda acc: acc["out"])

    folded = rows.withColumns({f"_e_{c}": fold(c) for c in columns})
    flat = folded.select(keys.entity, F.explode(F.arrays_zip("_rows", *[f"_e_{c}" for c in columns])).alias("z"))
    return flat.select(*[F.col(c) if c == keys.entity else F.col(f"z._rows.{c}").alias(c) for c in df.columns],
                       *[F.col(f"z._e_{c}.e{s}").alias(f"{c}_ewm{s}") for c in columns for s in spans])


def causal_group_stats(df: DataFrame, columns: Mapping[str, str], groups: list[str], keys: Keys = KEYS,
                       min_mean: int = 1, min_std: int = 2) -> DataFrame:
    """Mean, sample std, min, max and count of columns over all strictly earlier periods of a group.

    ``columns`` maps a column to the prefix of its results. Rows are first reduced to one moment row
    per (group, period); the running window then touches only those, so its size follows the number
    of periods and not the number of rows.
    """
    aggs = []
    for c, p in columns.items():
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{p}_n0"), F.avg(x).alias(f"{p}_a0"), F.var_pop(x).alias(f"{p}_v0"), F.min(x).alias(f"{p}_l0"), F.max(x).alias(f"{p}_h0")]
    per_period = df.groupBy(*groups, *keys.period).agg(*aggs)
    # without a group the table has one row per period of the calendar
    whole = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*keys.period)
    w = prior(whole)
    # moments about the group's first mean, so that a large common level does not cancel digits
    around = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifted = per_period.withColumns({f"{p}_c": F.first(f"{p}_a0", ignorenulls=True).over(around) for p in columns.values()})
    run = {}
    for p in columns.values():
        n0, d = F.col(f"{p}_n0"), F.col(f"{p}_a0") - F.col(f"{p}_c")
        run |= {f"{p}_n": F.coalesce(F.sum(n0).over(w), F.lit(0)), f"{p}_s1": F.sum(n0 * d).over(w), f"{p}_q1": F.sum(n0 * (F.col(f"{p}_v0") + d * d)).over(w),
                f"{p}_c1": F.col(f"{p}_c"), f"{p}_min": F.min(f"{p}_l0").over(w), f"{p}_max": F.max(f"{p}_h0").over(w)}
    out = shifted.select(*groups, *keys.period, *[c.alias(n) for n, c in run.items()])
    cols = []
    for p in columns.values():
        n, s, q = F.col(f"{p}_n"), F.col(f"{p}_s1"), F.col(f"{p}_q1")
        var = F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))
        cols += [f"{p}_n", f"{p}_min", f"{p}_max", F.when(n >= min_mean, F.col(f"{p}_c1") + s / n).alias(f"{p}_mean"), F.when(n >= min_std, F.sqrt(var)).alias(f"{p}_std")]
    return out.select(*groups, *keys.period, *cols)


def with_causal_stats(df: DataFrame, columns: Mapping[str, str], groups: list[str], keys: Keys = KEYS, **kw) -> DataFrame:
    """Joins :func:`causal_group_stats` back on (group, period)."""
    return df.join(causal_group_stats(df, columns, groups, keys, **kw), [*groups, *keys.period], "left")
