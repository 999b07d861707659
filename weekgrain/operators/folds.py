"""Split generators as small tables (fold, role, season[, week]) that are joined to the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekgrain.keys import KEYS, Keys


def numbered_periods(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Calendar of the panel with a running number (one row per period)."""
    return panel.select(*keys.period).distinct().withColumn("t", F.row_number().over(Window.orderBy(*keys.period)))


def numbered_seasons(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    return panel.select(keys.season).distinct().withColumn("s", F.row_number().over(Window.orderBy(keys.season)))


def _roles(calendar: DataFrame, fold, train, test) -> DataFrame:
    """Keeps calendar rows that are in a fold's train or test part. ``fold`` is exploded per row first."""
    df = calendar.withColumn("fold", F.explode(fold))
    return df.withColumn("role", F.when(test, "test").when(train, "train")).where(F.col("role").isNotNull())


def season_holdout(panel: DataFrame, test_seasons: Sequence[int], gap: int = 0, keys: Keys = KEYS) -> DataFrame:
    """One fold: test seasons against all earlier ones, minus a gap before the first test season."""
    first = min(test_seasons)
    s = F.col(keys.season)
    return _roles(numbered_seasons(panel, keys), F.array(F.lit(1)), s < first - gap, s.isin(list(test_seasons))).select("fold", "role", keys.season)


def season_folds(panel: DataFrame, n: int, gap: int = 0, keys: Keys = KEYS) -> DataFrame:
    """The last n seasons in turn as test, all seasons before (less the gap) as train."""
    cal = numbered_seasons(panel, keys)
    top = cal.agg(F.max("s").alias("top"))
    cal = cal.join(F.broadcast(top))  # one row
    test_at = F.col("top") - n + F.col("fold")
    out = _roles(cal, F.sequence(F.lit(1), F.lit(n)), F.col("s") <= test_at - 1 - gap, F.col("s") == test_at)
    usable = out.where(F.col("role") == "train").select("fold").distinct()
    return out.join(usable, "fold", "left_semi").select("fold", "role", keys.season)


def purged_folds(panel: DataFrame, n: int = 5, purge: int = 1, embargo: int = 1, min_share: float = 0.3, keys: Keys = KEYS) -> DataFrame:
    """Growing train windows over weeks; weeks next to the border are purged from train and skipped before test."""
    cal = numbered_periods(panel, keys)
    top = cal.agg(F.max("t").alias("top"))
    cal = cal.join(F.broadcast(top))  # one row
    size = F.floor(F.col("top") / (n + 1))
    end = F.col("fold") * size
    out = _roles(cal, F.sequence(F.lit(1), F.lit(n)), F.col("t") <= end - purge, (F.col("t") > end + embargo) & (F.col("t") <= end + embargo + size))
    return out.where(end >= min_share * F.col("top")).select("fold", "role", *keys.period)


def walk_forward_seasons(panel: DataFrame, train: int, test: int = 1, gap: int = 0, keys: Keys = KEYS) -> DataFrame:
    """Windows of ``train`` seasons, a gap, then ``test`` seasons, sliding by one season."""
    cal = numbered_seasons(panel, keys)
    top = cal.agg(F.max("s").alias("top"))
    cal = cal.join(F.broadcast(top)).where(F.col("top") >= train + gap + test)  # one row
    s, f = F.col("s"), F.col("fold")
    last = F.col("top") - train - gap - test + 1
    return _roles(cal, F.sequence(F.lit(1), last), (s >= f) & (s < f + train), (s >= f + train + gap) & (s < f + train + gap + test)).select("fold", "role", keys.season)


def expanding_weeks(panel: DataFrame, first_test: int, gap: int = 0, window: int | None = None, keys: Keys = KEYS) -> DataFrame:
    """Every period from number ``first_test`` on is a test fold; train is all (or ``window``) periods before the gap."""
    cal = numbered_periods(panel, keys)
    top = cal.agg(F.max("t").alias("top"))
    cal = cal.join(F.broadcast(top))  # one row
    t, f = F.col("t"), F.col("fold")
    train = t < f - gap
    if window:
        train = train & (t >= f - gap - window)
    return _roles(cal, F.sequence(F.lit(first_test), F.col("top")), train, t == f).select("fold", "role", *keys.period)


def with_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows once per fold they belong to."""
    on = [c for c in folds.columns if c not in ("fold", "role")]
    return panel.join(folds, on)
