"""Forward-looking training targets."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.keys import KEYS, Keys


def horizon_targets(panel: DataFrame, horizons: Sequence[int] = (1, 4, 18), points: str = "fantasy_points",
                    usage: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Sum of points (mean of usage) over the next n rows of the player-season.

    A sum needs 75 % of its rows, a mean 60 %, at least two; one-row targets need that row.
    """
    w = keys.entity_season_window()
    new = {}
    for n in horizons:
        frame = w.rowsBetween(1, n)
        need = lambda share: 1 if n == 1 else max(2, ceil(n * share))
        new[f"target_{n}w"] = F.when(F.count(points).over(frame) >= need(0.75), F.sum(points).over(frame))
        if usage:
            new[f"target_util_{n}w"] = F.when(F.count(usage).over(frame) >= need(0.60), F.avg(usage).over(frame))
    return panel.withColumns(new)


def next_rows_target(panel: DataFrame, n: int, points: str = "fantasy_points", keys: Keys = KEYS) -> DataFrame:
    """Sum of the next n rows of the player across seasons; rows without any are dropped."""
    frame = keys.entity_window().rowsBetween(1, n)
    return panel.withColumn("target", F.sum(points).over(frame)).where(F.col("target").isNotNull())
