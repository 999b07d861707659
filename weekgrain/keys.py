"""Key columns of a panel, and schema conformance."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Keys:
    """Names of the key columns; the panel is unique on (entity, season, week).

    That uniqueness is what makes entity windows safe: a partition holds at most
    one row per period, however many raw records the entity has.
    """

    entity: str = "player_id"
    season: str = "season"
    week: str = "week"
    group: str = "position"
    team: str = "team"
    opponent: str = "opponent"

    @property
    def grain(self) -> list[str]:
        return [self.entity, self.season, self.week]

    @property
    def period(self) -> list[str]:
        return [self.season, self.week]

    @property
    def team_week(self) -> list[str]:
        return [self.team, self.season, self.week]

    def entity_window(self):
        return Window.partitionBy(self.entity).orderBy(self.season, self.week)

    def entity_season_window(self):
        return Window.partitionBy(self.entity, self.season).orderBy(self.week)


KEYS = Keys()


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project onto ``schema``: cast what exists, add what is missing, fill nulls from ``defaults``."""
    defaults = defaults or {}
    present = set(df.columns)

    def column(field: T.StructField) -> Column:
        base = F.col(field.name).cast(field.dataType) if field.name in present else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            base = F.coalesce(base, F.lit(defaults[field.name]).cast(field.dataType))
        return base.alias(field.name)

    return df.select([column(f) for f in schema.fields])


def unique_on(df: DataFrame, keys: list[str], prefer: list[Column], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``prefer``, as an aggregate with map-side combine.

    ``min_by`` over the whole row keeps one candidate per key per task, so a key that
    repeats many times never gathers its copies in one place.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(prefer)])
    picked = df.groupBy(*keys).agg((F.max_by if last else F.min_by)(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(df.columns)


def _base_dir(spark) -> str:
    """The shared folder of the session; a local one only where the master is local and none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")
    return f"{warehouse}-work"


def settled(df: DataFrame) -> DataFrame:
    """Cuts a deep plan at a block boundary with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset, a
    local master checkpoints beside its warehouse and any other master is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_base_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark, name: str) -> str:
    """A fresh folder for written tables, beside the checkpoints (see :func:`settled`)."""
    return f"{_base_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
