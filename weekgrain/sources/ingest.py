"""Reading, standardising, validating and writing panel tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrain.functions.order_stats import first_rows, melt, quantiles
from weekgrain.keys import KEYS, Keys, conform, unique_on

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


# --- reading -------------------------------------------------------------------------------
def read_seasons(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, columns: Sequence[str] | None = None,
                 schema: T.StructType | None = None) -> DataFrame:
    """Parquet table by season list; on a season-partitioned table the filter prunes folders."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if seasons is not None:
        df = df.where(F.col("season").isin([int(s) for s in seasons]))
    return df.select(*columns) if columns else df


SCHEDULE_SCHEMA = T.StructType([
    T.StructField("season", T.IntegerType()), T.StructField("week", T.IntegerType()), T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()), T.StructField("game_time", T.StringType()), T.StructField("venue", T.StringType())])


def read_schedule_csv(spark: SparkSession, path: str) -> DataFrame:
    """Schedule CSV with header: season, week and both teams are required, time and venue default to empty."""
    raw = spark.read.option("header", True).csv(path)
    need = {"season", "week", "home_team", "away_team"} - set(raw.columns)
    if need:
        raise ValueError(f"schedule lacks {sorted(need)}")
    df = conform(raw, SCHEDULE_SCHEMA, {"game_time": "", "venue": ""})
    return df.where(F.col("season").isNotNull() & F.col("week").isNotNull() & F.col("home_team").isNotNull() & F.col("away_team").isNotNull())


# fixed values: feed column -> our column
FEED_COLUMNS = {"player_name": "name", "recent_team": "team", "opponent_team": "opponent", "completions": "passing_completions",
                "attempts": "passing_attempts", "carries": "rushing_attempts", "sack_fumbles_lost": "fumbles_lost"}
FUMBLE_COLUMNS = ["fumbles_lost", "rushing_fumbles_lost", "receiving_fumbles_lost"]
COUNT_COLUMNS = ["passing_attempts", "passing_completions", "passing_yards", "passing_tds", "interceptions", "rushing_attempts", "rushing_yards",
                 "rushing_tds", "targets", "receptions", "receiving_yards", "receiving_tds", "fumbles_lost"]


def standardise_weekly(feed: DataFrame, renames: Mapping[str, str] = FEED_COLUMNS, zeros: Sequence[str] = COUNT_COLUMNS) -> DataFrame:
    """Feed names to ours (a present target wins), one fumble total, zero-filled counts, side of the game."""
    have = set(feed.columns)
    df = feed.select([F.col(c).alias(renames[c] if c in renames and renames[c] not in have else c) for c in feed.columns])
    have = set(df.columns)
    fumbles = sum((F.coalesce(F.col(c), F.lit(0)) for c in FUMBLE_COLUMNS if c in have), F.lit(0))
    new = {c: (F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)) for c in zeros if c != "fumbles_lost"}
    new["fumbles_lost"] = fumbles
    side = F.when(F.col("team") == F.col("home_team"), "home").otherwise("away") if "home_team" in have else F.lit("unknown")
    return df.withColumns(new | {"home_away": side}).drop(*FUMBLE_COLUMNS[1:])


# --- validation ----------------------------------------------------------------------------------
class InvalidTable(ValueError):
    """A table breaks a required rule."""


def validate_weekly(df: DataFrame, required: Sequence[str] = ("player_id", "season", "week", "position", "team"), expected: Sequence[str] = (),
                    numeric: Sequence[str] = (), strict: bool = False, keys: Keys = KEYS) -> DataFrame:
    """Findings as rows (level, rule, column, value): schema checks from the schema, the rest from two aggregates."""
    spark, have, kinds = df.sparkSession, set(df.columns), dict(df.dtypes)
    static = [("CRITICAL", "missing_required", c, 1.0) for c in required if c not in have]
    static += [("WARNING", "missing_expected", c, 1.0) for c in expected if c not in have]
    static += [("WARNING", "not_numeric", c, 1.0) for c in numeric if c in have and kinds[c] not in NUMERIC]
    if strict and static and static[0][0] == "CRITICAL":
        raise InvalidTable(f"missing required columns: {[r[2] for r in static if r[0] == 'CRITICAL']}")
    out = spark.createDataFrame(static, "level string, rule string, `column` string, value double")
    checks = []
    finding = lambda rule, col, value, bad: F.when(bad, F.struct(F.lit("WARNING").alias("level"), F.lit(rule).alias("rule"), F.lit(col).alias("column"), value.cast("double").alias("value")))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in ("player_id", "season", "week", "position"):
        if c in have:
            aggs.append(F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}"))
            checks.append(finding("null_rate", c, F.col(f"null_{c}"), F.col(f"null_{c}") > 0.05))
    for c in (keys.season, keys.week):
        if c in have:
            aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    if keys.season in have:
        checks.append(finding("season_range", keys.season, F.col(f"min_{keys.season}"), (F.col(f"min_{keys.season}") < 1999) | (F.col(f"max_{keys.season}") > 2030)))
    if keys.week in have:
        checks.append(finding("week_range", keys.week, F.col(f"max_{keys.week}"), F.col(f"max_{keys.week}") > 22))
    checks.append(finding("empty", "*", F.col("_n"), F.col("_n") == 0))
    one = df.agg(*aggs).select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("f")).select("f.*")
    out = out.unionByName(one)
    if set(keys.grain) <= have:
        dup = df.groupBy(*keys.grain).agg((F.count(F.lit(1)) - 1).alias("_d")).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("_d"))
        out = out.unionByName(dup.where(F.col("_d") > 0).select(F.lit("WARNING").alias("level"), F.lit("duplicate_key").alias("rule"),
                                                               F.lit(",".join(keys.grain)).alias("column"), F.col("_d").cast("double").alias("value")))
    return out


# fixed values: injury statuses and the positions a report should cover
INJURY_STATUSES = ["OUT", "DOUBTFUL", "QUESTIONABLE", "PROBABLE", "IR", "PUP", "SUSPENDED", "NFI"]
REPORT_POSITIONS = ["QB", "RB", "WR", "TE"]


def injury_quality(reports: DataFrame, teams: Sequence | None = None, now: Column | None = None, max_age_hours: int = 48) -> DataFrame:
    """One row: errors, warnings, score 0..100 and valid records.

    Score: 100 - 25 per error - 5 per warning - 2 per missing optional column - 10 times a null share above 10 %.
    """
    have = set(reports.columns)
    need, optional = ["player_name", "status", "team"], ["injury_type", "confidence", "position"]
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    ok_status = F.upper("status").isin(INJURY_STATUSES) if "status" in have else F.lit(True)
    aggs = [F.count(F.lit(1)).alias("record_count")]
    errors, warnings, nulls = F.lit(0), F.lit(0), F.lit(0.0)
    for c in need:
        if c not in have:
            errors = errors + 1
            continue
        aggs.append(F.avg(F.col(c).isNull().cast("int")).alias(f"_null_{c}"))
        errors = errors + flag(F.col(f"_null_{c}") == 1)
        nulls = nulls + F.when(F.col(f"_null_{c}") > 0.1, F.col(f"_null_{c}") * 10).otherwise(0.0)
    if "status" in have:
        aggs.append(F.max((~F.coalesce(ok_status, F.lit(False))).cast("int")).alias("_bad_status"))
        warnings = warnings + F.col("_bad_status")
    if "fetched_at" in have:
        aggs.append(F.min("fetched_at").alias("_oldest"))
        age = (F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("_oldest")) / 3600
        warnings = warnings + flag(age > max_age_hours)
    else:
        warnings = warnings + 1
    if "player_name" in have:
        # duplicates by a keyed aggregate, not a distinct count of everything in one place
        names = reports.groupBy("player_name").agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c").alias("_most"))
        warnings = warnings + flag(F.col("_most") > 1)
    if "position" in have:
        for p in REPORT_POSITIONS:
            aggs.append(F.max((F.col("position") == p).cast("int")).alias(f"_has_{p}"))
            warnings = warnings + F.when(F.coalesce(F.col(f"_has_{p}"), F.lit(0)) == 0, 1).otherwise(0)
    else:
        warnings = warnings + 1
    if teams is not None and "team" in have:
        aggs.append(F.max((~F.coalesce(F.col("team").isin(list(teams)), F.lit(False))).cast("int")).alias("_bad_team"))
        warnings = warnings + F.col("_bad_team")
    valid = ok_status
    for c in ("player_name", "team"):
        if c in have:
            valid = valid & F.col(c).isNotNull()
    aggs.append(F.sum(flag(valid)).alias("valid_record_count"))
    out = reports.agg(*aggs)
    if "player_name" in have:
        out = out.join(F.broadcast(names))  # one row each
    missing = sum(2 for c in optional if c not in have)
    score = 100.0 - errors * 25 - warnings * 5 - missing - nulls
    return out.select("record_count", F.coalesce("valid_record_count", F.lit(0)).alias("valid_record_count"), errors.alias("n_errors"), warnings.alias("n_warnings"),
                      (errors == 0).cast("int").alias("is_valid"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("quality_score"))


def clean_injuries(reports: DataFrame, by: Sequence[str] = ("player_name",)) -> DataFrame:
    """Upper-case status, confidence 0.7 where unknown, the most confident report per player."""
    df = reports.withColumns({"status": F.upper("status"), "confidence": F.coalesce("confidence", F.lit(0.7))})
    rest = [F.col(c) for c in df.columns if c not in by]
    return unique_on(df, list(by), [-F.col("confidence"), *rest])


# fixed values: trust in sources
SOURCE_PRIORITY = {"manual": 3, "nflverse": 2, "espn": 1}


def resolve_sources(reports: DataFrame, by: Sequence[str] = ("player_name",), priority: Mapping[str, int] = SOURCE_PRIORITY) -> DataFrame:
    """One report per player from the most trusted source."""
    from weekgrain.functions.exprs import lookup
    rank = lookup(F.lower("source"), dict(priority), 0)
    rest = [F.col(c) for c in reports.columns if c not in by]
    return unique_on(reports, list(by), [-rank, *rest])


# --- combining feeds ----------------------------------------------------------------------------------
def needs_fallback(weekly: DataFrame, season: int, current_week: int, min_rows: int = 50, keys: Keys = KEYS) -> bool:
    """True when the weekly feed of a season is empty, thin or behind the calendar (one aggregate)."""
    row = weekly.where(F.col(keys.season) == season).agg(F.count(F.lit(1)).alias("n"), F.max(keys.week).alias("w")).first()
    return row["n"] < min_rows or (row["w"] or 0) < current_week


def prefer_first(first: DataFrame, second: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Union of two feeds, the first winning equal keys."""
    both = first.withColumn("_rank", F.lit(1)).unionByName(second.withColumn("_rank", F.lit(2)), allowMissingColumns=True)
    rest = [F.col(c) for c in both.columns if c not in (*keys.grain, "_rank") and dict(both.dtypes)[c] in NUMERIC | {"string"}]
    return unique_on(both, keys.grain, [F.col("_rank"), *rest]).drop("_rank")


def fill_from(base: DataFrame, extra: DataFrame, columns: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """Left join that fills only what is null (or absent) in the base."""
    have = set(base.columns)
    e = extra.groupBy(*keys.grain).agg(*[F.max(c).alias(f"_x_{c}") for c in columns])
    out = base.join(e, keys.grain, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_x_{c}")) if c in have else F.col(f"_x_{c}") for c in columns}).drop(*[f"_x_{c}" for c in columns])


def aligned_union(base: DataFrame, more: DataFrame) -> DataFrame:
    """Adds rows of new seasons, cut to the base's columns; what they lack is null."""
    return base.unionByName(more.select(*[c for c in more.columns if c in base.columns]), allowMissingColumns=True)


def missing_seasons(local: DataFrame, remote: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """(season, local_max_week, remote_max_week, state) for seasons that are absent or behind."""
    top = lambda df, n: df.groupBy(keys.season).agg(F.max(keys.week).alias(n))
    both = top(remote, "remote_max_week").join(top(local, "local_max_week"), keys.season, "left")
    state = F.when(F.col("local_max_week").isNull(), "missing").when(F.col("local_max_week") < F.col("remote_max_week"), "new_weeks")
    return both.withColumn("state", state).where(F.col("state").isNotNull())


# --- writing ---------------------------------------------------------------------------------------------------
def latest(updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order``, and among equals (or without an order) the greatest by its other columns."""
    rest = [c for c in updates.columns if c not in keys and c != order]
    return unique_on(updates, list(keys), [F.struct(*([order] if order else []), *rest)], last=True)


def upserted(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Target with the updates' keys replaced; of several updates for one key the last wins (see :func:`latest`)."""
    return target.join(updates.select(*keys), list(keys), "left_anti").unionByName(latest(updates, keys, order), allowMissingColumns=True)


def inserted(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows whose key the target lacks, one per key."""
    return latest(rows.join(target.select(*keys), list(keys), "left_anti"), keys, order)


def overwrite_partitions(df: DataFrame, path: str, partition: str = "season", files: int = 8) -> None:
    """Replaces only the partitions that occur in ``df``; each is written by up to ``files`` tasks, however many rows it has."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != partition]), F.lit(files))
    (df.repartition(F.col(partition), spread).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], staging: str, partition: str = "season", order: str | None = None) -> None:
    """INSERT OR REPLACE into a partitioned parquet table.

    Touched partitions (a few seasons) are rebuilt from target and updates into a staging folder
    first, because a job cannot overwrite what it reads, then swapped in. Running it twice with the
    same updates gives the same table.
    """
    updates.write.mode("overwrite").parquet(f"{staging}/updates")
    fresh = spark.read.parquet(f"{staging}/updates")
    touched = [r[0] for r in fresh.select(partition).distinct().collect()]
    old = spark.read.parquet(path).where(F.col(partition).isin(touched))
    upserted(old, fresh, keys, order).write.mode("overwrite").parquet(f"{staging}/merged")
    overwrite_partitions(spark.read.parquet(f"{staging}/merged"), path, partition)


def insert_missing(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], partition: str = "season") -> None:
    inserted(spark.read.parquet(path), rows, keys).write.mode("append").partitionBy(partition).parquet(path)


def updated_columns(target: DataFrame, updates: DataFrame, columns: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """Only the named columns of existing keys change; keys the target lacks are ignored."""
    u = updates.groupBy(*keys.grain).agg(*[F.sum(c).alias(f"_u_{c}") for c in columns])
    out = target.join(u, keys.grain, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) for c in columns}).drop(*[f"_u_{c}" for c in columns])


def update_summary(target: DataFrame, updates: DataFrame, dry_run: bool = False, keys: Keys = KEYS) -> DataFrame:
    """Rows seen and rows that would change, per season."""
    u = updates.select(*keys.grain).distinct()
    hit = u.join(target.select(*keys.grain).withColumn("_hit", F.lit(1)), keys.grain, "left")
    changed = F.lit(0) if dry_run else F.sum(F.coalesce("_hit", F.lit(0)))
    return hit.groupBy(keys.season).agg(F.count(F.lit(1)).alias("rows_seen"), changed.alias("rows_updated"))


def replace_season(spark: SparkSession, path: str, rows: DataFrame, season: int, up_to_week: int, staging: str, keys: Keys = KEYS) -> None:
    """Deletes a season up to a week and puts the given rows there; later weeks stay."""
    keep = spark.read.parquet(path).where((F.col(keys.season) == season) & (F.col(keys.week) > up_to_week))
    new = rows.where((F.col(keys.season) == season) & (F.col(keys.week) <= up_to_week))
    keep.unionByName(new, allowMissingColumns=True).write.mode("overwrite").parquet(staging)
    overwrite_partitions(spark.read.parquet(staging), path, keys.season)


def cached_by_season(spark: SparkSession, path: str, seasons: Sequence[int], compute: Callable[[list[int]], DataFrame], rebuild: bool = False) -> DataFrame:
    """Reads cached seasons and computes, writes and reads only those that are not there."""
    have: set[int] = set()
    if not rebuild:
        try:
            have = {r[0] for r in spark.read.parquet(path).select("season").distinct().collect()}
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    todo = [int(s) for s in seasons if s not in have]
    if todo:
        overwrite_partitions(compute(todo), path)
    return read_seasons(spark, path, seasons)


def export_top(predictions: DataFrame, path: str, n: int = 250, order: str = "projection_1w", keys: Keys = KEYS) -> None:
    """JSON snapshot of the n best of every position."""
    top_of_position(predictions, n, order, keys).write.mode("overwrite").partitionBy(keys.group).json(path)


def top_of_position(predictions: DataFrame, n: int, order: str, keys: Keys = KEYS) -> DataFrame:
    return first_rows(predictions, [keys.group], [F.round(order, 9).desc_nulls_last(), F.col(keys.entity)], n).withColumnRenamed("_pos", "place")


# --- reports ---------------------------------------------------------------------------------------------------
def coverage(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    return panel.groupBy(keys.season, keys.group).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(keys.entity).alias("players"), F.countDistinct(keys.week).alias("weeks"))


def missing_pairs(panel: DataFrame, seasons: Sequence[int], positions: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """Expected (season, position) pairs without rows. The grid is written from the two short lists."""
    grid = panel.sparkSession.createDataFrame([(int(s), p) for s in seasons for p in positions], f"{keys.season} int, {keys.group} string")
    return grid.join(panel.select(keys.season, keys.group).distinct(), [keys.season, keys.group], "left_anti")


def season_status(panel: DataFrame, current_season: int, current_week: int, full: int = 18, keys: Keys = KEYS) -> DataFrame:
    w = panel.groupBy(keys.season).agg(F.countDistinct(keys.week).alias("weeks"))
    s = F.col(keys.season)
    state = F.when((s < current_season) & (F.col("weeks") < full), "INCOMPLETE").when((s == current_season) & (F.col("weeks") < current_week), "BEHIND").otherwise("OK")
    return w.withColumn("status", state)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count, column names, types and an order-free hash of all content."""
    cols = sorted(df.columns)
    kinds = dict(df.dtypes)
    h = F.xxhash64(*cols)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_columns"), F.lit(",".join(f"{c}:{kinds[c]}" for c in cols)).alias("schema"),
                  F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def clean_panel(raw: DataFrame, forward: Sequence[str], outliers: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """Unique keys in range, forward-filled within the player, position medians for the rest, rows beyond 3 IQR dropped."""
    numeric = [c for c, t in raw.dtypes if t in NUMERIC and c not in (*keys.grain, keys.team, keys.opponent)]
    rest = [F.col(c) for c in raw.columns if c not in keys.grain]
    df = unique_on(raw, keys.grain, rest).where(F.col(keys.week).between(1, 19) & (F.col(keys.season) >= 2000))
    w = keys.entity_window().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in forward})
    med = quantiles(melt(df, [keys.group], numeric), [keys.group, "component"], "value", {"m": 0.5})
    med = med.groupBy(keys.group).agg(F.map_from_entries(F.collect_list(F.struct("component", "m"))).alias("_med"))
    df = df.join(med, keys.group, "left")
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_med")[c]) for c in numeric}).drop("_med")
    q = quantiles(melt(df, [], outliers), ["component"], "value", {"a": 0.25, "b": 0.75})
    one = q.agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("a", "b")))).alias("_q"))
    df = df.join(F.broadcast(one))  # one row, one entry per column
    keep = F.lit(True)
    for c in outliers:
        lo, hi = F.col("_q")[c]["a"], F.col("_q")[c]["b"]
        keep = keep & F.col(c).between(lo - 3 * (hi - lo), hi + 3 * (hi - lo))
    return df.where(keep).drop("_q")
