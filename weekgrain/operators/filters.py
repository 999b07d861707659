"""Row filters, column guards and small selections."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrain.keys import KEYS, Keys, unique_on


def where_given(df: DataFrame, **equals) -> DataFrame:
    """Equality filters for the arguments that are not None; they reach the scan as pushed filters."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def team_schedule(schedule: DataFrame, team, season=None, week=None) -> DataFrame:
    """Games of one team, at home or away."""
    df = where_given(schedule, season=season, week=week)
    return df if team is None else df.where((F.col("home_team") == team) | (F.col("away_team") == team))


# fixed values: names of final-score columns
SCORE_COLUMNS = ["home_score", "away_score", "home_team_score", "away_team_score", "home_points", "away_points", "home_pts",
                 "away_pts", "points_home", "points_away"]


def without_scores(schedule: DataFrame) -> DataFrame:
    return schedule.drop(*SCORE_COLUMNS)


# fixed values: rules for column names that give the answer away
IDENTIFIERS = {"id", "player_id", "player_name", "name", "gsis_id", "espn_id", "yahoo_id"}
TARGET_PATTERN = re.compile(r"target(_util)?_[0-9]+w|target")
BANNED_PREFIXES = ("predicted_", "projection_", "baseline_", "actual_for_backtest")
FUTURE_TOKENS = ("_future", "_next", "_forward", "_upcoming")
SAFE_PREFIXES = ("sos_next_", "sos_rank_next_", "favorable_matchups_next_", "expected_games_next_", "injury_prob_next_",
                 "injury_risk_score_", "expected_missed_games_")


def is_leaky(column: str, ban_current_usage: bool = True) -> bool:
    """Whether a name marks an identifier, a target, a model output, a backtest artifact or a look ahead."""
    c = column.lower()
    looks_ahead = any(tok in c for tok in FUTURE_TOKENS) and not c.startswith(SAFE_PREFIXES)
    named = c in IDENTIFIERS or (ban_current_usage and c == "utilization_score")
    return named or looks_ahead or c.startswith(BANNED_PREFIXES) or TARGET_PATTERN.fullmatch(c) is not None


def leaky_columns(columns: Iterable[str], **kw) -> list[str]:
    return [c for c in columns if is_leaky(c, **kw)]


def safe_columns(columns: Iterable[str], allow: Iterable[str] = (), **kw) -> list[str]:
    allow = set(allow)
    return [c for c in columns if c in allow or not is_leaky(c, **kw)]


def drop_leaky(df: DataFrame, allow: Iterable[str] = (), **kw) -> DataFrame:
    return df.select(*safe_columns(df.columns, allow, **kw))


def assert_no_leaks(columns: Iterable[str], **kw) -> None:
    found = leaky_columns(columns, **kw)
    if found:
        raise ValueError(f"columns give the target away: {sorted(found)}")


def eligible_seasons(df: DataFrame, lookback: int = 2, keys: Keys = KEYS) -> DataFrame:
    """The last seasons that have rows (a handful of values)."""
    return df.select(keys.season).distinct().orderBy(F.col(keys.season).desc()).limit(lookback)


def active_players(df: DataFrame, lookback: int = 2, keys: Keys = KEYS) -> DataFrame:
    """Rows of players seen in one of the last seasons with data."""
    ids = df.join(eligible_seasons(df, lookback, keys), keys.season, "left_semi").select(keys.entity).distinct()
    return df.join(ids, keys.entity, "left_semi")


def active_with_team(df: DataFrame, min_games: int = 4, lookback: int = 2, keys: Keys = KEYS) -> DataFrame:
    """One row per active player with enough recent games: count and latest team."""
    recent = df.join(eligible_seasons(df, lookback, keys), keys.season, "left_semi")
    return recent.groupBy(keys.entity).agg(
        F.count(F.lit(1)).alias("games"), F.max_by(keys.team, F.struct(keys.season, keys.week)).alias("latest_team")
    ).where(F.col("games") >= min_games)


def name_contains(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    return df.where(F.lower(column).contains(text.strip().lower()))


# fixed values: roster spellings of a schedule code
TEAM_ALIASES = {"NE": ["NEP", "PAT"]}


def teams_playing(games: DataFrame, aliases: Mapping[str, Sequence[str]] = TEAM_ALIASES) -> DataFrame:
    """Distinct upper-case team codes of some games, with their aliases."""
    code = F.upper(F.trim(F.col("team").cast("string")))
    both = games.select(F.explode(F.array("home_team", "away_team")).alias("team")).where(F.col("team").isNotNull()).select(code.alias("code"))
    extra = F.array()
    for k, v in aliases.items():
        extra = F.when(F.col("code") == k, F.array(*[F.lit(a) for a in v])).otherwise(extra.cast("array<string>"))
    return both.select(F.explode(F.concat(F.array("code"), extra)).alias("code")).distinct()


def prediction_view(predictions: DataFrame, season: int, week: int, playing: DataFrame | None, order: str, keys: Keys = KEYS) -> DataFrame:
    """Rows of the target week, of teams that play, one per player: best projection, then a row that has a team."""
    df = predictions.where((F.col(keys.season) == season) & (F.col(keys.week) == week))
    if playing is not None:
        df = (df.withColumn("code", F.upper(F.trim(F.col(keys.team).cast("string")))).join(playing, "code", "left_semi").drop("code"))
    has_team = F.coalesce(F.trim(F.col(keys.team).cast("string")) != "", F.lit(False))
    worst = F.lit(float("inf"))
    return unique_on(df, [keys.entity], [F.coalesce(-F.col(order), worst), ~has_team, F.coalesce(F.col(keys.team).cast("string"), F.lit(""))])


def reproducible_sample(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The n rows with the smallest key hashes: same rows on every run, any partitioning (top-n, no full sort)."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def sample_profile(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint")]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(keys.season).alias("n_seasons"), F.lit(len(numeric)).alias("n_features"))


def trending_lists(predictions: DataFrame, roster: DataFrame, n_hot: int = 5, n_cold: int = 9, n_sleepers: int = 3) -> DataFrame:
    """Hot, cold, sleeper, must-start and sit lists in one frame, from score thresholds.

    ``predictions``: player_id, util, util_high, tier. Ordered tops only; roster lists are whole.
    """
    u = F.col("util")
    top = lambda cond, order, n, name: predictions.where(cond).orderBy(order, "player_id").limit(n).select("player_id", "util", F.lit(name).alias("list"))
    mine = predictions.join(roster, "player_id", "left_semi")
    pick = lambda cond, name: mine.where(cond).select("player_id", "util", F.lit(name).alias("list"))
    lists = [top(u >= 75, u.desc(), n_hot, "hot"),
             top((u < 60) & F.col("tier").isin("moderate", "low"), u.asc(), n_cold, "cold"),
             top(u.between(60, 75) & (F.col("util_high") >= 80), u.desc(), n_sleepers, "sleeper"),
             pick(u >= 85, "must_start"), pick(u < 50, "sit")]
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out
