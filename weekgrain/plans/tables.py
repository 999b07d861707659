"""The panel, plays and side tables derived from the given star schema.

Entity = supplier, season/week = ship year/month, team = 25 groups of suppliers.
Every derivation is written once as a DataFrame and once as SQL text for the
side-by-side check. Raw rows are reduced with map-side aggregation before any
window sees them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.keys import shared_dir

POSITION = ["QB", "RB", "WR", "TE"]


def zoned(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def _count(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


def _sum(cond, value="l_quantity"):
    return F.sum(F.when(cond, F.col(value)).otherwise(0.0))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def panel(self) -> DataFrame:
        """One row per (player_id, season, week)."""
        q = F.col("l_quantity")
        is_r, is_a, is_f = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
        weekly = self.raw("lineitem").groupBy(
            F.col("l_suppkey").alias("player_id"),
            F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"),
        ).agg(
            F.count(F.lit(1)).alias("targets"),
            _count(is_r).alias("rushing_attempts"), _count(is_f).alias("receptions"),
            _count(is_a).alias("passing_attempts"), _count(is_a & is_f).alias("completions"),
            _sum(is_r).alias("rushing_yards"), _sum(is_f).alias("receiving_yards"), _sum(is_a).alias("passing_yards"),
            _sum(F.col("l_discount") > 0.05).alias("air_yards"),
            _count(is_r & (q >= 40)).alias("rushing_tds"), _count(is_f & (q >= 40)).alias("receiving_tds"),
            _count(is_a & (q >= 40)).alias("passing_tds"),
            _count(is_a & (F.col("l_discount") < 0.015)).alias("interceptions"),
            _count(is_r & (q <= 10)).alias("rush_inside_10"), _count(is_f & (q >= 15)).alias("targets_15_plus"),
            _count(is_f & (q <= 8)).alias("redzone_targets"),
            F.sum(F.col("l_linenumber").cast("long")).alias("snap_count"),
            F.sum("l_quantity").alias("_qty"),
        )
        pid, wk = F.col("player_id"), F.col("week")
        return weekly.select(
            "player_id", "season", "week",
            F.element_at(F.array(*[F.lit(p) for p in POSITION]), (pid % 4 + 1).cast("int")).alias("position"),
            (pid % 25).cast("int").alias("team"),
            ((pid % 25 + wk) % 25).cast("int").alias("opponent"),
            F.format_string("Player Number %d", pid).alias("name"),
            F.when((pid + wk) % 2 == 0, "home").otherwise("away").alias("home_away"),
            *[c for c in weekly.columns if c not in ("player_id", "season", "week", "_qty")],
            (0.1 * F.col("_qty") + 6 * F.col("rushing_attempts") - 2 * F.col("receptions")).alias("fantasy_points"),
        )

    @cached_property
    def plays(self) -> DataFrame:
        """One row per play with the columns of a play-by-play feed."""
        return self.as_plays(self.raw("lineitem"))

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream; event times need a zone, so zoneless ones take the session's."""
        schema = self.raw(name).schema
        df = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
        return zoned(df)

    def arrivals(self, df: DataFrame, name: str, time: str, files: int = 8) -> DataFrame:
        """The rows as a stream of ``files`` batches roughly in order of time, of which every tenth row comes three batches later than it should."""
        root = shared_dir(self.spark, name)
        ends = df.agg(F.min(F.unix_seconds(F.col(time).cast("timestamp"))).alias("a"), F.max(F.unix_seconds(F.col(time).cast("timestamp"))).alias("b")).first()
        width = max(1, ((ends["b"] or 0) - (ends["a"] or 0)) // files + 1)
        due = F.floor((F.unix_seconds(F.col(time).cast("timestamp")) - F.lit(ends["a"] or 0)) / width)
        held = F.when(F.pmod(F.xxhash64(*df.columns), F.lit(10)) == 0, 3).otherwise(0)
        df.withColumn("arrival", F.least(F.coalesce(due + held, F.lit(0)), F.lit(files - 1)).cast("int")).write.partitionBy("arrival").parquet(root)
        count = len(self.spark.read.parquet(root).inputFiles())
        return self.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-count // files))).parquet(root).select(df.columns)

    @staticmethod
    def as_plays(li: DataFrame, *more: str) -> DataFrame:
        sup, part, order, ln = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
        flag = F.col("l_returnflag")
        kind = (F.when(flag == "A", "pass").when(flag == "N", "run")
                .otherwise(F.when(F.col("l_linestatus") == "F", "field_goal").otherwise("extra_point")))
        is_pass, is_run = flag == "A", flag == "N"
        season, week = F.year("l_shipdate"), F.month("l_shipdate")
        name = lambda who: F.concat(F.lit("P"), who.cast("string"))
        return li.select(
            *more, season.alias("season"), week.alias("week"),
            ((sup % 25) * 100 + (part % 25)).alias("game_id"), order.alias("play_id"),
            (ln % 4 + 1).alias("qtr"), (F.col("l_quantity").cast("int") % 4 + 1).alias("down"),
            kind.alias("play_type"), (sup % 25).alias("posteam"), (part % 25).alias("defteam"),
            F.when(is_pass, sup).alias("passer_player_id"), F.when(is_pass, name(sup)).alias("passer_player_name"),
            F.when(is_run, sup).alias("rusher_player_id"), F.when(is_run, name(sup)).alias("rusher_player_name"),
            F.when(is_pass & (ln < 7), part % 500).alias("receiver_player_id"),
            F.when(is_pass & (ln < 7), name(part % 500)).alias("receiver_player_name"),
            F.when(~is_pass & ~is_run, sup).alias("kicker_player_id"),
            F.when(~is_pass & ~is_run, name(sup)).alias("kicker_player_name"),
            F.when(is_pass, F.col("l_quantity")).alias("passing_yards"),
            F.when(is_pass & (ln < 7), F.col("l_quantity")).alias("receiving_yards"),
            F.when(is_run, F.col("l_quantity")).alias("rushing_yards"),
            F.when(is_pass & (ln != 5), F.col("l_quantity") - 10).alias("air_yards"),
            (is_pass & (F.col("l_linestatus") == "F")).cast("int").alias("complete_pass"),
            (is_pass & (F.col("l_quantity") >= 45)).cast("int").alias("pass_touchdown"),
            (is_run & (F.col("l_quantity") >= 45)).cast("int").alias("rush_touchdown"),
            (is_pass & (F.col("l_tax") < 0.005)).cast("int").alias("interception"),
            (is_run & (F.col("l_tax") < 0.005)).cast("int").alias("fumble_lost"),
            (is_pass & (F.col("l_tax") > 0.075)).cast("int").alias("sack"),
            (F.col("l_quantity") == 50).cast("int").alias("touchdown"),
            ((part + sup) % 97 == 0).cast("int").alias("safety"),
            F.when(part % 2 == 0, part % 25).otherwise(sup % 25).alias("td_team"),
            ((F.col("l_quantity") == 50) & (ln == 7)).cast("int").alias("return_touchdown"),
            (is_pass & (ln == 6)).cast("int").alias("qb_spike"), (is_run & (ln == 6)).cast("int").alias("qb_kneel"),
            F.when(ln != 7, (F.col("l_tax") * 100 - 4)).alias("epa"), (F.col("l_discount") - 0.05).alias("wpa"),
            F.when(ln != 7, (F.col("l_tax") > 0.04).cast("int")).alias("success"),
            F.when(part % 10 != 0, F.col("l_discount") * 10).alias("wp"),
            (order % 41 - 20).cast("double").alias("score_differential"),
            (part % 12).cast("double").alias("ydstogo"), (part % 100).cast("double").alias("yardline_100"),
            ((order * 7) % 3600).alias("game_seconds_remaining"), ((order * 7) % 1800).alias("half_seconds_remaining"),
            (order % 12).alias("drive"),
            F.element_at(F.array(*[F.lit(x) for x in ("Touchdown", "Field goal", "Punt", "Safety", "End of half")]),
                         (order % 5 + 1).cast("int")).alias("drive_result"),
            F.when(kind == "field_goal", F.when(ln <= 5, "made").when(ln == 6, "missed").otherwise("blocked")).alias("field_goal_result"),
            F.when(kind == "extra_point", F.when(ln <= 6, "good").otherwise("failed")).alias("extra_point_result"),
            F.when(kind == "field_goal", F.col("l_quantity") + 10).alias("kick_distance"),
            (order % 45).alias("posteam_score_post"), F.col("l_shipdate").alias("ts"),
        )

    @cached_property
    def team_week(self) -> DataFrame:
        """One row per (team, season, week), aggregated from the panel."""
        return self.panel.groupBy("team", "season", "week").agg(
            F.min("opponent").alias("opponent"),
            F.sum("fantasy_points").alias("points_scored"),
            F.sum("passing_yards").alias("passing_yards"), F.sum("rushing_yards").alias("rushing_yards"),
            F.sum("interceptions").alias("turnovers"),
            F.sum("passing_attempts").alias("pass_attempts"), F.sum("rushing_attempts").alias("rush_attempts"),
            (F.sum("passing_yards") + F.sum("rushing_yards")).alias("total_yards"),
            F.sum("receiving_yards").alias("points_allowed"),
        )

    @cached_property
    def schedule(self) -> DataFrame:
        """One row per game (season, week, home_team, away_team) with lines and weather."""
        s, w, h = F.col("season"), F.col("week"), F.col("home_team")
        games = self.panel.groupBy("season", "week", F.col("team").alias("home_team")).agg(
            F.min("opponent").alias("away_team"))
        return games.select(
            "season", "week", "home_team", "away_team",
            ((h + w) % 3 == 0).cast("int").alias("div_game"),
            F.when((h + w) % 5 == 0, "Thursday").when((h + w) % 5 == 1, "Monday").otherwise("Sunday").alias("weekday"),
            F.when((h + s) % 4 == 0, "20:15").otherwise("13:00").alias("gametime"),
            (((h * 3 + w) % 29) / 2.0 - 7.0).alias("spread_line"),
            (40.0 + (h + w * 2) % 15).alias("total_line"),
            F.when((h + w) % 7 != 0, (20 + (h * 5 + w * 3) % 60).cast("double")).alias("temp"),
            ((h * 2 + w) % 28).cast("double").alias("wind"),
            F.when((h + w) % 6 == 0, "Light Rain").when((h + w) % 11 == 0, "Snow showers").otherwise("Clear").alias("weather"),
        )

    @cached_property
    def drafted(self) -> DataFrame:
        """Draft and combine record per player (supplier)."""
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("player_id"), F.format_string("Player Number %d", k).alias("player_name"),
            F.element_at(F.array(*[F.lit(p) for p in POSITION]), (k % 4 + 1).cast("int")).alias("position"),
            (k % 7 + 1).cast("int").alias("draft_round"), ((k * 37) % 260 + 1).cast("int").alias("draft_pick"),
            (1990 + k % 12).cast("int").alias("draft_season"),
            (4.3 + (k % 60) / 100.0).alias("forty"), F.when(k % 5 != 0, (k % 22 + 6).cast("double")).alias("bench"),
            (28.0 + k % 14).alias("vertical"), F.when(k % 7 != 0, (102 + k % 30).cast("double")).alias("broad"),
            (6.6 + (k % 90) / 100.0).alias("cone"),
            (21 + k % 20).cast("int").alias("age"),
        )

    @cached_property
    def injuries(self) -> DataFrame:
        """Injury reports, one per return-flagged order line of a player-week, from several feeds."""
        li = self.raw("lineitem").where(F.col("l_returnflag") == "R")
        o = F.col("l_orderkey")
        pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
        return li.select(
            F.when(o % 50 != 0, F.col("l_suppkey")).alias("player_id"),
            F.format_string("Player Number %d", F.col("l_suppkey")).alias("player_name"),
            F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"),
            pick(["out", "Questionable", "doubtful", "PROBABLE", "ir", "Limping"], o).alias("status"),
            pick(["Hamstring strain", "ankle", "Knee", "concussion", "back spasm", "wrist"], F.col("l_partkey")).alias("injury_type"),
            F.when(o % 3 != 0, F.col("l_discount") * 10).alias("confidence"),
            pick(["espn", "manual", "nflverse"], o).alias("source"),
            pick(["QB", "RB", "WR", "TE", "XX"], F.col("l_suppkey")).alias("position"),
            F.col("l_linenumber").alias("games_missed"),
            F.col("l_extendedprice").alias("report_id"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Panel rows with a prior rolling-3 prediction and prior rolling std, where both exist."""
        from weekgrain.functions.windows import prior_mean, prior_std
        from weekgrain.keys import KEYS
        w = KEYS.entity_window()
        return self.panel.select(
            "player_id", "name", "season", "week", "position", "team", "opponent", "fantasy_points",
            prior_mean("fantasy_points", w, 3).alias("predicted_points"),
            prior_std("fantasy_points", w, 8).alias("predicted_std"),
        ).where(F.col("predicted_std").isNotNull())


class _Sql:
    """SQL text of the same derivations."""

    texts = {
        "panel": """
 pw AS (SELECT l_suppkey AS player_id, CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS "week",
  count(*) AS targets,
  count(*) FILTER (l_returnflag='R') AS rushing_attempts, count(*) FILTER (l_linestatus='F') AS receptions,
  count(*) FILTER (l_returnflag='A') AS passing_attempts,
  count(*) FILTER (l_returnflag='A' AND l_linestatus='F') AS completions,
  coalesce(sum(l_quantity) FILTER (l_returnflag='R'),0.0) AS rushing_yards,
  coalesce(sum(l_quantity) FILTER (l_linestatus='F'),0.0) AS receiving_yards,
  coalesce(sum(l_quantity) FILTER (l_returnflag='A'),0.0) AS passing_yards,
  coalesce(sum(l_quantity) FILTER (l_discount>CAST(0.05 AS DOUBLE)),0.0) AS air_yards,
  count(*) FILTER (l_returnflag='R' AND l_quantity>=40) AS rushing_tds,
  count(*) FILTER (l_linestatus='F' AND l_quantity>=40) AS receiving_tds,
  count(*) FILTER (l_returnflag='A' AND l_quantity>=40) AS passing_tds,
  count(*) FILTER (l_returnflag='A' AND l_discount<0.015) AS interceptions,
  count(*) FILTER (l_returnflag='R' AND l_quantity<=10) AS rush_inside_10,
  count(*) FILTER (l_linestatus='F' AND l_quantity>=15) AS targets_15_plus,
  count(*) FILTER (l_linestatus='F' AND l_quantity<=8) AS redzone_targets,
  CAST(sum(l_linenumber) AS BIGINT) AS snap_count, sum(l_quantity) AS qty
  FROM lineitem GROUP BY ALL),
 panel AS (SELECT player_id, season, "week", (['QB','RB','WR','TE'])[player_id % 4 + 1] AS "position",
  CAST(player_id % 25 AS INT) AS team, CAST((player_id % 25 + "week") % 25 AS INT) AS opponent,
  'Player Number ' || player_id AS name,
  CASE WHEN (player_id + "week") % 2 = 0 THEN 'home' ELSE 'away' END AS home_away,
  targets, rushing_attempts, receptions, passing_attempts, completions, rushing_yards, receiving_yards, passing_yards,
  air_yards, rushing_tds, receiving_tds, passing_tds, interceptions, rush_inside_10, targets_15_plus, redzone_targets,
  snap_count, CAST(0.1 AS DOUBLE) * qty + 6 * rushing_attempts - 2 * receptions AS fantasy_points FROM pw)""",
        "plays": """
 plays AS (SELECT CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS "week",
  (l_suppkey % 25) * 100 + (l_partkey % 25) AS game_id, l_orderkey AS play_id,
  l_linenumber % 4 + 1 AS qtr, CAST(l_quantity AS INT) % 4 + 1 AS down,
  CASE WHEN l_returnflag='A' THEN 'pass' WHEN l_returnflag='N' THEN 'run' WHEN l_linestatus='F' THEN 'field_goal' ELSE 'extra_point' END AS play_type,
  l_suppkey % 25 AS posteam, l_partkey % 25 AS defteam,
  CASE WHEN l_returnflag='A' THEN l_suppkey END AS passer_player_id,
  CASE WHEN l_returnflag='N' THEN l_suppkey END AS rusher_player_id,
  CASE WHEN l_returnflag='A' AND l_linenumber<7 THEN l_partkey % 500 END AS receiver_player_id,
  CASE WHEN l_returnflag='R' THEN l_suppkey END AS kicker_player_id,
  CASE WHEN l_returnflag='A' THEN l_quantity END AS passing_yards,
  CASE WHEN l_returnflag='A' AND l_linenumber<7 THEN l_quantity END AS receiving_yards,
  CASE WHEN l_returnflag='N' THEN l_quantity END AS rushing_yards,
  CASE WHEN l_returnflag='A' AND l_linenumber<>5 THEN l_quantity-10 END AS air_yards,
  CAST(l_returnflag='A' AND l_linestatus='F' AS INT) AS complete_pass,
  CAST(l_returnflag='A' AND l_quantity>=45 AS INT) AS pass_touchdown,
  CAST(l_returnflag='N' AND l_quantity>=45 AS INT) AS rush_touchdown,
  CAST(l_returnflag='A' AND l_tax<0.005 AS INT) AS interception,
  CAST(l_returnflag='N' AND l_tax<0.005 AS INT) AS fumble_lost,
  CAST(l_returnflag='A' AND l_tax>0.075 AS INT) AS sack,
  CAST(l_quantity=50 AS INT) AS touchdown, CAST((l_partkey+l_suppkey) % 97 = 0 AS INT) AS safety,
  CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 25 ELSE l_suppkey % 25 END AS td_team,
  CAST(l_quantity=50 AND l_linenumber=7 AS INT) AS return_touchdown,
  CAST(l_returnflag='A' AND l_linenumber=6 AS INT) AS qb_spike, CAST(l_returnflag='N' AND l_linenumber=6 AS INT) AS qb_kneel,
  CASE WHEN l_linenumber<>7 THEN l_tax*100-4 END AS epa, l_discount-CAST(0.05 AS DOUBLE) AS wpa,
  CASE WHEN l_linenumber<>7 THEN CAST(l_tax>CAST(0.04 AS DOUBLE) AS INT) END AS success,
  CASE WHEN l_partkey % 10 <> 0 THEN l_discount*10 END AS wp,
  CAST(l_orderkey % 41 - 20 AS DOUBLE) AS score_differential, CAST(l_partkey % 12 AS DOUBLE) AS ydstogo,
  CAST(l_partkey % 100 AS DOUBLE) AS yardline_100,
  (l_orderkey*7) % 3600 AS game_seconds_remaining, (l_orderkey*7) % 1800 AS half_seconds_remaining,
  l_orderkey % 12 AS drive,
  (['Touchdown','Field goal','Punt','Safety','End of half'])[l_orderkey % 5 + 1] AS drive_result,
  CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN CASE WHEN l_linenumber<=5 THEN 'made' WHEN l_linenumber=6 THEN 'missed' ELSE 'blocked' END END AS field_goal_result,
  CASE WHEN l_returnflag='R' AND l_linestatus<>'F' THEN CASE WHEN l_linenumber<=6 THEN 'good' ELSE 'failed' END END AS extra_point_result,
  CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN l_quantity+10 END AS kick_distance,
  l_orderkey % 45 AS posteam_score_post FROM lineitem)""",
        "flagged": """
 flagged AS (SELECT *, coalesce(epa,0) AS epa0,
  CAST(abs(score_differential)<=7 AND qtr<=3 AS INT) AS is_neutral, CAST(ydstogo<=2 AS INT) AS is_short_yardage,
  CAST(yardline_100<=20 AS INT) AS is_redzone, CAST(yardline_100<=5 AS INT) AS is_goal_line,
  CAST(down=3 AS INT) AS is_third_down, CAST(qtr IN (2,4) AND half_seconds_remaining<=120 AS INT) AS is_two_minute,
  CAST(CASE WHEN wp IS NOT NULL THEN wp>=CAST(0.2 AS DOUBLE) AND wp<=CAST(0.8 AS DOUBLE)
       ELSE abs(score_differential)<=7 AND qtr>=4 END AS INT) AS is_high_leverage FROM plays)""",
        "team_week": """
 team_week AS (SELECT team, season, "week", min(opponent) AS opponent, sum(fantasy_points) AS points_scored,
  sum(passing_yards) AS passing_yards, sum(rushing_yards) AS rushing_yards, CAST(sum(interceptions) AS BIGINT) AS turnovers,
  CAST(sum(passing_attempts) AS BIGINT) AS pass_attempts, CAST(sum(rushing_attempts) AS BIGINT) AS rush_attempts,
  sum(passing_yards)+sum(rushing_yards) AS total_yards, sum(receiving_yards) AS points_allowed
  FROM panel GROUP BY ALL)""",
        "schedule": """
 games AS (SELECT season, "week", team AS home_team, min(opponent) AS away_team FROM panel GROUP BY ALL),
 schedule AS (SELECT season, "week", home_team, away_team, CAST((home_team+"week")%3=0 AS INT) AS div_game,
  CASE (home_team+"week")%5 WHEN 0 THEN 'Thursday' WHEN 1 THEN 'Monday' ELSE 'Sunday' END AS weekday,
  CASE WHEN (home_team+season)%4=0 THEN '20:15' ELSE '13:00' END AS gametime,
  ((home_team*3+"week")%29)/2.0-7.0 AS spread_line, CAST(40+(home_team+"week"*2)%15 AS DOUBLE) AS total_line,
  CASE WHEN (home_team+"week")%7<>0 THEN CAST(20+(home_team*5+"week"*3)%60 AS DOUBLE) END AS temp,
  CAST((home_team*2+"week")%28 AS DOUBLE) AS wind,
  CASE WHEN (home_team+"week")%6=0 THEN 'Light Rain' WHEN (home_team+"week")%11=0 THEN 'Snow showers' ELSE 'Clear' END AS weather
  FROM games)""",
        "drafted": """
 drafted AS (SELECT s_suppkey AS player_id, 'Player Number '||s_suppkey AS player_name,
  (['QB','RB','WR','TE'])[s_suppkey%4+1] AS "position", CAST(s_suppkey%7+1 AS INT) AS draft_round,
  CAST((s_suppkey*37)%260+1 AS INT) AS draft_pick, CAST(1990+s_suppkey%12 AS INT) AS draft_season,
  CAST(4.3 AS DOUBLE)+(s_suppkey%60)/CAST(100.0 AS DOUBLE) AS forty, CASE WHEN s_suppkey%5<>0 THEN CAST(s_suppkey%22+6 AS DOUBLE) END AS bench,
  CAST(28+s_suppkey%14 AS DOUBLE) AS vertical, CASE WHEN s_suppkey%7<>0 THEN CAST(102+s_suppkey%30 AS DOUBLE) END AS broad,
  CAST(6.6 AS DOUBLE)+(s_suppkey%90)/CAST(100.0 AS DOUBLE) AS cone, CAST(21+s_suppkey%20 AS INT) AS age FROM supplier)""",
        "injuries": """
 injuries AS (SELECT CASE WHEN l_orderkey%50<>0 THEN l_suppkey END AS player_id, 'Player Number '||l_suppkey AS player_name,
  CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS "week",
  (['out','Questionable','doubtful','PROBABLE','ir','Limping'])[l_orderkey%6+1] AS status,
  (['Hamstring strain','ankle','Knee','concussion','back spasm','wrist'])[l_partkey%6+1] AS injury_type,
  CASE WHEN l_orderkey%3<>0 THEN l_discount*10 END AS confidence, (['espn','manual','nflverse'])[l_orderkey%3+1] AS source,
  (['QB','RB','WR','TE','XX'])[l_suppkey%5+1] AS "position", l_linenumber AS games_missed, l_extendedprice AS report_id
  FROM lineitem WHERE l_returnflag='R')""",
        "preds": """
 pr0 AS (SELECT player_id, name, season, "week", "position", team, opponent, fantasy_points,
  avg(fantasy_points) OVER (PARTITION BY player_id ORDER BY season, "week" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS predicted_points,
  count(fantasy_points) OVER (PARTITION BY player_id ORDER BY season, "week" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS c8,
  stddev_samp(fantasy_points) OVER (PARTITION BY player_id ORDER BY season, "week" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS sd8 FROM panel),
 preds AS (SELECT * EXCLUDE (c8, sd8), sd8 AS predicted_std FROM pr0 WHERE c8>=2)""",
    }
    requires = {"flagged": ["plays"], "team_week": ["panel"], "schedule": ["panel"], "preds": ["panel"]}

    def ctes(self, names: list[str]) -> str:
        done: list[str] = []

        def add(name):
            for r in self.requires.get(name, []):
                add(r)
            if name and name not in done:
                done.append(name)

        for n in names:
            add(n)
        return ",".join(self.texts[n] for n in done if n in self.texts)


SQL = _Sql()
