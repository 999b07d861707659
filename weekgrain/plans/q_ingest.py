"""Queries over sources, sinks and streams: S01-S20, T01-T05."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weekgrain.keys import shared_dir
from weekgrain.operators import plays as PL
from weekgrain.plans.q_features import ID
from weekgrain.plans.q_plays import TEAM
from weekgrain.plans.registry import query
from weekgrain.plans.tables import zoned
from weekgrain.sources import ingest as S
from weekgrain.sources.versions import VersionedTable
from weekgrain.streaming import jobs as T
from weekgrain.streaming import stateful as ST


@query("S01_read_seasons", 'SELECT player_id,season,"week",fantasy_points FROM panel WHERE season IN (1996,1999)', "fantasy_points")
def _(t):
    path = shared_dir(t.spark, "panel")
    S.overwrite_partitions(t.panel.select(*ID, "fantasy_points"), path)
    return S.read_seasons(t.spark, path, [1996, 1999], [*ID, "fantasy_points"])


@query("S02_schedule_csv", """SELECT season,"week",CAST(home_team AS VARCHAR) AS home_team,CAST(away_team AS VARCHAR) AS away_team,gametime AS game_time,'' AS venue FROM schedule""", "", "schedule")
def _(t):
    path = shared_dir(t.spark, "schedule-csv")
    t.schedule.select("season", "week", "home_team", "away_team", F.col("gametime").alias("game_time")).write.option("header", True).csv(path)
    return S.read_schedule_csv(t.spark, path).withColumn("venue", F.coalesce("venue", F.lit("")))


@query("S03_season_cache", f"WITH {TEAM} SELECT season,\"week\",team,pass_attempts,rush_attempts,turnovers FROM tw WHERE season IN (1995,1996,1997)", "", "flagged")
def _(t):
    path = shared_dir(t.spark, "team-weeks")
    flagged = PL.with_play_flags(t.plays)
    compute = lambda seasons: PL.team_weeks(flagged.where(F.col("season").isin(seasons)))
    S.cached_by_season(t.spark, path, [1995, 1996], compute)
    return S.cached_by_season(t.spark, path, [1995, 1996, 1997], compute).select("season", "week", "team", "pass_attempts", "rush_attempts", "turnovers")


@query("S04_standardise_weekly", """SELECT player_id,season,"week",name,team,rushing_attempts,passing_completions,fumbles_lost,receptions,home_away FROM (SELECT player_id,season,"week",name,team,rushing_attempts,completions AS passing_completions,interceptions+coalesce(CASE WHEN rushing_tds>0 THEN rushing_tds END,0) AS fumbles_lost,
 coalesce(CASE WHEN receptions<>2 THEN receptions END,0) AS receptions,CASE WHEN team=opponent-1 THEN 'home' ELSE 'away' END AS home_away FROM panel)""")
def _(t):
    p = t.panel
    feed = p.select(*ID, F.col("name").alias("player_name"), F.col("team").alias("recent_team"), F.col("rushing_attempts").alias("carries"), "completions",
                    F.col("interceptions").alias("sack_fumbles_lost"), F.when(F.col("rushing_tds") > 0, F.col("rushing_tds")).alias("rushing_fumbles_lost"),
                    F.when(F.col("receptions") != 2, F.col("receptions")).alias("receptions"), (F.col("opponent") - 1).alias("home_team"))
    return S.standardise_weekly(feed).select(*ID, "name", "team", "rushing_attempts", "passing_completions", "fumbles_lost", "receptions", "home_away")


@query("S05_validate_weekly", """WITH d AS (SELECT player_id,season,"week"*2 AS "week",CASE WHEN player_id%4=0 THEN NULL ELSE "position" END AS "position" FROM panel UNION ALL SELECT player_id,season,"week"*2,"position" FROM panel WHERE player_id=3)
 SELECT 'CRITICAL' AS level,'missing_required' AS rule,'team' AS "column",1.0 AS value UNION ALL SELECT 'WARNING','missing_expected','air_yards',1.0 UNION ALL SELECT 'WARNING','not_numeric','position',1.0
 UNION ALL SELECT 'WARNING','null_rate','position',avg(CAST("position" IS NULL AS INT)) FROM d UNION ALL SELECT 'WARNING','season_range','season',min(season) FROM d UNION ALL SELECT 'WARNING','week_range','week',max("week") FROM d
 UNION ALL SELECT 'WARNING','duplicate_key','player_id,season,week',count(*) FROM d WHERE player_id=3 AND "position" IS NOT NULL HAVING count(*)>0""".replace("count(*) FROM d WHERE player_id=3 AND \"position\" IS NOT NULL HAVING count(*)>0", "count(*)/2.0 FROM d WHERE player_id=3"), "value")
def _(t):
    p = t.panel.select("player_id", "season", (F.col("week") * 2).alias("week"), "position")
    d = p.withColumn("position", F.when(F.col("player_id") % 4 != 0, F.col("position"))).unionByName(p.where(F.col("player_id") == 3))
    return S.validate_weekly(d, expected=["air_yards"], numeric=["position", "week"])


@query("S06_injury_quality", """SELECT count(*) AS record_count,count(*) FILTER (upper(status) IN ('OUT','DOUBTFUL','QUESTIONABLE','PROBABLE','IR','PUP','SUSPENDED','NFI') AND player_id IS NOT NULL) AS valid_record_count,0 AS n_errors,3 AS n_warnings,1 AS is_valid,
 100.0-15-CASE WHEN avg(CAST(player_id IS NULL AS INT))>0.1 THEN 10*avg(CAST(player_id IS NULL AS INT)) ELSE 0 END AS quality_score FROM injuries""", "quality_score", "injuries")
def _(t):
    return S.injury_quality(t.injuries.withColumn("team", F.col("player_id") % 25))


@query("S07_clean_injuries", """WITH c AS (SELECT player_name,upper(status) AS status,coalesce(confidence,0.7) AS confidence,injury_type,season,"week" FROM injuries), r AS (SELECT *, row_number() OVER (PARTITION BY player_name ORDER BY confidence DESC,season,"week",status,injury_type) AS rn FROM c) SELECT player_name,status,confidence,injury_type,season,"week" FROM r WHERE rn=1""", "confidence", "injuries")
def _(t):
    i = t.injuries.select("player_name", "season", "week", "status", "injury_type", "confidence")
    return S.clean_injuries(i)


@query("S08_resolve_sources", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY player_name,season ORDER BY CASE source WHEN 'manual' THEN 3 WHEN 'nflverse' THEN 2 ELSE 1 END DESC,"week",status,injury_type) AS rn FROM injuries) SELECT player_name,season,"week",source,status,injury_type FROM r WHERE rn=1""", "", "injuries")
def _(t):
    i = t.injuries.select("player_name", "season", "week", "status", "injury_type", "source")
    return S.resolve_sources(i, ["player_name", "season"])


@query("S09_prefer_first_feed", """WITH a AS (SELECT player_id,season,"week",fantasy_points,'weekly' AS feed FROM panel WHERE "week"<=6), b AS (SELECT player_id,season,"week",fantasy_points+1 AS fantasy_points,'plays' AS feed FROM panel)
 SELECT * FROM a UNION ALL SELECT * FROM b WHERE (player_id,season,"week") NOT IN (SELECT player_id,season,"week" FROM a)""", "fantasy_points")
def _(t):
    p = t.panel.select(*ID, "fantasy_points")
    weekly = p.where(F.col("week") <= 6).withColumn("feed", F.lit("weekly"))
    plays = p.withColumns({"fantasy_points": F.col("fantasy_points") + 1, "feed": F.lit("plays")})
    return S.prefer_first(weekly, plays) if S.needs_fallback(weekly, 2001, 10) else weekly


@query("S10_fill_advanced", """SELECT player_id,season,"week",coalesce(CASE WHEN player_id%3<>0 THEN air_yards END,CASE WHEN player_id%2=0 THEN air_yards*10 END) AS air_yards,CASE WHEN player_id%2=0 THEN targets END AS recv_targets FROM panel""", "air_yards")
def _(t):
    p = t.panel
    base = p.select(*ID, F.when(F.col("player_id") % 3 != 0, F.col("air_yards")).alias("air_yards"))
    extra = p.where(F.col("player_id") % 2 == 0).select(*ID, (F.col("air_yards") * 10).alias("air_yards"), F.col("targets").alias("recv_targets"))
    return S.fill_from(base, extra, ["air_yards", "recv_targets"])


def _versioned(t, name, rows):
    table = VersionedTable(t.spark, shared_dir(t.spark, name))
    table.overwrite(rows)
    return table


@query("S11_upsert_table", """SELECT player_id,season,"week",CASE WHEN season=2000 AND player_id%4=0 THEN fantasy_points+100 ELSE fantasy_points END AS fantasy_points FROM panel""", "fantasy_points")
def _(t):
    p = t.panel.select(*ID, "fantasy_points")
    table = _versioned(t, "upsert", p.where(F.col("season") != 1997))
    up = p.where((F.col("season") == 2000) & (F.col("player_id") % 4 == 0)).withColumn("fantasy_points", F.col("fantasy_points") + 100).unionByName(p.where(F.col("season") == 1997))
    for _ in range(2):  # a second run must change nothing
        table.upsert(up, ID)
    return table.read().select(*ID, "fantasy_points")


@query("S12_insert_missing", """SELECT player_id,season,"week",CASE WHEN player_id%5=0 THEN fantasy_points*2 ELSE fantasy_points END AS fantasy_points FROM panel""", "fantasy_points")
def _(t):
    p = t.panel.select(*ID, "fantasy_points")
    table = _versioned(t, "insert", p.where(F.col("player_id") % 5 != 0))
    table.insert_missing(p.withColumn("fantasy_points", F.col("fantasy_points") * 2), ID)
    return table.read().select(*ID, "fantasy_points")


@query("S13_update_columns", """SELECT player_id,season,"week",CASE WHEN player_id%3=0 THEN rush_inside_10+5 ELSE rush_inside_10 END AS rush_inside_10,CASE WHEN player_id%3=0 THEN air_yards+1 ELSE air_yards END AS air_yards FROM panel""", "air_yards")
def _(t):
    p = t.panel.select(*ID, "rush_inside_10", "air_yards")
    up = p.where(F.col("player_id") % 3 == 0).withColumns({"rush_inside_10": F.col("rush_inside_10") + 5, "air_yards": F.col("air_yards") + 1})
    stranger = up.where(F.col("season") == 2000).withColumn("player_id", F.col("player_id") + 10_000_000)
    return S.updated_columns(p, up.unionByName(stranger), ["rush_inside_10", "air_yards"])


@query("S13_update_summary", """SELECT season,count(*)*2 AS rows_seen,count(*) AS rows_updated FROM panel WHERE player_id%3=0 GROUP BY ALL""")
def _(t):
    p = t.panel.select(*ID)
    up = p.where(F.col("player_id") % 3 == 0)
    return S.update_summary(p, up.unionByName(up.withColumn("player_id", F.col("player_id") + 10_000_000)))


@query("S14_replace_season", """SELECT player_id,season,"week",CASE WHEN season=2001 AND "week"<=5 THEN fantasy_points-1 ELSE fantasy_points END AS fantasy_points FROM panel WHERE NOT (season=2001 AND "week"<=5 AND player_id%2=0)""", "fantasy_points")
def _(t):
    p = t.panel.select(*ID, "fantasy_points")
    table = _versioned(t, "replace", p)
    new = p.where((F.col("season") == 2001) & (F.col("player_id") % 2 == 1)).withColumn("fantasy_points", F.col("fantasy_points") - 1)
    table.replace_up_to(new, 2001, "week", 5)
    return table.read().select(*ID, "fantasy_points")


@query("S15_missing_seasons", """WITH l AS (SELECT season,max("week") AS w FROM panel WHERE season<2000 OR (season=2000 AND "week"<=7) GROUP BY ALL), r AS (SELECT season,max("week") AS w FROM panel GROUP BY ALL)
 SELECT season,r.w AS remote_max_week,l.w AS local_max_week,CASE WHEN l.w IS NULL THEN 'missing' ELSE 'new_weeks' END AS state FROM r LEFT JOIN l USING (season) WHERE l.w IS NULL OR l.w<r.w""")
def _(t):
    p = t.panel
    return S.missing_seasons(p.where((F.col("season") < 2000) | ((F.col("season") == 2000) & (F.col("week") <= 7))), p)


@query("S16_aligned_union", """SELECT player_id,season,"week",fantasy_points,air_yards FROM panel WHERE season>=1998 UNION ALL SELECT player_id,season,"week",fantasy_points,NULL FROM panel WHERE season<1998""", "fantasy_points air_yards")
def _(t):
    p = t.panel
    base = p.where(F.col("season") >= 1998).select(*ID, "fantasy_points", "air_yards")
    return S.aligned_union(base, p.where(F.col("season") < 1998).select(*ID, "fantasy_points", "snap_count"))


@query("S17_coverage", 'SELECT season,"position",count(*) AS rows,count(DISTINCT player_id) AS players,count(DISTINCT "week") AS weeks FROM panel GROUP BY ALL')
def _(t):
    return S.coverage(t.panel)


@query("S17_missing_pairs", """SELECT s AS season,p AS "position" FROM (SELECT unnest([1996,1997,1998]) AS s),(SELECT unnest(['QB','RB','WR','TE']) AS p) WHERE s=1998 OR (s=1997 AND p IN ('QB','TE'))""")
def _(t):
    kept = t.panel.where(~((F.col("season") == 1998) | ((F.col("season") == 1997) & F.col("position").isin("QB", "TE"))))
    return S.missing_pairs(kept, [1996, 1997, 1998], ["QB", "RB", "WR", "TE"])


@query("S17_season_status", """WITH w AS (SELECT season,count(DISTINCT "week") AS weeks FROM panel WHERE season<>1996 OR "week"<9 GROUP BY ALL) SELECT *, CASE WHEN season<2001 AND weeks<12 THEN 'INCOMPLETE' WHEN season=2001 AND weeks<12 THEN 'BEHIND' ELSE 'OK' END AS status FROM w""")
def _(t):
    p = t.panel.where((F.col("season") != 1996) | (F.col("week") < 9))
    return S.season_status(p, 2001, 12, full=12)


@query("S18_top_export", """WITH l AS (SELECT player_id,"position",predicted_points AS projection_1w FROM preds WHERE season*100+"week"=(SELECT max(season*100+"week") FROM preds)) SELECT player_id,"position",projection_1w,place FROM (SELECT *, row_number() OVER (PARTITION BY "position" ORDER BY round(projection_1w,9) DESC,player_id) AS place FROM l) WHERE place<=12""", "projection_1w", "preds")
def _(t):
    p, at = t.predictions, F.col("season") * 100 + F.col("week")
    p = p.join(F.broadcast(p.agg(F.max(at).alias("_now"))), at == F.col("_now")).select("player_id", "position", F.col("predicted_points").alias("projection_1w"))
    path = shared_dir(t.spark, "json")
    S.export_top(p, path, 12)
    return t.spark.read.schema("player_id long, projection_1w double, place int, position string").json(path).select("player_id", "position", "projection_1w", "place")


@query("S19_fingerprint")
def _(t):
    return S.fingerprint(t.panel)


@query("S20_clean_panel", """WITH r AS (SELECT player_id,season,"week","position",CASE WHEN targets>2 THEN targets END AS targets,CASE WHEN air_yards>20 THEN air_yards END AS air_yards,fantasy_points*CASE WHEN player_id=7 AND "week"=3 THEN 50 ELSE 1 END AS fantasy_points FROM panel WHERE season>=2000),
 f AS (SELECT *, last_value(targets IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY season,"week") AS tg FROM r), m AS (SELECT "position",quantile_cont(tg,0.5) AS mt,quantile_cont(air_yards,0.5) AS ma,quantile_cont(fantasy_points,0.5) AS mf FROM f GROUP BY ALL),
 c AS (SELECT player_id,season,"week",f."position",CAST(coalesce(tg,mt) AS DOUBLE) AS targets,coalesce(air_yards,ma) AS air_yards,fantasy_points FROM f JOIN m USING ("position")), q AS (SELECT quantile_cont(fantasy_points,0.25) AS a,quantile_cont(fantasy_points,0.75) AS b FROM c)
 SELECT c.* FROM c,q WHERE fantasy_points BETWEEN a-3*(b-a) AND b+3*(b-a)""", "targets air_yards fantasy_points")
def _(t):
    p = t.panel.select(*ID, "position", F.when(F.col("targets") > 2, F.col("targets")).alias("targets"), F.when(F.col("air_yards") > 20, F.col("air_yards")).alias("air_yards"),
                       (F.col("fantasy_points") * F.when((F.col("player_id") == 7) & (F.col("week") == 3), 50).otherwise(1)).alias("fantasy_points"))
    return S.clean_panel(p, ["targets"], ["fantasy_points"])


# --- streams ------------------------------------------------------------------------------
def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


DAY = 86_400


@query("T01_running_player_weeks", """SELECT season,"week",rusher_player_id AS player_id,count(*) AS plays,sum(rushing_yards) AS yards,CAST(sum(touchdown) AS BIGINT) AS touchdowns FROM plays WHERE rusher_player_id IS NOT NULL GROUP BY ALL""", "yards", "plays")
def _(t):
    plays = t.as_plays(zoned(t.raw("lineitem"))).where(F.col("rusher_player_id").isNotNull())
    plays = plays.select("ts", "season", "week", F.col("rusher_player_id").alias("player_id"), F.col("rushing_yards").alias("yards"), F.col("touchdown").alias("touchdowns"))
    root, sums, width = shared_dir(t.spark, "running"), ["yards", "touchdowns"], 28 * DAY
    totals = ST.windowed_totals(t.arrivals(plays, "running-in", "ts"), "ts", width, "100 days", ID, sums, ST.buckets_for(t.raw("lineitem").count()))
    table = VersionedTable(t.spark, f"{root}/table", "part")
    _run(ST.totals_sink(totals, table, f"{root}/late", f"{root}/checkpoint", ["window", "bucket", *ID], width))
    late = t.spark.read.schema(totals.drop("late").schema).parquet(f"{root}/late")
    merged = ST.merged_totals(table.read(), late, ID, sums)
    return merged.select(*ID, F.col("n").alias("plays"), "yards", F.col("touchdowns").cast("long").alias("touchdowns"))


@query("T02_unique_plays", """SELECT game_id,play_id FROM plays GROUP BY ALL""", "", "plays")
def _(t):
    plays = t.as_plays(zoned(t.raw("lineitem"))).select(F.date_trunc("day", F.min("ts").over(Window.partitionBy("game_id", "play_id"))).alias("ts"), "game_id", "play_id")
    root, by, width = shared_dir(t.spark, "unique"), ["game_id", "play_id"], 28 * DAY
    rows = ST.first_rows(t.arrivals(plays, "unique-in", "ts"), "ts", width, "100 days", by, ST.buckets_for(t.raw("lineitem").count()))
    _run(ST.rows_sink(rows, f"{root}/rows", f"{root}/late", f"{root}/checkpoint"))
    read = lambda name: t.spark.read.schema(rows.drop("late").schema).parquet(f"{root}/{name}")
    return ST.merged_rows(read("rows"), read("late"), by)


@query("T03_idempotent_upsert", """SELECT CAST(date_trunc('day',ts) AS DATE)::VARCHAR AS "day",event_type,count(*) AS n,sum(value) AS total FROM events GROUP BY ALL""", "total")
def _(t):
    events = zoned(t.raw("events")).select("ts", "event_type", F.col("value").alias("total"))
    root = shared_dir(t.spark, "idempotent")
    totals = ST.windowed_totals(t.arrivals(events, "idempotent-in", "ts"), "ts", DAY, "1 day", ["event_type"], ["total"])
    table = VersionedTable(t.spark, f"{root}/table", "part")
    died = {"left": 1}

    def dies_once(batch_id):  # after the upsert, before the batch counts as done
        if batch_id == 2 and died["left"]:
            died["left"] = 0
            raise RuntimeError("died after the upsert of a batch")

    sink = lambda: ST.totals_sink(totals, table, f"{root}/late", f"{root}/checkpoint", ["window", "bucket", "event_type"], DAY, after=dies_once)
    try:
        _run(sink())
    except Exception:  # noqa: BLE001
        if died["left"]:
            raise
        _run(sink())  # the batch runs again
    late = t.spark.read.schema(totals.drop("late").schema).parquet(f"{root}/late")
    merged = ST.merged_totals(table.read(), late, ["window", "event_type"], ["total"])
    return merged.select(F.to_date(F.timestamp_seconds("window")).cast("string").alias("day"), "event_type", "n", "total")


@query("T04_late_repair", """SELECT CAST(date_trunc('day',ts) AS DATE)::VARCHAR AS "day",count(*) AS n,sum(value) AS total FROM events GROUP BY ALL""", "total")
def _(t):
    root = shared_dir(t.spark, "late")
    events = zoned(t.raw("events")).select("ts", "event_id", F.col("value").alias("total"))
    late = F.col("event_id") % 10 == 3
    events.where(~late).write.parquet(f"{root}/in/a")
    source = t.spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
    totals = ST.windowed_totals(source, "ts", DAY, "1 day", [], ["total"])
    table = VersionedTable(t.spark, f"{root}/table", "part")
    run = lambda: _run(ST.totals_sink(totals, table, f"{root}/late", f"{root}/checkpoint", ["window", "bucket"], DAY))
    run()
    events.where(late).write.parquet(f"{root}/in/b")
    run()  # days that are closed by now get side rows
    side = t.spark.read.schema(totals.drop("late").schema).parquet(f"{root}/late")
    written = table.read().groupBy("window").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    days = S.upserted(written, ST.repaired(table.read(), side, ["window"], ["total"]), ["window"])
    return days.select(F.to_date(F.timestamp_seconds("window")).cast("string").alias("day"), "n", "total")


@query("T05_prediction_monitor", """WITH e AS (SELECT ts,value AS actual,CASE WHEN event_id%20<>0 THEN value*0.9+1 END AS pred FROM events) SELECT CAST(date_trunc('day',ts) AS DATE)::VARCHAR AS "day",count(*) AS n,avg(CAST(pred IS NULL AS INT)) AS null_rate,avg(pred) AS mean_prediction,stddev_pop(pred) AS std_prediction,sqrt(avg(pow(actual-pred,2))) AS rmse,
 CAST(abs(avg(pred)-10)/10>0.05 AS INT) AS mean_alert,CAST((sqrt(avg(pow(actual-pred,2)))-1)/1>0.2 AS INT) AS rmse_alert FROM e GROUP BY ALL""", "null_rate mean_prediction std_prediction rmse")
def _(t):
    e = T.with_origin(t.stream("events")).select("origin", "ts", F.col("value").alias("actual"), F.when(F.col("event_id") % 20 != 0, F.col("value") * 0.9 + 1).alias("pred"))
    root = shared_dir(t.spark, "monitor")
    _run(T.share_sink(e, f"{root}/table", f"{root}/checkpoint", T.monitor_shares))
    shares = t.spark.read.schema("day string, n long, known long, mean double, var double, errors long, mse double, origin string").parquet(f"{root}/table")
    return T.merged_monitor(shares, reference_mean=10.0, reference_rmse=1.0, mean_limit=0.05, rmse_limit=0.2)
