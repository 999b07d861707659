"""Fixed values of the domain: scoring rules, weights, windows, thresholds.

Everything here is data. Operators render it into literals, CASE ladders or
small lookup frames; nothing in this module touches Spark.
"""

# --- fixed values: fantasy scoring -------------------------------------------
SCORING = {
    "passing_yards": 0.04,
    "passing_tds": 4,
    "interceptions": -2,
    "rushing_yards": 0.1,
    "rushing_tds": 6,
    "receptions": 1,
    "receiving_yards": 0.1,
    "receiving_tds": 6,
    "fumbles_lost": -2,
    "two_point_conversions": 2,
}
RECEPTION_WEIGHT = {"ppr": 1.0, "half_ppr": 0.5, "standard": 0.0}
KICKER_SCORING = {
    "fg_0_39": 3,
    "fg_40_49": 4,
    "fg_50_plus": 5,
    "xp_made": 1,
    "fg_missed": -1,
    "xp_missed": -1,
}
DEFENSE_SCORING = {
    "sacks": 1,
    "interceptions": 2,
    "fumble_recoveries": 2,
    "safeties": 2,
    "defensive_tds": 6,
    "special_teams_tds": 6,
    "blocked_kicks": 2,
}
# (largest points allowed in the bracket, score); above the last bracket -> -4
POINTS_ALLOWED_BRACKETS = [(0, 10), (6, 7), (13, 4), (20, 1), (27, 0), (34, -1)]
POINTS_ALLOWED_ABOVE = -4

# --- fixed values: utilization weights ---------------------------------------
UTILIZATION_WEIGHTS = {
    "QB": {"dropback_rate": 0.25, "rush_attempt_share": 0.20, "redzone_opportunity": 0.25, "play_volume": 0.30},
    "RB": {
        "snap_share": 0.20, "rush_share": 0.25, "target_share": 0.20,
        "redzone_share": 0.20, "touch_share": 0.10, "high_value_touch": 0.05,
    },
    "WR": {
        "target_share": 0.30, "air_yards_share": 0.25, "snap_share": 0.15,
        "redzone_targets": 0.20, "route_participation": 0.05, "high_value_touch": 0.05,
    },
    "TE": {
        "target_share": 0.30, "snap_share": 0.20, "redzone_targets": 0.25,
        "air_yards_share": 0.15, "inline_rate": 0.05, "high_value_touch": 0.05,
    },
}
# weight key -> percentage column it is applied to
COMPONENT_COLUMNS = {
    "QB": {
        "dropback_rate": "dropback_rate_pct", "rush_attempt_share": "rush_share_pct",
        "redzone_opportunity": "redzone_opp_pct", "play_volume": "play_volume_pct",
    },
    "RB": {
        "snap_share": "snap_share_pct", "rush_share": "rush_share_pct", "target_share": "target_share_pct",
        "redzone_share": "redzone_share_pct", "touch_share": "touch_share_pct",
        "high_value_touch": "high_value_touch_rate",
    },
    "WR": {
        "target_share": "target_share_pct", "air_yards_share": "air_yards_share_pct",
        "snap_share": "snap_share_pct", "redzone_targets": "redzone_targets_pct",
        "route_participation": "route_participation_pct", "high_value_touch": "high_value_touch_rate",
    },
    "TE": {
        "target_share": "target_share_pct", "snap_share": "snap_share_pct",
        "redzone_targets": "redzone_targets_pct", "air_yards_share": "air_yards_share_pct",
        "inline_rate": "inline_rate_pct", "high_value_touch": "high_value_touch_rate",
    },
}
POSITIONS = ["QB", "RB", "WR", "TE"]

# --- fixed values: play situations -------------------------------------------
NEUTRAL_SCORE_DIFF = 7
SHORT_YARDAGE = 2
RED_ZONE = 20
GOAL_LINE = 5
TWO_MINUTE_SECONDS = 120
LEAGUE_NEUTRAL_PASS_RATE = 0.56

# --- fixed values: windows ----------------------------------------------------
ROLLING_WINDOWS = [3, 4, 5, 8, 12]
LAG_WEEKS = [1, 2, 3, 4]
EWM_SPANS = [3, 5, 8]
TREND_WINDOWS = [3, 5, 8]
MOMENTUM_WEIGHTS = (0.60, 0.30, 0.10)
MOMENTUM_PARTS = {"points_scored": 0.50, "passing_yards": 0.20, "rushing_yards": 0.15, "turnovers": -0.15}
BOOM_BUST = {"QB": (25, 10), "RB": (20, 5), "WR": (20, 5), "TE": (15, 3)}
BOOM_BUST_DEFAULT = (20, 5)
AGE_CURVE = {"QB": (28, 0.003), "RB": (25, 0.008), "WR": (27, 0.005), "TE": (28, 0.004)}
AGE_CURVE_DEFAULT = (27, 0.005)
PASS_PREFERENCE = {"QB": 0.60, "WR": 0.60, "TE": 0.58, "RB": 0.45}
PASS_PREFERENCE_DEFAULT = 0.52
WORKLOAD_THRESHOLD = {"RB": 80.0, "WR": 40.0, "TE": 35.0, "QB": 120.0}
GAMES_RATE = {"QB": 0.92, "RB": 0.82, "WR": 0.88, "TE": 0.90}
GAMES_RATE_DEFAULT = 0.85
REGRESSION_FACTORS = {1: 0.0, 5: 0.15, 10: 0.25, 18: 0.35}
BASE_INJURY_RATE = {"QB": 0.25, "RB": 0.45, "WR": 0.30, "TE": 0.28}
USAGE_INJURY_FACTOR = 0.002
# injury keyword -> (typical weeks out, share of normal output in weeks 1..4 after return, re-injury risk)
RECOVERY = {
    "hamstring": (2, [0.75, 0.85, 0.92, 1.0], 0.25),
    "ankle": (1, [0.85, 0.92, 0.98, 1.0], 0.15),
    "knee": (3, [0.70, 0.80, 0.88, 0.95], 0.20),
    "concussion": (1, [0.90, 0.95, 1.0, 1.0], 0.10),
    "shoulder": (2, [0.80, 0.90, 0.95, 1.0], 0.15),
    "back": (2, [0.75, 0.85, 0.90, 0.95], 0.30),
    "acl": (40, [0.60, 0.70, 0.80, 0.90], 0.15),
    "unknown": (2, [0.80, 0.90, 0.95, 1.0], 0.20),
}

# --- fixed values: targets and success criteria -------------------------------
RMSE_TARGETS = {
    "1w": {"QB": 7.5, "RB": 8.5, "WR": 8.0, "TE": 7.0},
    "4w": {"QB": 10.0, "RB": 11.0, "WR": 10.0, "TE": 9.0},
    "18w": {"QB": 15.0, "RB": 15.0, "WR": 15.0, "TE": 15.0},
}
MAPE_TARGETS = {"1w": 25.0, "4w": 35.0, "18w": 45.0}
R2_TARGETS = {"1w": 0.50, "4w": 0.40, "18w": 0.30}
SUCCESS = {
    "spearman_rho_min": 0.65,
    "within_10_pts_pct_min": 80.0,
    "within_7_pts_pct_min": 70.0,
    "beat_naive_baseline_pct": 25.0,
    "tier_accuracy_min": 0.75,
    "max_weekly_degradation_pct": 20.0,
}
MIN_SEASONS = {"1w": 3, "4w": 5, "18w": 8}
MIN_PLAYERS = {"QB": 30, "RB": 60, "WR": 70, "TE": 30}
HORIZON_HALFLIFE = {1: 2.0, 4: 3.0, 18: 4.0}

# --- fixed values: expected points per game by utilization band ----------------
# position -> [(low, high, min, avg, max)]
PPG_BANDS = {
    "RB": [(0, 50, 3.0, 6.5, 10.0), (50, 60, 6.0, 9.5, 13.0), (60, 70, 9.0, 12.2, 16.0),
           (70, 80, 12.0, 15.1, 20.0), (80, 100, 15.0, 18.5, 28.0)],
    "WR": [(0, 50, 2.0, 5.0, 9.0), (50, 60, 5.0, 8.0, 12.0), (60, 70, 8.0, 11.0, 15.0),
           (70, 80, 11.0, 14.5, 19.0), (80, 100, 14.0, 18.0, 26.0)],
    "TE": [(0, 50, 1.5, 4.0, 7.0), (50, 60, 4.0, 6.5, 10.0), (60, 70, 6.0, 9.0, 13.0),
           (70, 80, 9.0, 12.0, 17.0), (80, 100, 12.0, 16.0, 24.0)],
    "QB": [(0, 50, 8.0, 12.0, 16.0), (50, 60, 12.0, 15.0, 19.0), (60, 70, 15.0, 18.0, 23.0),
           (70, 80, 18.0, 21.0, 27.0), (80, 100, 21.0, 25.0, 35.0)],
}

# --- fixed values: team names ---------------------------------------------------
# abbreviation -> names in use
TEAM_NAMES = {
    "ARI": ["arizona cardinals", "arizona", "cardinals"],
    "ATL": ["atlanta falcons", "atlanta", "falcons"],
    "BAL": ["baltimore ravens", "baltimore", "ravens"],
    "BUF": ["buffalo bills", "buffalo", "bills"],
    "CAR": ["carolina panthers", "carolina", "panthers"],
    "CHI": ["chicago bears", "chicago", "bears"],
    "CIN": ["cincinnati bengals", "cincinnati", "bengals"],
    "CLE": ["cleveland browns", "cleveland", "browns"],
    "DAL": ["dallas cowboys", "dallas", "cowboys"],
    "DEN": ["denver broncos", "denver", "broncos"],
    "DET": ["detroit lions", "detroit", "lions"],
    "GB": ["green bay packers", "green bay", "packers"],
    "HOU": ["houston texans", "houston", "texans"],
    "IND": ["indianapolis colts", "indianapolis", "colts"],
    "JAX": ["jacksonville jaguars", "jacksonville", "jaguars"],
    "KC": ["kansas city chiefs", "kansas city", "chiefs"],
    "LV": ["las vegas raiders", "las vegas", "raiders", "oakland raiders"],
    "LAC": ["los angeles chargers", "la chargers", "chargers"],
    "LAR": ["los angeles rams", "la rams", "rams"],
    "MIA": ["miami dolphins", "miami", "dolphins"],
    "MIN": ["minnesota vikings", "minnesota", "vikings"],
    "NE": ["new england patriots", "new england", "patriots"],
    "NO": ["new orleans saints", "new orleans", "saints"],
    "NYG": ["new york giants", "ny giants", "giants"],
    "NYJ": ["new york jets", "ny jets", "jets"],
    "PHI": ["philadelphia eagles", "philadelphia", "eagles"],
    "PIT": ["pittsburgh steelers", "pittsburgh", "steelers"],
    "SF": ["san francisco 49ers", "san francisco", "49ers"],
    "SEA": ["seattle seahawks", "seattle", "seahawks"],
    "TB": ["tampa bay buccaneers", "tampa bay", "buccaneers", "bucs"],
    "TEN": ["tennessee titans", "tennessee", "titans"],
    "WAS": ["washington commanders", "washington", "commanders", "washington football team", "redskins"],
}
