"""Scalar expressions of the domain, all JVM-side columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekgrain import config as C


def clip(x: Column, lo=None, hi=None) -> Column:
    """Bounds that let a null through (greatest/least alone would swallow it)."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(x.isNotNull(), out)


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d, and the default where that is undefined. Each operand appears once, so ratios of ratios stay small."""
    q = F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(float(default)))
    return F.nanvl(q, F.lit(float(default)))


def held(x: Column, lo: float, hi: float) -> Column:
    """Bounds for an expression that is never null."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Small fixed mapping as a CASE ladder (constant-folded, no join)."""
    out = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default)) if default is not None else out


def bracket(x: Column, steps: Sequence[tuple[float, object]], above) -> Column:
    """First value whose upper edge is >= x, else ``above``."""
    out = None
    for edge, value in steps:
        out = F.when(x <= edge, F.lit(value)) if out is None else out.when(x <= edge, F.lit(value))
    return out.otherwise(F.lit(above))


def at_least(x: Column, steps: Sequence[tuple[float, object]], below) -> Column:
    """First value whose lower edge is <= x, else ``below``; steps run from high to low."""
    out = None
    for edge, value in steps:
        out = F.when(x >= edge, F.lit(value)) if out is None else out.when(x >= edge, F.lit(value))
    return out.otherwise(F.lit(below))


# --- scoring -----------------------------------------------------------------
def fantasy_points(columns: Sequence[str], fmt: str = "ppr", weights: Mapping = C.SCORING) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        if name in columns:
            w = C.RECEPTION_WEIGHT[fmt] if name == "receptions" else w
            total = total + zero(name) * F.lit(float(w))
    return total


def rescale_format(points: Column, receptions: Column, fmt: str, n_weeks: int = 1) -> Column:
    return points - F.lit((1.0 - C.RECEPTION_WEIGHT[fmt]) * n_weeks) * F.coalesce(receptions, F.lit(0.0))


# --- names, teams ----------------------------------------------------------------
# fixed values: name suffixes that are dropped
NAME_SUFFIXES = [" Jr.", " Sr.", " III", " II", " IV", " V"]


def normal_name(name: Column) -> Column:
    out = F.trim(F.coalesce(name, F.lit("")))
    for s in NAME_SUFFIXES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))


def made_id(name: Column, position: Column | None = None) -> Column:
    """Generated id: 3 letters of the first token, 4 of the last, then the position."""
    norm = normal_name(name)
    parts = F.split(norm, " ")
    two = F.concat(F.substring(F.get(parts, F.lit(0)), 1, 3), F.substring(F.element_at(parts, -1), 1, 4))
    base = F.when(F.size(parts) >= 2, two).otherwise(F.substring(norm, 1, 7))
    return base if position is None else F.concat(base, F.lit("_"), F.lower(position))


def team_code(name: Column) -> Column:
    up, low = F.upper(name), F.lower(F.trim(name))
    known = {alias: code for code, names in C.TEAM_NAMES.items() for alias in names}
    return (F.when(F.coalesce(name, F.lit("")) == "", F.lit(""))
            .when(up.isin(list(C.TEAM_NAMES)), up)
            .otherwise(F.coalesce(lookup(low, known), F.substring(up, 1, 3))))


# --- calendar --------------------------------------------------------------------
def approx_season_week(d: Column) -> tuple[Column, Column]:
    """Season and week guessed from the ISO week number."""
    month, iso = F.month(d), F.weekofyear(d)
    season = F.when(month >= 9, F.year(d)).otherwise(F.year(d) - 1)
    raw = F.when(month >= 9, F.pmod(iso - 35, F.lit(18)) + 1).otherwise(F.pmod(iso + 17, F.lit(18)) + 1)
    return season, clip(raw, 1, 18)


def season_phase(week: Column) -> Column:
    return F.when(week <= 6, 0).when(week <= 12, 1).when(week <= 18, 2).otherwise(3)


# --- quarterback rating ------------------------------------------------------------
def passer_rating(completions: Column, attempts: Column, yards: Column, tds: Column, ints: Column) -> Column:
    part = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(2.375), x))
    a = part((completions / attempts - 0.3) * 5)
    b = part((yards / attempts - 3) * 0.25)
    c = part(tds / attempts * 20)
    d = part(2.375 - ints / attempts * 25)
    return F.when(attempts > 0, (a + b + c + d) / 6 * 100).otherwise(F.lit(0.0))


# --- interpolation and age tables -----------------------------------------------------
# fixed values: draft pick -> value
DRAFT_CURVE = [(1, 1.0), (2, 0.98), (3, 0.96), (4, 0.94), (5, 0.92), (10, 0.85), (15, 0.78), (20, 0.72), (25, 0.67),
               (32, 0.60), (50, 0.50), (75, 0.40), (100, 0.32), (150, 0.22), (200, 0.15), (250, 0.10)]


def piecewise_linear(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear between knots, constant outside."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(knots[-1][1]))))


# fixed values: share of peak output from age 21 on
AGE_FACTOR = {
    "QB": [0.70, 0.78, 0.85, 0.90, 0.94, 0.97, 0.99, 1.00, 1.00, 1.00, 0.99, 0.98, 0.96, 0.93, 0.90, 0.86, 0.82,
           0.77, 0.72, 0.67, 0.62, 0.57, 0.52],
    "RB": [0.85, 0.92, 0.97, 1.00, 1.00, 0.98, 0.93, 0.86, 0.78, 0.70, 0.62, 0.54, 0.46, 0.38, 0.30],
    "WR": [0.72, 0.80, 0.87, 0.93, 0.97, 1.00, 1.00, 1.00, 0.99, 0.96, 0.92, 0.87, 0.81, 0.74, 0.67, 0.60, 0.53],
    "TE": [0.60, 0.68, 0.76, 0.83, 0.89, 0.94, 0.98, 1.00, 1.00, 1.00, 0.98, 0.95, 0.91, 0.86, 0.80, 0.74, 0.68, 0.62],
}
# fixed values: games played from age 21 on
AGE_GAMES = {
    "QB": [12.5, 13.5, 14.5, 15.0, 15.5, 15.8, 16.0, 16.0, 16.0, 15.8, 15.5, 15.2, 14.8, 14.3, 13.8, 13.2, 12.5, 11.8,
           11.0, 10.0],
    "RB": [13.0, 14.0, 14.5, 14.5, 14.0, 13.5, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0, 5.0],
    "WR": [13.0, 14.0, 15.0, 15.5, 15.8, 16.0, 16.0, 15.8, 15.5, 15.0, 14.5, 14.0, 13.5, 12.5, 11.5, 10.5, 9.5],
    "TE": [12.0, 13.0, 14.0, 14.5, 15.0, 15.5, 15.8, 16.0, 16.0, 15.8, 15.5, 15.0, 14.5, 14.0, 13.0, 12.0, 11.0, 10.0],
}
# fixed values: injury risk multiplier from age 21 on; 2.5 past the end
AGE_RISK = [0.85, 0.88, 0.92, 0.95, 1.0, 1.05, 1.10, 1.18, 1.28, 1.40, 1.55, 1.72, 1.90, 2.10, 2.35]
PEAK_AGE = {"QB": 29, "RB": 24, "WR": 27, "TE": 28}
PRIME_AGES = {"QB": (26, 34), "RB": (22, 27), "WR": (24, 30), "TE": (25, 31)}


def by_age(age: Column, position: Column, table: Mapping[str, Sequence[float]]) -> Column:
    """Table value at the age, clamped to the ends of the position's list; unknown positions use WR."""
    def pick(values):
        arr = F.array(*[F.lit(float(v)) for v in values])
        return F.get(arr, (clip(age.cast("int"), 21, 20 + len(values)) - 21).cast("int"))
    return lookup(position, {p: pick(v) for p, v in table.items()}, pick(table["WR"]))


def age_risk(age: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in AGE_RISK])
    return (F.when(age < 21, F.lit(0.85)).when(age > 20 + len(AGE_RISK), F.lit(2.5))
            .otherwise(F.get(arr, (age - 21).cast("int"))))


# --- injury hazard ---------------------------------------------------------------------
# fixed values: injuries per 100 games; (high, danger) weekly workload
INJURIES_PER_100 = {"QB": 16, "RB": 29, "WR": 25, "TE": 23}
WORKLOAD_LINES = {"RB": (25, 30), "WR": (12, 15), "TE": (10, 12), "QB": (45, 55)}


def base_hazard(position: Column, weeks: Column) -> Column:
    rate = lookup(position, {p: v / 100.0 for p, v in INJURIES_PER_100.items()}, 0.20)
    h = F.when(weeks > 0, F.lit(1.3 / 17) * F.pow(weeks / 17.0, F.lit(0.3))).otherwise(rate / 17)
    return F.least(h * rate * 17, F.lit(0.15))


def workload_risk(position: Column, weekly: Column, season: Column) -> Column:
    high = lookup(position, {p: float(v[0]) for p, v in WORKLOAD_LINES.items()}, 20.0)
    danger = lookup(position, {p: float(v[1]) for p, v in WORKLOAD_LINES.items()}, 25.0)
    now = F.when(weekly >= danger, 1.5).when(weekly >= high, 1.2).otherwise(1.0)
    total = F.when(season > high * 17 * 1.2, 1.3).when(season > high * 17, 1.15).otherwise(1.0)
    return now * total


def history_risk(prior: Column, same_part: Column) -> Column:
    return F.least((1.0 + prior * 0.1) * (1.0 + same_part * 0.3), F.lit(3.0))


def injury_probability(position, age, weeks, weekly, season, prior) -> Column:
    p = base_hazard(position, weeks) * age_risk(age) * workload_risk(position, weekly, season) * history_risk(prior, F.lit(0))
    return F.least(p, F.lit(0.25))


def risk_level(p: Column) -> Column:
    return F.when(p > 0.12, "high").when(p > 0.06, "medium").otherwise("low")


# --- probabilities -----------------------------------------------------------------------
def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 7.5e-8 (a rational approximation in 1/(1+ct))."""
    # fixed values: published coefficients (Abramowitz and Stegun 26.2.17)
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = F.lit(b[-1])
    for coef in reversed(b[:-1]):
        poly = poly * t + coef
    tail = F.exp(-z * z / 2.0) * F.lit(0.3989422804014327) * poly * t
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


# --- betting lines ------------------------------------------------------------------------
def implied_total(total: Column, spread: Column) -> Column:
    """Team total from the game total and the team's spread (negative = favourite)."""
    return (total - spread) / 2.0


def win_probability(spread: Column) -> Column:
    return clip(0.5 - clip(spread, -14.0, 14.0) / 28.0, 0.05, 0.95)


# --- text to number --------------------------------------------------------------------------
def drive_points(result: Column) -> Column:
    r = F.lower(F.coalesce(result, F.lit("")))
    return (F.when(r.contains("touchdown"), 7).when(r.contains("field goal"), 3).when(r.contains("safety"), 2)
            .otherwise(0))


# fixed values: chance to play by report status
AVAILABILITY = {"OUT": 0.0, "DOUBTFUL": 0.15, "QUESTIONABLE": 0.50, "PROBABLE": 0.85, "IR": 0.0, "IR-R": 0.0,
                "PUP": 0.0, "NFI": 0.0, "SUSPENDED": 0.0}


def availability(status: Column) -> Column:
    return lookup(F.upper(F.trim(F.coalesce(status, F.lit("")))), AVAILABILITY, 1.0)


# --- utilization bands ---------------------------------------------------------------------------
def utilization_tier(score: Column) -> Column:
    return at_least(score, [(80, "Elite"), (70, "Strong"), (60, "Average"), (50, "Below Average")], "Low")


def expected_ppg(score: Column, position: Column, part: int) -> Column:
    """part 0 = low end, 1 = mean, 2 = high end of points per game for a utilization score."""
    def ladder(bands):
        # a score outside every band (below 0, or 100 and up) takes the top band
        out = F.when((score < 0) | (score >= 100), F.lit(bands[-1][2 + part]))
        for lo, hi, *vals in bands:
            out = out.when((score >= lo) & (score < hi), F.lit(vals[part]))
        return out
    return lookup(position, {p: ladder(b) for p, b in C.PPG_BANDS.items()}, ladder(C.PPG_BANDS["RB"]))
