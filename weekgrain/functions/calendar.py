"""Football calendar as column expressions over a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_of(d: Column) -> Column:
    """September to December belong to their year, January to August to the year before."""
    return F.when(F.month(d) <= 8, F.year(d) - 1).otherwise(F.year(d))


def season_start(season: Column) -> Column:
    """First Thursday of September."""
    return F.next_day(F.make_date(season, F.lit(8), F.lit(31)), "Thu")


def _between(d: Column, season: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    day = lambda md: F.make_date(season + 1, F.lit(md[0]), F.lit(md[1]))
    return d.between(day(first), day(last))


def week_of(d: Column) -> Column:
    """0 before the season, 1-18 regular, 19-22 playoffs; later dates stay at 18."""
    s = season_of(d)
    start = season_start(s)
    regular = F.least(F.greatest(F.floor(F.date_diff(d, start) / 7) + 1, F.lit(1)), F.lit(18))
    # fixed values: playoff windows of January and February
    return (F.when(_between(d, s, (1, 27), (2, 9)), 22).when(_between(d, s, (1, 19), (1, 26)), 21)
            .when(_between(d, s, (1, 17), (1, 19)), 20).when(_between(d, s, (1, 10), (1, 13)), 19)
            .when(d < start, 0).otherwise(regular)).cast("int")


def is_off_season(d: Column) -> Column:
    """After the final and before the next first Thursday."""
    s = season_of(d)
    return (d > F.make_date(s + 1, F.lit(2), F.lit(9))) & (d < season_start(s + 1))


def _digit(n: Column, one: str, five: str, ten: str) -> Column:
    words = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    return F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))


def roman(n: Column) -> Column:
    """Roman numeral below 1000."""
    return F.concat(_digit(F.floor(n / 100) % 10, "C", "D", "M"), _digit(F.floor(n / 10) % 10, "X", "L", "C"), _digit(n % 10, "I", "V", "X"))


def week_label(week: Column, season: Column | None = None) -> Column:
    final = F.lit("Super Bowl") if season is None else F.concat(F.lit("Super Bowl "), roman(season - 1966))
    return (F.when(week <= 0, "Preseason").when(week == 19, "Wild Card").when(week == 20, "Divisional Round")
            .when(week == 21, "Conference Championships").when(week == 22, final).otherwise(F.concat(F.lit("Week "), week.cast("string"))))


def next_weeks(d: Column, n: int) -> Column:
    """Array of the next n (season, week), rolling over into the next season after week 22."""
    s, w = season_of(d), week_of(d)
    over = (w == 22) | (d > F.make_date(s + 1, F.lit(2), F.lit(9)))
    first_season = F.when(over, s + 1).otherwise(s)
    first_week = F.when(over, 1).otherwise(F.greatest(w, F.lit(1)))
    at = lambda k: first_week - 1 + k
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(
        (first_season + F.floor(at(k) / 22)).cast("int").alias("season"), (at(k) % 22 + 1).cast("int").alias("week")))


def is_current_or_future(season: Column, week: Column, today: Column) -> Column:
    s = season_of(today)
    return (season > s) | ((season == s) & (week >= week_of(today)))
