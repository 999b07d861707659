"""Exact ranks and quantiles inside groups of any size.

A window ordered by value puts a whole group in one task, and the exact
percentile aggregate keeps every distinct value of a group in one buffer. Neither
survives a group that holds a third of a large table. The *value ladder* does:

1. reduce to distinct (group, value) with counts (map-side combine absorbs ties);
2. pick splitters: the distinct values with the smallest hashes, a fixed number
   per group. They depend only on the set of values, so a re-run task after a lost
   executor sees the same split;
3. count per (group, interval), prefix-sum those few counts;
4. finish the running count inside each interval, one task per interval.

Ranks, percent ranks, cumulative gaps and the area under a curve all read off the
ladder. Quantiles stop after step 3 for all intervals but those that hold a wanted
order statistic: only these are put in order.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _splits(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(15, min(1023, 2 * parts - 1))


def _interval(cuts: Column, value: Column, splits: int) -> Column:
    """Number of cuts <= value, by binary search."""
    steps = []
    step = 1
    while step <= splits:
        steps.append(step)
        step *= 2
    probe = F.array(*[F.lit(s) for s in reversed(steps)])
    found = F.aggregate(
        probe, F.lit(0),
        lambda acc, s: F.when((acc + s <= F.size(cuts)) & (F.get(cuts, acc + s - 1) <= value), acc + s).otherwise(acc),
    )
    return F.when(value.isNull(), F.lit(splits + 1)).otherwise(found)


def _placed(df: DataFrame, groups: list[str], value: str, splits: int, counts: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """Distinct values of each group (``v``) with their counts and interval ``_b``, and the names that the group columns have there."""
    gcols = [f"_g{i}" for i in range(len(groups))] or ["_g0"]
    gsrc = [F.col(g).alias(a) for g, a in zip(groups, gcols)] or [F.lit(0).alias("_g0")]
    v = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        v = v + F.lit(0.0)  # one zero
    d = df.groupBy(*gsrc, v.alias("v")).agg(*[c.alias(k) for k, c in counts.items()])
    sample = Window.partitionBy(*gcols).orderBy(F.xxhash64("v"), "v")
    cuts = (d.where(F.col("v").isNotNull()).select(*gcols, "v").withColumn("_rn", F.row_number().over(sample))
            .where(F.col("_rn") <= splits)
            .groupBy(*[F.col(g).alias(f"{g}c") for g in gcols]).agg(F.sort_array(F.collect_list("v")).alias("_cuts")))
    on = [F.col(g).eqNullSafe(F.col(f"{g}c")) for g in gcols]
    placed = d.join(cuts, _all(on), "left").select(
        *gcols, "v", *counts,
        F.when(F.col("_cuts").isNull(), F.lit(splits + 1)).otherwise(_interval(F.col("_cuts"), F.col("v"), splits)).alias("_b"))
    return placed, gcols


def value_ladder(df: DataFrame, groups: list[str], value: str, splits: int | None = None,
                 parts: dict[str, Column] | None = None) -> DataFrame:
    """Rows (groups, v, n, below, total): ``below`` counts group rows with a smaller value; nulls come last.

    ``parts`` maps names to row conditions and adds n_, below_ and total_ columns that count only those rows.
    """
    splits = splits or _splits(df)
    parts = parts or {}
    counts = {"n": F.count(F.lit(1))} | {f"n_{k}": F.sum(F.when(c, 1).otherwise(0)) for k, c in parts.items()}
    placed, gcols = _placed(df, groups, value, splits, counts)
    # One exchange by interval serves both branches below. It is spelled out because a shuffled join on the
    # group alone would count as clustered by (group, interval) and leave a hot group in one task.
    placed = placed.repartition(*gcols, "_b")
    sums = placed.groupBy(*gcols, "_b").agg(*[F.sum(k).alias(f"_m_{k}") for k in counts])
    by_group = Window.partitionBy(*gcols)
    earlier = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    base = sums.select(*[F.col(g).alias(f"{g}r") for g in gcols], F.col("_b").alias("_br"),
                       *[F.coalesce(F.sum(f"_m_{k}").over(earlier), zero).alias(f"_base_{k}") for k in counts],
                       *[F.sum(f"_m_{k}").over(by_group).alias(f"_total_{k}") for k in counts])
    inside = Window.partitionBy(*gcols, "_b").orderBy(F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumns({f"_in_{k}": F.coalesce(F.sum(k).over(inside), zero) for k in counts})
    on2 = [F.col(g).eqNullSafe(F.col(f"{g}r")) for g in gcols] + [F.col("_b") == F.col("_br")]
    out = run.join(base, _all(on2))
    names = [F.col(a).alias(g) for g, a in zip(groups, gcols)]
    tail = lambda k: k[1:]  # "" for the plain count, "_name" for a part
    return out.select(*names, "v", *counts, *[(F.col(f"_in_{k}") + F.col(f"_base_{k}")).alias(f"below{tail(k)}") for k in counts],
                      *[F.col(f"_total_{k}").alias(f"total{tail(k)}") for k in counts])


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _sort_key(df: DataFrame, value: str, ascending: bool, places: int) -> Column:
    key = F.col(value) if ascending else -F.col(value)
    return F.round(key, places) + F.lit(0.0) if dict(df.dtypes)[value] in ("double", "float") else key


def with_ranks(df: DataFrame, specs: list[tuple], places: int = 9) -> DataFrame:
    """Adds several ranks, each given as (groups, value, out, method, ascending).

    method: ``min`` (competition), ``average``, ``pct`` (average / group rows). Nulls rank last.
    Doubles tie at ``places`` decimals: the order in which a mean was summed must not decide a rank.
    All ladders hang off the same input, so the plan grows with the number of ranks and not with its power.
    """
    keyed = df.withColumns({f"_key{i}": _sort_key(df, value, asc, places) for i, (_, value, _, _, asc) in enumerate(specs)})
    out = keyed
    for i, (groups, _, name, method, _) in enumerate(specs):
        ladder = value_ladder(keyed, groups, f"_key{i}")
        low, n, total = F.col("below") + 1, F.col("n"), F.col("total")
        rank = {"min": low.cast("long"), "average": low + (n - 1) / 2.0, "pct": (low + (n - 1) / 2.0) / total}[method]
        ranked = ladder.select(*[F.col(g).alias(f"_r_{g}") for g in groups], F.col("v").alias("_rv"), rank.alias(name))
        cond = [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in groups] + [F.col(f"_key{i}").eqNullSafe(F.col("_rv"))]
        out = out.join(ranked, _all(cond)).drop("_rv", *[f"_r_{g}" for g in groups])
    return out.drop(*[f"_key{i}" for i in range(len(specs))])


def with_rank(df: DataFrame, groups: list[str], value: str, out: str, method: str = "min", ascending: bool = True) -> DataFrame:
    """One rank, see :func:`with_ranks`."""
    return with_ranks(df, [(groups, value, out, method, ascending)])


def quantiles(df: DataFrame, groups: list[str], value: str, qs: dict[str, float],
              splits: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one column per entry of ``qs``, plus ``n``.

    All wanted order statistics of all groups are selected together: values are counted per interval, and only the values of intervals that hold one
    of the statistics are put in order.
    """
    splits = splits or _splits(df)
    placed, gcols = _placed(df.where(F.col(value).isNotNull()), groups, value, splits, {"n": F.count(F.lit(1))})
    placed = placed.repartition(*gcols, "_b")  # one exchange for both branches below
    by_group = Window.partitionBy(*gcols)
    counts = placed.groupBy(*gcols, "_b").agg(F.sum("n").alias("_m"))
    counts = counts.select(*gcols, "_b", "_m", (F.sum("_m").over(by_group.orderBy("_b")) - F.col("_m")).alias("_base"), F.sum("_m").over(by_group).alias("total"))
    wanted = {}  # rank (counted from 0) of each end of each quantile
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("total") - 1)
        wanted |= {f"{name}_lo": F.floor(pos), f"{name}_hi": F.ceil(pos)}
    holds = [(F.col("_base") <= idx) & (idx < F.col("_base") + F.col("_m")) for idx in wanted.values()]
    held = counts.where(reduce(or_, holds)).select(*[F.col(g).alias(f"{g}r") for g in gcols], F.col("_b").alias("_br"), "_base", "total")
    near = placed.join(held, _all([F.col(g).eqNullSafe(F.col(f"{g}r")) for g in gcols] + [F.col("_b") == F.col("_br")]))
    inside = Window.partitionBy(*gcols, "_b").orderBy("v")
    near = near.withColumn("below", F.col("_base") + F.sum("n").over(inside) - F.col("n"))
    hit = lambda idx: (F.col("below") <= idx) & (idx < F.col("below") + F.col("n"))
    agg = near.groupBy(*gcols).agg(F.max("total").alias("_n"), *[F.max(F.when(hit(idx), F.col("v").cast("double"))).alias(k) for k, idx in wanted.items()])
    agg = agg.select(*[F.col(a).alias(g) for g, a in zip(groups, gcols)], F.col("_n").alias("n"), *wanted)
    outs = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return agg.select(*groups, "n", *outs)


def expanding_quantile(df: DataFrame, period: list[str], value: str, q: float, out: str, splits: int = 255) -> DataFrame:
    """Exact quantile of all values of strictly earlier periods: rows (period, out, n).

    Counts per (value interval, period) tell, for every period, which interval holds the
    wanted order statistic; only the rows of that interval are then looked at again. Work
    is rows + periods x (rows / splits), not rows x periods.
    """
    calendar = df.select(*period).distinct()
    calendar = calendar.withColumn("_i", F.row_number().over(Window.orderBy(*period)))  # one row per period
    d = (df.where(F.col(value).isNotNull()).groupBy(*period, F.col(value).cast("double").alias("v"))
         .agg(F.count(F.lit(1)).alias("n")).join(calendar, period).select("_i", "v", "n"))
    pick = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("v"), "v")
    cuts = (d.select("v").distinct().withColumn("_rn", F.row_number().over(pick)).where(F.col("_rn") <= splits)
            .agg(F.sort_array(F.collect_list("v")).alias("_cuts")))  # one row of at most `splits` values
    placed = d.join(F.broadcast(cuts)).select("_i", "v", "n", _interval(F.col("_cuts"), F.col("v"), splits).alias("_b"))
    counts = placed.groupBy("_b", "_i").agg(F.sum("n").alias("m"))
    grid = calendar.select(F.col("_i"), F.explode(F.sequence(F.lit(0), F.lit(splits))).alias("_b"))
    over_time = Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    at = (grid.join(counts, ["_b", "_i"], "left")
          .select("_b", "_i", F.coalesce(F.sum("m").over(over_time), F.lit(0)).alias("m")))
    over_values = Window.partitionBy("_i")
    at = at.select("_b", "_i", "m", F.sum("m").over(over_values).alias("total"),
                   (F.sum("m").over(over_values.orderBy("_b")) - F.col("m")).alias("below"))
    pos = F.lit(float(q)) * (F.col("total") - 1)
    wanted = at.where(F.col("total") > 0).select(
        F.col("_b"), F.col("_i").alias("_j"), "below", "m", "total",
        F.explode(F.array(F.struct(F.lit("lo").alias("end"), F.floor(pos).alias("at")),
                          F.struct(F.lit("hi").alias("end"), F.ceil(pos).alias("at")))).alias("w"),
    ).where((F.col("below") <= F.col("w.at")) & (F.col("w.at") < F.col("below") + F.col("m")))
    near = (placed.join(wanted, "_b").where(F.col("_i") < F.col("_j"))
            .groupBy("_j", "w", "below", "total", "v").agg(F.sum("n").alias("n")))
    run = F.sum("n").over(Window.partitionBy("_j", "w").orderBy("v"))
    hit = near.withColumn("_to", F.col("below") + run).where((F.col("_to") > F.col("w.at")) & (F.col("_to") - F.col("n") <= F.col("w.at")))
    ends = hit.groupBy("_j").agg(F.max(F.when(F.col("w.end") == "lo", F.col("v"))).alias("lo"),
                                 F.max(F.when(F.col("w.end") == "hi", F.col("v"))).alias("hi"), F.max("total").alias("n"))
    pos = F.lit(float(q)) * (F.col("n") - 1)
    joined = calendar.join(ends, F.col("_i") == F.col("_j"), "left")
    return joined.select(*period, (F.col("lo") + (F.col("hi") - F.col("lo")) * (pos - F.floor(pos))).alias(out),
                         F.coalesce("n", F.lit(0)).alias("n"))


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "component", value: str = "value") -> DataFrame:
    """Long form of the known values of several numeric columns, so that one ladder serves them all."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*ids, F.explode(F.filter(pairs, lambda p: p[value].isNotNull())).alias("_p")).select(*ids, f"_p.{name}", f"_p.{value}")


def first_rows(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per group. Spark limits each task to k rows per group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= k)
