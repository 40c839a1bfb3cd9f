"""Statistics of paired and repeated runs: seed summaries, bootstrap, signed ranks, Holm's correction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernway.functions.scalar import first_digits, hashed_digits
from fernway.operators.rounds import sum_before

#: Values of one group that a bootstrap holds at most; larger groups use :func:`bootstrap_hashed`.
MOST_VALUES = 1_000_000
#: Values of a group up to which all are counted one by one for its percentiles.
SMALL = 50_000
#: Pairs up to which the signed-rank test is exact.
EXACT_PAIRS = 50


def clean(column: str) -> Column:
    """The column with NaN as null."""
    return F.nullif(F.col(column), F.lit(float("nan")))


def seed_summary(rows: DataFrame, groups: list[str], value: str, seed: str = "query_seed") -> DataFrame:
    """groups, n_seeds, mean_of_seeds: the mean over seeds of each seed's mean; null keys are kept."""
    per_seed = rows.groupBy(*groups, seed).agg(F.avg(clean(value)).alias("m"))
    return per_seed.groupBy(*groups).agg(F.count("m").alias("n_seeds"), F.avg("m").alias("mean_of_seeds"))


def worst_of_seeds(rows: DataFrame, groups: list[str], value: str, seed: str = "query_seed") -> DataFrame:
    """groups, n_seeds, mean_worst: the mean over seeds of each seed's largest value."""
    per_seed = rows.groupBy(*groups, seed).agg(F.max(clean(value)).alias("m"))
    return per_seed.groupBy(*groups).agg(F.count("m").alias("n_seeds"), F.avg("m").alias("mean_worst"))


def bootstrap(rows: DataFrame, groups: list[str], value: str, *, draws: int = 10_000, level: float = 0.95, seed: int = 42, statistic=np.mean) -> DataFrame:
    """groups, point, ci_low, ci_high, n by resampling each group's values; null and NaN are left out.

    One value gives itself three times; none gives nulls. The values of a group are meant to be few (a mean per seed); a group of
    more than ``MOST_VALUES`` fails, as it would not fit in a task, and :func:`bootstrap_hashed` takes its place.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{g}` {types[g]}" for g in groups], "point double, ci_low double, ci_high double, n long"])
    values = rows.select(*groups, clean(value).cast("double").alias("_v"))

    def resample(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(group["_v"].dropna().to_numpy())
        if len(v) > MOST_VALUES:
            raise ValueError("too many values in one group")
        if len(v) == 0:
            found = (None, None, None)
        elif len(v) == 1:
            found = (v[0],) * 3
        else:
            random, block, sampled = np.random.default_rng(seed), max(1, 1_000_000 // len(v)), []
            for start in range(0, draws, block):
                at = random.integers(0, len(v), (min(block, draws - start), len(v)))
                sampled.append(statistic(v[at], axis=1))
            low, high = np.percentile(np.concatenate(sampled), [50 * (1 - level), 100 - 50 * (1 - level)])
            found = (statistic(v), low, high)
        return pd.DataFrame([(*keys, *found, len(v))], columns=[*groups, "point", "ci_low", "ci_high", "n"])

    return values.groupBy(*groups).applyInPandas(resample, schema)


def poisson_steps() -> list[tuple[float, int]]:
    """The distribution function of a Poisson number of mean one, with the number: it is the first whose bound is above a number in (0, 1)."""
    steps, total, at = [], 0.0, math.exp(-1)
    for k in range(9):
        total += at
        steps.append((total, k))
        at /= k + 1
    return steps


def bootstrap_hashed(rows: DataFrame, groups: list[str], value: str, *, key: str, draws: int = 200, level: float = 0.95) -> DataFrame:
    """As :func:`bootstrap` of the mean for groups of any size: each value counts in each draw as often as a Poisson number hashed from
    its key and the draw says, so that the draws are sums and nothing is gathered."""
    v = rows.select(*groups, clean(value).alias("_v"), F.col(key).alias("_k")).dropna(subset=["_v"])
    drawn = v.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_d"))
    # The digest has a column of its own, so that it is taken once for all bounds.
    digest = drawn.withColumn("_h", hashed_digits(F.col("_k").cast("string"), F.col("_d").cast("string")))
    times = F.lit(9)
    for bound, k in reversed(poisson_steps()):
        times = F.when(F.col("_h") < first_digits(bound), F.lit(k)).otherwise(times)
    means = digest.withColumn("_t", times).groupBy(*groups, "_d").agg(F.try_divide(F.sum(F.col("_v") * F.col("_t")), F.sum("_t")).alias("_m"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*groups).agg(F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1 - tail)).alias("ci_high"))
    points = v.groupBy(*groups).agg(F.avg("_v").alias("point"), F.count("*").alias("n"))
    return points.join(bounds, groups) if groups else points.crossJoin(bounds)


def signed_ranks(pairs: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """The pairs that differ with diff and the mid-rank of its size within the group.

    Sizes are counted, and the numbers of smaller ones summed by ranges, so that no task holds a group; what is alike in size shares a row.
    """
    d = pairs.withColumn("diff", F.col(a) - F.col(b)).where("diff <> 0").withColumn("_size", F.abs("diff"))
    sizes = d.groupBy(*groups, "_size").agg(F.count("*").alias("_n"))
    ranked = sum_before(sizes, groups, ["_size"], "_n", "_before").withColumn("mid_rank", F.col("_before") + (F.col("_n") + 1) / F.lit(2.0))
    same = F.col("_size") == F.col("_of_size")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return d.join(ranked.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_size").alias("_of_size"), "mid_rank"), same).select(*pairs.columns, "diff", "mid_rank")


def percentiles(rows: DataFrame, groups: list[str], value: str, quantiles: tuple[float, ...], *, small: int = SMALL, accuracy: int = 1000) -> DataFrame:
    """groups and ``q``, an array of the exact percentiles (between two ranks in proportion) of each group; nulls are left out.

    Of a group of more than ``small`` values a sketch gives bounds of each percentile, two in ``accuracy`` of the ranks to either side; only
    values within are counted one by one, those below in one sum. A smaller group's values are all counted. Values that are alike are one
    row, so that a task holds a few thousandths of a large group's different values.
    """
    margin, k = 2 / accuracy, len(quantiles)
    bounds = [max(0.0, q - margin) for q in quantiles] + [min(1.0, q + margin) for q in quantiles]
    known = rows.select(*groups, F.col(value).cast("double").alias("_v")).dropna(subset=["_v"])
    sketch = known.groupBy(*groups).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, bounds)), F.lit(accuracy)).alias("_b"))
    large = F.col("_n") > small
    # One band for each percentile of a large group, one for all of a small one's.
    low = [F.when(large, F.get("_b", F.lit(i))).otherwise(F.lit(float("-inf"))) for i in range(k)]
    high = [F.when(large, F.get("_b", F.lit(k + i))).otherwise(F.lit(float("inf"))) for i in range(k)]
    sketch = sketch.withColumn("_bands", F.when(large, F.array(*[F.struct(F.lit(i).alias("i"), lo.alias("low"), hi.alias("high")) for i, (lo, hi) in enumerate(zip(low, high, strict=True))])).otherwise(F.array(F.struct(F.lit(0).alias("i"), low[0].alias("low"), high[0].alias("high")))))
    named = sketch.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_n", "_bands")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    told = (known.join(named, same) if groups else known.crossJoin(F.broadcast(named))).select(*groups, "_v", "_n", "_bands")
    # A value below a band counts in one row of the band, with a null value.
    place = F.transform(F.filter("_bands", lambda b: F.col("_v") <= b["high"]), lambda b: F.struct(b["i"].alias("i"), F.when(F.col("_v") >= b["low"], F.col("_v")).alias("v")))
    counted = told.select(*groups, "_n", F.explode(place).alias("_p")).groupBy(*groups, "_n", F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*groups, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto)).where(F.col("_v").isNotNull())
    wanted = []
    for i, q in enumerate(quantiles):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        band = F.when(F.col("_n") > small, F.lit(i)).otherwise(F.lit(0))
        for rank, name in ((F.floor(at), f"_l{i}"), (F.ceil(at), f"_h{i}")):
            wanted.append(F.min(F.when((F.col("_i") == band) & (F.col("_upto") > rank), F.col("_v"))).alias(name))
    found = ranked.groupBy(*groups).agg(F.first("_n").alias("_n"), *wanted)

    def between(i: int, q: float) -> Column:
        at = F.lit(float(q)) * (F.col("_n") - 1)
        share = at - F.floor(at)
        return F.when(share == 0, F.col(f"_l{i}")).otherwise((1 - share) * F.col(f"_l{i}") + share * F.col(f"_h{i}"))

    return found.select(*groups, F.array(*[between(i, q) for i, q in enumerate(quantiles)]).alias("q"))


def _p_value(n: int, w: float, ties: float) -> float:
    """Two-sided p of the smaller rank sum: exact for few pairs without ties, else normal with correction for ties."""
    if n == 0:
        return math.nan
    if n <= EXACT_PAIRS and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - mean) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 else math.nan


def wilcoxon(pairs: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """groups, n_pairs, n_zero, w_plus, w_minus, statistic, effect and p of the paired signed-rank test.

    effect: (w_plus - w_minus) over their sum, 0 without pairs; p null then.
    """
    ranked = signed_ranks(pairs, groups, a, b)
    tie_sizes = ranked.groupBy(*groups, F.abs("diff").alias("_s")).count().groupBy(*groups).agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("ties"))
    sums = ranked.groupBy(*groups).agg(
        F.count("*").alias("n_pairs"),
        F.sum(F.when(F.col("diff") > 0, F.col("mid_rank")).otherwise(F.lit(0.0))).alias("w_plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("mid_rank")).otherwise(F.lit(0.0))).alias("w_minus"),
    )
    every = pairs.groupBy(*groups).agg(F.count_if(F.col(a) == F.col(b)).alias("n_zero"))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([_p_value(int(x), y, z) for x, y, z in zip(n, w, ties, strict=True)])

    joined = every.join(sums, groups, "left").join(tie_sizes, groups, "left").fillna(0, ["n_pairs"]).fillna(0.0, ["w_plus", "w_minus", "ties"])
    least = F.least("w_plus", "w_minus")
    return joined.withColumns(
        {"statistic": least, "effect": F.coalesce(F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")), F.lit(0.0)), "p": F.nullif(p_value("n_pairs", least, "ties"), F.lit(float("nan")))}
    ).drop("ties")


def holm(rows: DataFrame, groups: list[str], p: str, *, order: str, alpha: float = 0.05) -> DataFrame:
    """The rows with p_adjusted and reject by Holm's step-down; a null or NaN p fails."""
    valid = F.when(F.col(p).isNull() | F.isnan(p), F.raise_error(F.lit("a p-value is missing"))).otherwise(F.col(p))
    by_p = Window.partitionBy(*groups).orderBy(p, order)
    i, m = F.row_number().over(by_p) - 1, F.count("*").over(Window.partitionBy(*groups))
    df = rows.withColumn(p, valid).withColumns({"_i": i, "_m": m})
    so_far = by_p.rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_i")))
    passed = F.min(F.when(F.col(p) <= F.lit(alpha) / (F.col("_m") - F.col("_i")), 1).otherwise(0)).over(so_far)
    return df.withColumns({"p_adjusted": F.max(scaled).over(so_far), "reject": passed == 1}).drop("_i", "_m")
