"""Inferential statistics: grouped moments in SQL, distribution tails in small driver functions.

Tails use the regularised incomplete beta function (continued fraction), the exact signed-rank distribution for small
samples, and Royston's approximation for the W test of normality.
"""

from __future__ import annotations

from math import asin, erfc, exp, lgamma, log, pi, sqrt
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.plans.layout import with_index, written
from driftspark.plans.scan import MAX, MIN, running

_N = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or 1e-300)
        c = (1 + term / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1) if f != 1 else front


def t_sf(t: float, df: float) -> float:
    p = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return p if t >= 0 else 1 - p


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_ppf(q: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < q else (low, mid)
    return (low + high) / 2


def wilcoxon_p(differences: list[float]) -> float | None:
    """Two-sided signed-rank p: exact without ties up to 50 values, else normal with tie and continuity correction."""
    d = [x for x in differences if x]
    if not d:
        return None
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    rank, i, ties = [0.0] * len(d), 0, 0
    while i < len(d):
        j = i
        while j + 1 < len(d) and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            rank[order[k]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    n = len(d)
    plus = sum(r for r, x in zip(rank, d, strict=True) if x > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if not ties and n <= 50 and n == len(differences):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    sd = sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, erfc(abs((w - n * (n + 1) / 4 + 0.5) / sd) / sqrt(2))) if sd else None


def shapiro_p(values: list[float]) -> float | None:
    """p of the W test of normality (3 to 5000 values)."""
    x, n = sorted(values), len(values)
    if n < 3 or x[0] == x[-1]:
        return None
    m = [_N.inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    ss, u = sum(v * v for v in m), 1 / sqrt(n)
    if n == 3:
        a = [-sqrt(0.5), 0.0, sqrt(0.5)]
    else:
        # fixed values: polynomial coefficients of the published approximation
        last = m[-1] / sqrt(ss) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        if n > 5:
            second = m[-2] / sqrt(ss) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *(v / sqrt(phi) for v in m[2:-2]), second, last]
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(v / sqrt(phi) for v in m[1:-1]), last]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return max(0.0, 6 / pi * (asin(sqrt(w)) - asin(sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        z = (-log(g - log(1 - w)) - mu) / sigma if g > log(1 - w) else float("inf")
    else:
        k = log(n)
        mu = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
        z = (log(1 - w) - mu) / exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return 1 - _N.cdf(z)


def effect_sizes(pairs: DataFrame, *by: str, x: str = "x", y: str = "y") -> DataFrame:
    """n, mean_diff, std_diff, t, dz, gz of paired differences; dz is 0 where the differences do not vary."""
    d = F.col(x) - F.col(y)
    m = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"))
    sd = F.nullif(F.col("std_diff"), F.lit(0.0))
    dz = F.coalesce(F.col("mean_diff") / sd, F.lit(0.0))
    shrink = F.when(F.col("n") > 2, 1 - 3 / (4.0 * (F.col("n") - 1) - 1)).otherwise(1.0)
    t = F.col("mean_diff") / (sd / F.sqrt("n"))
    return m.where("n >= 2").select(*by, "n", "mean_diff", "std_diff", t.alias("t"), dz.alias("dz"), (dz * shrink).alias("gz"))


def paired_comparison(a: list[float], b: list[float], policy_a: str, policy_b: str, alpha: float = 0.05) -> dict:
    """All figures of a paired comparison of few runs; tails are computed on the driver."""
    if len(a) != len(b) or len(a) < 2:
        raise ValueError("paired samples need the same length, two at least")
    d = [p - q for p, q in zip(a, b, strict=True)]
    n, mean = len(d), sum(d) / len(d)
    sd = sqrt(sum((v - mean) ** 2 for v in d) / (n - 1))
    se = sd / sqrt(n)
    t = mean / se if se else None
    half = t_ppf(1 - alpha / 2, n - 1) * se
    dz = mean / sd if sd else 0.0
    p = None if t is None else 2 * t_sf(abs(t), n - 1)
    w = wilcoxon_p(d)
    digits = lambda v, k: None if v is None else round(v, k)
    return {
        "policy_a": policy_a, "policy_b": policy_b, "n_seeds": n, "mean_diff": round(mean, 5), "std_diff": round(sd, 5), "se_diff": round(se, 5),
        "ci_95": (round(mean - half, 5), round(mean + half, 5)), "t_statistic": digits(t, 4), "t_pvalue": digits(p, 6),
        "shapiro_pvalue": digits(shapiro_p(d), 4), "wilcoxon_statistic": None if w is None else signed_rank(d), "wilcoxon_pvalue": digits(w, 6),
        "cohens_dz": round(dz, 4), "hedges_gz": round(dz * (1 - 3 / (4 * (n - 1) - 1)) if n > 2 else dz, 4),
        "significant_at_alpha": p is not None and p < alpha,
    }


def signed_rank(d: list[float]) -> float:
    """The smaller of the rank sums of positive and negative differences; zeros take no part, ties share their mean rank."""
    x = sorted((abs(v), v > 0) for v in d if v)
    up = down = 0.0
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[j][0] == x[i][0]:
            j += 1
        positive = sum(s for _, s in x[i:j])
        up, down = up + positive * (i + 1 + j) / 2, down + (j - i - positive) * (i + 1 + j) / 2
        i = j
    return min(up, down)


def compare_policies(runs: DataFrame, a: str, b: str, metric: str, policy: str = "policy", seed: str = "seed", alpha: float = 0.05) -> dict:
    """All figures of a paired comparison of two policies over a table of runs, aligned on seed (one row a seed)."""
    side = lambda p, name: runs.where(F.col(policy) == p).select(seed, F.col(metric).cast("double").alias(name))
    rows = side(a, "x").join(side(b, "y"), seed).orderBy(seed).collect()  # a seed is a run: few
    return paired_comparison([r["x"] for r in rows], [r["y"] for r in rows], a, b, alpha)


def _ranked(p_values: DataFrame) -> tuple[DataFrame, int]:
    """p_values with i, their rank by (p, pos) from 1, and their number; ranks are made without a sort in one task."""
    placed = written(with_index(p_values, "p", "pos", name="_at"), "p_values")
    return placed.withColumn("i", F.col("_at") + 1), placed.count()


def holm_sidak(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """pos, p, adjusted, rejected (per step). The running maximum of the steps is a prefix scan, so the tests of a family
    may be any number."""
    ranked, m = _ranked(p_values)
    left = F.lit(m) - F.col("i") + 1
    inside = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    raw = 1 - F.pow(1 - inside, left)
    step = 1 - F.pow(F.lit(1 - alpha), 1.0 / left)
    out = running(ranked, {"_max": (MAX, raw)}, index="_at")
    return out.select("pos", "p", F.least("_max", F.lit(1.0)).alias("adjusted"), (F.col("p") <= step).alias("rejected"))


def benjamini_hochberg(p_values: DataFrame, q: float = 0.05) -> DataFrame:
    """pos, p, adjusted, rejected; the running minimum from the largest p down is a prefix scan."""
    ranked, m = _ranked(p_values)
    down = ranked.withColumn("_down", F.lit(m) - F.col("i"))
    out = running(down, {"_min": (MIN, F.col("p") * m / F.col("i"))}, index="_down")
    adjusted = F.least("_min", F.lit(1.0))
    return out.select("pos", "p", adjusted.alias("adjusted"), (adjusted <= q).alias("rejected"))


def two_way_anova(df: DataFrame, metric: str, a: str, b: str) -> DataFrame:
    """One row: sums of squares, degrees of freedom, F and partial eta squared of a, b, their interaction, and error."""
    kept = df.na.drop(subset=[metric])
    g = kept.groupingSets([[a, b], [a], [b], []], a, b).agg(
        F.grouping_id().alias("_g"), F.count(metric).alias("n"), F.avg(metric).alias("m"), F.sum(F.col(metric) * F.col(metric)).alias("q")
    )
    total = g.where("_g = 3").select(F.col("n").alias("n"), F.col("m").alias("mean"), F.col("q").alias("sq"))
    rows = g.where("_g < 3").crossJoin(F.broadcast(total.select("mean")))
    between = F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)
    part = rows.agg(
        F.sum(F.when(F.col("_g") == 1, between)).alias("ss_a"),
        F.sum(F.when(F.col("_g") == 2, between)).alias("ss_b"),
        F.sum(F.when(F.col("_g") == 0, between)).alias("ss_cells"),
        F.count_if(F.col("_g") == 1).alias("ka"),
        F.count_if(F.col("_g") == 2).alias("kb"),
    )
    one = part.crossJoin(total).withColumn("ss_total", F.col("sq") - F.col("n") * F.col("mean") * F.col("mean"))
    one = one.withColumn("ss_ab", F.greatest(F.col("ss_cells") - F.col("ss_a") - F.col("ss_b"), F.lit(0.0)))
    one = one.withColumn("ss_err", F.greatest(F.col("ss_total") - F.col("ss_a") - F.col("ss_b") - F.col("ss_ab"), F.lit(1e-12)))
    one = one.withColumn("df_a", F.col("ka") - 1).withColumn("df_b", F.col("kb") - 1)
    one = one.withColumn("df_ab", F.col("df_a") * F.col("df_b"))
    one = one.withColumn("df_err", F.greatest(F.col("n") - F.col("ka") * F.col("kb"), F.lit(1)))
    out = ["ss_a", "ss_b", "ss_ab", "ss_err", "df_a", "df_b", "df_ab", "df_err"]
    f = lambda x: ((F.col(f"ss_{x}") / F.nullif(F.col(f"df_{x}"), F.lit(0))) / (F.col("ss_err") / F.col("df_err")))
    eta = lambda x: F.col(f"ss_{x}") / (F.col(f"ss_{x}") + F.col("ss_err"))
    return one.where("ka >= 2 and kb >= 2").select(
        *out, *(f(x).alias(f"f_{x}") for x in ("a", "b", "ab")), *(eta(x).alias(f"eta_{x}") for x in ("a", "b", "ab"))
    )


def kendalls_w(df: DataFrame, metric: str, policy: str, regime: str) -> DataFrame:
    """One row: w, concordant (w >= 0.7): agreement of the regimes about the order of the policies' means."""
    means = df.na.drop(subset=[metric]).groupBy(regime, policy).agg(F.avg(metric).alias("m"))
    ties = Window.partitionBy(regime, "m")
    rank = F.rank().over(Window.partitionBy(regime).orderBy("m")) + (F.count("*").over(ties) - 1) / 2.0
    sums = means.withColumn("r", rank).groupBy(policy).agg(F.sum("r").alias("r"), F.count("*").alias("m"))
    one = sums.agg(F.var_pop("r").alias("v"), F.count("*").alias("k"), F.max("m").alias("m"))
    bottom = F.pow("m", F.lit(2)) * (F.pow("k", F.lit(3)) - F.col("k")) / 12
    w = F.when(bottom > 0, F.col("v") * F.col("k") / F.nullif(bottom, F.lit(0.0))).otherwise(0.0)
    return one.select(w.alias("w"), (w >= 0.7).alias("concordant"))
