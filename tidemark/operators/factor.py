"""Cross-sections and factors: residuals, quantile tables, rank correlations, pairs, lead-lag signals."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.maths import correlation, normal_tail, ratio
from ..sources.tables import stored
from .windows import cross_rank, exact_quantiles, over, spread_rank, spread_ranks


def quantile_buckets(df: DataFrame, by: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """Bucket 1..n by interpolated quantile edges, closed to the right; equal edges count once. Not ntile, which splits by rows."""
    shares = [i / n for i in range(n + 1)]
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("_q")) if by else exact_quantiles(df, value, shares)
    edges = edges.withColumn("_edges", F.array_distinct("_q")).drop("_q")
    x = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))  # one row of edges
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    return x.withColumn(out, F.when(F.col(value).isNotNull(), 1 + F.size(F.filter(inner, lambda e: e < F.col(value))))).drop("_edges")


def trimmed(df: DataFrame, columns: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Rows within the [lo, hi] quantiles of each column, one column after another: later bounds are those of what is left."""
    for c in columns:
        q = exact_quantiles(df, c, (lo, hi)).first()[0]  # two numbers, so that the next column's don't read this one's plan again
        df = df.where((F.col(c) >= q[0]) & (F.col(c) <= q[1])) if q else df.where(F.lit(False))
    return df


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str, least: int = 10, few: bool = False) -> DataFrame:
    """n, ic (Spearman's rank correlation, ties averaged), Pearson's r and p (normal) by group; null under ``least`` pairs.

    few: there are only some groups, each too large for one task's sort."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    x = spread_ranks(stored(x, "pairs"), by, {a: "_ra", b: "_rb"}) if few else cross_rank(cross_rank(x, by, a, "_ra"), by, b, "_rb")
    g = x.groupBy(*by).agg(F.count("*").alias("n"), correlation("_ra", "_rb").alias("ic"), correlation(a, b).alias("pearson")).where(F.col("n") >= least)
    return g.withColumn("p", normal_tail(F.col("ic") * F.sqrt(F.col("n") - 1)))


def rank_sum_test(df: DataFrame, by: Sequence[str], value: str, group: str) -> DataFrame:
    """Mann-Whitney's U of rows with ``group`` true against the others, and z by the normal approximation."""
    x = spread_rank(df.where(F.col(value).isNotNull()), by, value, "_p")
    g = x.groupBy(*by).agg((F.sum(F.when(F.col(group), F.col("_p"))) * F.count("*")).alias("ranks"), F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n2"))
    u = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2
    mid, sd = F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return g.withColumn("u", u).withColumn("z", ratio(u - mid, sd)).drop("ranks")


def long_short(df: DataFrame, by: str, signal: str, q: int, name: str) -> DataFrame:
    """position LONG for the q highest signals of a date, SHORT for the q lowest, NONE for the rest; the name breaks ties."""
    up, down = over([by], [F.col(signal).desc_nulls_last(), F.col(name)]), over([by], [F.col(signal).asc_nulls_last(), F.col(name)])
    x = df.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    return x.withColumn("position", F.when(F.col(signal).isNull(), "NONE").when(F.col("_u") <= q, "LONG").when(F.col("_d") <= q, "SHORT").otherwise("NONE")).drop("_u", "_d")


def positions(df: DataFrame, by: str, signal: str, q: int, name: str, killed: Column, stake: float) -> DataFrame:
    """long_short() with rank, by the signal's absolute value, and size: ``stake`` for a position, 0 where ``killed`` holds."""
    x = long_short(df, by, signal, q, name)
    rank = F.row_number().over(over([by], [F.abs(signal).desc_nulls_last(), F.col(name)]))
    return x.withColumns({"rank": rank, "size": F.when(killed | (F.col("position") == "NONE"), 0.0).otherwise(stake)})


def kill_switch(daily: DataFrame, at: str, ic: str, window: int, threshold: float) -> DataFrame:
    """rolling_ic over ``window`` dates (half of them at least) and killed where it is under the threshold; off as it rises again."""
    w = Window.orderBy(at).rowsBetween(1 - window, 0)  # a row for each date
    x = daily.withColumn("rolling_ic", F.when(F.count(ic).over(w) >= window // 2, F.avg(ic).over(w)))
    x = x.withColumn("killed", F.coalesce(F.col("rolling_ic") < threshold, F.lit(False)))
    return x.withColumn("switched", F.col("killed") != F.coalesce(F.lag("killed").over(Window.orderBy(at)), F.lit(False)))


def factor_residuals(panel: DataFrame, factors: Sequence[str], r: str, group: Sequence[str], least: int = 30) -> DataFrame:
    """panel with alpha (the constant), residual and r_squared of ordinary least squares of ``r`` on a constant and ``factors`` by group.

    Sums of products are aggregates, so a group may have any number of rows; one small matrix for each group goes to Python,
    and residuals are taken where the rows are. Null for groups under ``least`` complete rows, for incomplete rows, and where
    a group's key is null.
    """
    terms = [F.lit(1.0), *(F.col(f).cast("double") for f in factors), F.col(r).cast("double")]
    whole = F.lit(True)
    for name in (*factors, r):
        whole = whole & F.col(name).isNotNull()
    size = len(terms)
    shift = panel.where(whole).groupBy(*group).agg(F.count("*").alias("_n"), F.array(*(F.sum(x * y) for x in terms for y in terms)).alias("_m"))
    schema = shift.drop("_n", "_m").withColumns({"_beta": F.lit(None).cast("array<double>"), "_r2": F.lit(None).cast("double")}).schema

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            betas, shares = [], []
            for n, m in zip(pdf["_n"], pdf["_m"]):
                beta, share = None, None
                if n >= least:
                    m = np.asarray(m, float).reshape(size, size)
                    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
                    left, all_ = m[-1, -1] - beta @ m[:-1, -1], m[-1, -1] - m[0, -1] ** 2 / n
                    share = 1 - left / all_ if all_ > 0 else None
                betas.append(beta)
                shares.append(share)
            yield pdf.drop(columns=["_n", "_m"]).assign(_beta=betas, _r2=pd.Series(shares, index=pdf.index, dtype="float64"))

    fitted = F.lit(0.0)
    for i, x in enumerate(terms[:-1]):
        fitted = fitted + F.col("_beta")[i] * x
    done = panel.join(shift.mapInPandas(solve, schema), list(group), "left")
    return done.withColumns({"alpha": F.col("_beta")[0], "residual": F.when(whole, F.col(r) - fitted), "r_squared": F.nanvl("_r2", F.lit(None).cast("double"))}).select(*panel.columns, "alpha", "residual", "r_squared")


def equal_weight_factors(panel: DataFrame, at: str, r: str, groups: Sequence[str]) -> DataFrame:
    """mkt and one factor for each group column: equal-weighted means of ``r`` by date, groups less the market."""
    cells = stored(panel.groupBy(F.col(at).alias("_at"), *groups).agg(F.sum(r).alias("_sum"), F.count(r).alias("_n")), "means")  # some rows for each date
    mean = ratio(F.sum("_sum"), F.sum("_n"))
    x = panel.join(F.broadcast(cells.groupBy("_at").agg(mean.alias("mkt"))), F.col(at).eqNullSafe(F.col("_at"))).drop("_at")
    for g in groups:
        means = cells.groupBy("_at", F.col(g).alias("_g")).agg(mean.alias("_mean"))
        x = x.join(F.broadcast(means), F.col(at).eqNullSafe(F.col("_at")) & F.col(g).eqNullSafe(F.col("_g"))).withColumn(f"f_{g}", F.col("_mean") - F.col("mkt")).drop("_at", "_g", "_mean")
    return x


def lag_correlation(df: DataFrame, keys: Sequence[str], at: str, a: str, b: str, lags: Sequence[int], least: int = 30) -> DataFrame:
    """Rank correlation of ``a`` with ``b`` lag rows later, for each lag with enough pairs."""
    x = df.withColumns({f"_b{k}": F.lead(b, k).over(over(keys, [at])) for k in lags})
    x = x.select(F.col(a).alias("_x"), F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_b{k}").alias("_y")) for k in lags))))
    return spearman(x, ["lag"], "_x", "_y", least, few=True).select("lag", "n", "ic")


def prior_directions(leaders: Sequence[int], followers: Sequence[int]) -> np.ndarray:
    """Three directions that names are expected to move in, each of length 1 and at right angles to those before: all together, leaders
    against followers, and cyclical names (class 1) against defensive ones (-1; 0 is neither). A direction that the others already span is left out."""
    k, n = len(leaders), len(leaders) + len(followers)
    sides = np.concatenate([np.full(k, 1 / np.sqrt(max(k, 1))), np.full(n - k, -1 / np.sqrt(max(n - k, 1)))])
    found: list[np.ndarray] = []
    for v in (np.ones(n), sides, np.array([*leaders, *followers], float)):
        for u in found:
            v = v - (u @ v) * u
        if np.linalg.norm(v) > 1e-9:
            found.append(v / np.linalg.norm(v))
    return np.column_stack(found)


def prior_correlation(correlation: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The correlation matrix of names that move in ``directions`` alone, with the variances that these have in ``correlation``."""
    variances = np.einsum("ik,ij,jk->k", directions, correlation, directions)
    prior = directions * variances @ directions.T
    scale = np.sqrt(np.where(np.diag(prior) > 0, np.diag(prior), 1e-8))
    return prior / np.outer(scale, scale)


def warm_up_correlation(returns: DataFrame, names: Sequence[str], warm: Column) -> np.ndarray:
    """The correlations of a few dozen columns over the rows where ``warm`` holds and none is null: sums of products, one row for all dates."""
    x = returns.where(warm).select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names))).dropna()
    mean = x.agg(*(F.avg(f"_{i}").alias(f"m{i}") for i in range(len(names))))
    x = x.crossJoin(F.broadcast(mean)).select(*((F.col(f"_{i}") - F.col(f"m{i}")).alias(f"_{i}") for i in range(len(names))))
    n, products = x.agg(F.count("*"), F.array(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(len(names)) for j in range(i, len(names))))).first()
    if n < 2:
        raise ValueError("the warm-up has fewer than two whole rows")
    c = np.zeros((len(names), len(names)))
    c[np.triu_indices(len(names))] = products
    c = c + np.triu(c, 1).T
    sd = np.sqrt(np.diag(c) / n)
    sd[sd == 0] = 1
    return c / np.outer(sd, sd) / (n - 1)


def lead_lag_signals(returns: DataFrame, at: str, leaders: Mapping[str, int], followers: Mapping[str, int], warm: Column, window: int = 60, shrink: float = 0.9, factors: int = 3) -> DataFrame:
    """Follower signals by regularised principal components: each date's correlations of ``window`` earlier rows, shrunk to a prior, give
    loadings; followers' loadings times leaders' components of today's leader returns.

    ``leaders`` and ``followers`` map columns to their classes: 1 cyclical, -1 defensive, 0 neither. The prior is
    prior_correlation() of the rows where ``warm`` holds; give it an early period, whose own dates then get no signals. ``returns`` has a
    column for each of a few dozen names and a row for each date; dates are dealt out with their windows, so each is one small matrix in a task.
    """
    names = [*leaders, *followers]
    prior = prior_correlation(warm_up_correlation(returns, names, warm), prior_directions([*leaders.values()], [*followers.values()]))
    w = Window.orderBy(at).rowsBetween(-window, 0)  # a row for each date
    rows = returns.select(at, (~F.coalesce(warm, F.lit(False))).alias("_out"), F.array(*(F.col(c).cast("double") for c in names)).alias("_r"), F.row_number().over(Window.orderBy(at)).alias("_n"))
    rows = rows.withColumn("_w", F.collect_list("_r").over(w)).where((F.col("_n") > window) & F.col("_out"))
    k, followed = len(leaders), [*followers]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, held in zip(pdf[at], pdf["_w"]):
                x = np.array([np.asarray(r, float) for r in held])
                past, today = x[:-1], x[-1]
                sd = past.std(axis=0)
                z = (past - past.mean(axis=0)) / np.where(sd > 0, sd, 1)
                c = (1 - shrink) * (z.T @ z / max(len(z) - 1, 1)) + shrink * prior
                vectors = np.linalg.eigh((c + c.T) / 2)[1][:, -factors:]
                now = np.where(sd[:k] > 0, (today[:k] - past[:, :k].mean(axis=0)) / np.where(sd[:k] > 0, sd[:k], 1), 0)
                out += [(d, n, float(s)) for n, s in zip(followed, vectors[k:] @ (vectors[:k].T @ now))]
            yield pd.DataFrame(out, columns=[at, "name", "signal"])

    return rows.select(at, "_w").repartition(at).mapInPandas(run, f"{at} date, name string, signal double")


def lift_at(df: DataFrame, by: Sequence[str], score: str, label: str, shares: Sequence[float]) -> DataFrame:
    """lift of the top share of scores over the base rate, by group and share; the label's name breaks no ties: rank counts all."""
    w = over(by, [F.col(score).desc()])
    x = df.withColumns({"_rank": F.row_number().over(w), "_n": F.count("*").over(over(by)), "_base": F.avg(F.col(label).cast("double")).over(over(by))})
    x = x.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("share"))))
    return x.groupBy(*by, "share").agg(F.count("*").alias("n"), ratio(F.avg(F.col(label).cast("double")), F.max("_base")).alias("lift"))


def weighted_spread(df: DataFrame, by: Sequence[str], value: str, has: Column) -> DataFrame:
    """Mean of rows with ``has`` less the mean of those without, by group."""
    return df.groupBy(*by).agg((F.avg(F.when(has, F.col(value))) - F.avg(F.when(~has, F.col(value)))).alias("spread"), F.count_if(has).alias("n_with"), F.count_if(~has).alias("n_without"))
