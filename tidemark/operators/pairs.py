"""How the names of a group move together: correlations as products of blocks, pairs that hardly move together, trees of clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Names of a block.
BLOCK = 256
#: Names of which one task holds all distances, 200 MB.
MOST_NAMES = 5000


def _when(df: DataFrame, at: str):
    return F.unix_date(at) if dict(df.dtypes)[at] == "date" else F.col(at).cast("long")


def _blocks(rows: DataFrame, group: Sequence[str], name: str, at: str, value: str, period: str | None) -> DataFrame:
    """A row for each block of names of a group: their names, the times that any of them has, the times' periods, and a value
    for each name and time, NaN where there is none. Names are dealt into blocks by hash, so those have about BLOCK each."""
    rows = rows.where(F.col(value).isNotNull() & F.col(name).isNotNull())
    rows = rows.select(*group, F.col(name).alias("_name"), _when(rows, at).alias("_at"), F.col(value).cast("double").alias("_value"), (F.lit(0) if period is None else F.col(period)).cast("int").alias("_period"))
    sizes = rows.groupBy(*group).agg(F.ceil(F.approx_count_distinct("_name") / BLOCK).cast("int").alias("_n"))
    kind = dict(rows.dtypes)["_name"]
    keys = ", ".join(f"`{g}` {dict(rows.dtypes)[g]}" for g in group)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, i = np.unique(pdf["_name"].to_numpy(), return_inverse=True)
        times, first, j = np.unique(pdf["_at"].to_numpy(), return_index=True, return_inverse=True)
        x = np.full((len(names), len(times)), np.nan)
        x[i, j] = pdf["_value"]
        return pd.DataFrame([(*key, [*names.tolist()], times.tolist(), pdf["_period"].to_numpy()[first].tolist(), x.tobytes())], columns=[*group, "_block", "_n", "_names", "_times", "_periods", "_x"])

    dealt = rows.join(sizes, list(group)).withColumn("_block", F.pmod(F.xxhash64("_name"), F.col("_n")).cast("int"))
    return dealt.groupBy(*group, "_block", "_n").applyInPandas(build, f"{keys}, _block int, _n int, _names array<{kind}>, _times array<long>, _periods array<int>, _x binary")


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of each row of x with each of y over the columns that both have, and how many those are: six matrix products."""
    def centred(a):
        known = ~np.isnan(a)
        n = known.sum(axis=1, keepdims=True)
        a = np.where(known, a, 0)
        return np.where(known, a - np.divide(a.sum(axis=1, keepdims=True), n, out=np.zeros((len(a), 1)), where=n > 0), 0), known.astype(float)

    (x, m), (y, k) = centred(x), centred(y)
    n, sx, sy = m @ k.T, x @ k.T, m @ y.T
    sxx, syy, sxy = (x * x) @ k.T - sx * sx / np.maximum(n, 1), m @ (y * y).T - sy * sy / np.maximum(n, 1), x @ y.T - sx * sy / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(sxx, 0) * np.maximum(syy, 0))
    flat = scale <= 1e-12 * np.sqrt(np.outer((x * x).sum(axis=1), (y * y).sum(axis=1)))
    return np.clip(np.divide(sxy, scale, out=np.full_like(sxy, np.nan), where=~flat), -1, 1), n


def _block_pairs(rows: DataFrame, group: Sequence[str], name: str, at: str, value: str, period: str | None, work: Callable, out: str) -> DataFrame:
    """``work`` on each two blocks of a group: (names, values, names, values, periods of the columns, same block) to rows after the group.

    A block goes to as many tasks as its group has blocks, and each two blocks are one small group of their own, however
    large the group of names is.
    """
    blocks = _blocks(rows, group, name, at, value, period)
    keys = ", ".join(f"`{g}` {dict(blocks.dtypes)[g]}" for g in group)
    sent = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    sent = sent.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [r for _, r in pdf.sort_values("_block").iterrows()]
        if key[-1] != key[-2] and len(parts) < 2:
            return pd.DataFrame(columns=columns)  # one of the two has no names
        a, b = parts[0], parts[-1]
        times, first = np.unique(np.concatenate([a["_times"], b["_times"]]), return_index=True)
        periods = np.concatenate([a["_periods"], b["_periods"]])[first]
        wide = []
        for r in (a, b):
            x = np.full((len(r["_names"]), len(times)), np.nan)
            x[:, np.searchsorted(times, r["_times"])] = np.frombuffer(r["_x"]).reshape(len(r["_names"]), -1)
            wide.append(x)
        found = work(a["_names"], wide[0], b["_names"], wide[1], periods, key[-1] == key[-2])
        if isinstance(found, pd.DataFrame):
            return found.assign(**dict(zip(group, key)))[columns]
        return pd.DataFrame([(*key[: len(group)], *x) for x in found], columns=columns)

    columns = [*group, *(x.split()[0].strip("`") for x in out.split(", "))]
    return sent.groupBy(*group, "_i", "_j").applyInPandas(run, f"{keys}, {out}")


def _found(a: np.ndarray, b: np.ndarray, hit: np.ndarray, same: bool, **columns: np.ndarray) -> pd.DataFrame:
    """a, b and ``columns`` of each pair that is hit, the smaller name first; a block with itself has each pair once. No row is made by itself."""
    if same:
        hit = hit & (a[:, None] < b[None, :])
    i, j = np.nonzero(hit)
    x, y = a[i], b[j]
    first = (x < y).astype(bool)
    return pd.DataFrame({"a": np.where(first, x, y), "b": np.where(first, y, x)} | {k: v[i, j] for k, v in columns.items()})


def pair_correlations(rows: DataFrame, group: str, name: str, at: str, value: str, least: int) -> DataFrame:
    """group, a, b, r, n: the correlation of each two names of a group with ``least`` common times; r is null where one stands still."""
    kind = dict(rows.dtypes)[name]

    def work(a, x, b, y, periods, same):
        r, n = _products(x, y)
        out = _found(a, b, n >= least, same, r=r, n=n.astype(int))
        return out.assign(r=out["r"].astype(object).where(out["r"].notna(), None))

    return _block_pairs(rows, [group], name, at, value, None, work, f"a {kind}, b {kind}, r double, n long")


def low_pairs(rows: DataFrame, group: str, name: str, at: str, year: str, value: str, most: float, least: int, years: int, absolute: bool = True) -> DataFrame:
    """group, a, b, years, worst, mean: pairs of a group whose correlation, or its ``absolute`` value, is at most ``most`` in each year that counts, and
    that have ``years`` of those or more. A year counts with ``least`` common times, if neither value stands still over them.

    worst is the largest and mean the average of the years' correlations. Correlations are matrix products of blocks of names in a
    task, which puts out found pairs alone; nothing is joined at the level of times.
    """
    kind = dict(rows.dtypes)[name]

    def work(a, x, b, y, periods, same):
        count, total, worst = (np.zeros((len(a), len(b))) for _ in range(3))
        worst[:] = -np.inf
        for p in np.unique(periods):
            r, n = _products(x[:, periods == p], y[:, periods == p])
            counts = (n >= least) & ~np.isnan(r)
            r = np.where(counts, np.abs(r) if absolute else r, 0)
            count += counts
            total += r
            worst = np.where(counts, np.maximum(worst, r), worst)
        return _found(a, b, (count >= max(years, 1)) & (worst <= most), same, years=count.astype(int), worst=worst, mean=total / np.maximum(count, 1))

    return _block_pairs(rows, [group], name, at, value, year, work, f"a {kind}, b {kind}, years long, worst double, mean double")


def ward_merges(far: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) of each merge, by rising height; leaves count from 0 and merges on from the last leaf.

    ``far`` holds all distances and is used up. Chains of nearest neighbours end at two that are each other's; those are merged, and
    Ward's distance of the two to all others follows from the three that are there, as Lance and Williams have it.
    """
    n = len(far)
    np.fill_diagonal(far, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    found, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            x = chain[-1]
            y = int(np.argmin(far[x]))
            if len(chain) > 1 and far[x, chain[-2]] <= far[x, y]:
                y = chain[-2]
                break
            chain.append(y)
        x, y = sorted((chain.pop(), chain.pop()))
        height = far[x, y]
        found.append((height, x, y))
        a, b, k = size[x], size[y], size
        with np.errstate(invalid="ignore"):
            new = np.sqrt(np.maximum(((a + k) * far[x] ** 2 + (b + k) * far[y] ** 2 - k * height**2) / (a + b + k), 0))
        alive[x] = False
        new[~alive] = new[y] = np.inf
        far[y], far[:, y] = new, new
        far[x], far[:, x] = np.inf, np.inf
        size[y] += a
    order = sorted(range(n - 1), key=lambda i: found[i][0])  # stable, and no merge is under one that it builds on
    up, count, out = list(range(2 * n - 1)), [1] * (2 * n - 1), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for step, i in enumerate(order):
        height, x, y = found[i]
        left, right = sorted((top(x), top(y)))
        up[left] = up[right] = n + step
        count[n + step] = count[left] + count[right]
        out.append((left, right, float(height), count[n + step]))
    return out


def cut(n: int, merges: list[tuple[int, int, float, int]], k: int | None, height: float | None) -> list[int]:
    """The cluster of each leaf, counted from 1 by the clusters' first leaves, when merges up to ``height`` are made, or all but the last k - 1."""
    made = [m for i, m in enumerate(merges) if (i < n - k if k is not None else m[2] <= height)]
    up = list(range(n + len(merges)))
    for step, (left, right, *_) in enumerate(made):
        up[left] = up[right] = n + step

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    numbers: dict[int, int] = {}
    return [numbers.setdefault(top(i), len(numbers) + 1) for i in range(n)]


def _trees(rows: DataFrame, group: Sequence[str], name: str, at: str, value: str, least: int, work: Callable, out: str) -> DataFrame:
    largest = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count_distinct(name).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > MOST_NAMES:
        raise ValueError(f"a group has {largest} names: all distances of at most {MOST_NAMES} are held in one task; models.correlation_clusters() takes any number")
    kind = dict(rows.dtypes)[name]
    keys = ", ".join(f"`{g}` {dict(rows.dtypes)[g]}" for g in group)

    def distances(a, x, b, y, periods, same):
        r, n = _products(x, y)
        yield list(a), list(b), np.maximum(1 - np.where((n >= least) & ~np.isnan(r), r, 0.0), 0).tobytes()

    blocks = _block_pairs(rows, group, name, at, value, None, distances, f"_a array<{kind}>, _b array<{kind}>, _far binary")
    columns = [*group, *(x.split()[0].strip("`") for x in out.split(", "))]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({x for c in ("_a", "_b") for part in pdf[c] for x in part})
        at = {x: i for i, x in enumerate(names)}
        far = np.zeros((len(names), len(names)))
        for a, b, data in zip(pdf["_a"], pdf["_b"], pdf["_far"]):
            i, j = [at[x] for x in a], [at[x] for x in b]
            far[np.ix_(i, j)] = x = np.frombuffer(data).reshape(len(i), len(j))
            far[np.ix_(j, i)] = x.T
        return pd.DataFrame([(*key, *x) for x in work(names, ward_merges(far))], columns=columns)

    return blocks.groupBy(*group).applyInPandas(run, f"{keys}, {out}")


def ward_tree(rows: DataFrame, group: Sequence[str], name: str, at: str, value: str, least: int = 2) -> DataFrame:
    """group, step, left, right, height, size: the merges of each group's names by Ward's criterion at the distance 1 - correlation.

    Names count from 0 in their order, and merges on from the last name. Names with fewer than ``least`` common times, and those that stand
    still, are at distance 1. Distances come from products of blocks; a task holds those of one group, of MOST_NAMES names at most, and more are refused.
    """
    return _trees(rows, group, name, at, value, least, lambda names, merges: [(i, *m) for i, m in enumerate(merges)], "step int, left int, right int, height double, size int")


def ward_clusters(rows: DataFrame, group: Sequence[str], name: str, at: str, value: str, k: int | None = None, height: float | None = None, least: int = 2) -> DataFrame:
    """group, name, leaf, cluster: ward_tree() cut into ``k`` clusters, or at a ``height``. Clusters count from 1 by their first names."""
    kind = dict(rows.dtypes)[name]
    return _trees(rows, group, name, at, value, least, lambda names, merges: [(x, i, c) for i, (x, c) in enumerate(zip(names, cut(len(names), merges, k, height)))], f"`{name}` {kind}, leaf int, cluster int")
