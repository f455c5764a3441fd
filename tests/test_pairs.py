"""Block correlations, low pairs and Ward's trees against plain versions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import pairs
from tidemark.plans import studies
from tidemark.plans.fixtures import Tables


def panel(names=23, times=60, gaps=0.2, seed=1):
    """Rows (group, name, at, year, value) with gaps; a name that stands still, one of a single time, nulls."""
    r = np.random.default_rng(seed)
    common = r.normal(size=(4, times))
    rows = []
    for i in range(names):
        x = common[i % 4] * 0.8 + r.normal(size=times)
        rows += [("g" if i < names - 4 else "h", f"n{i:02d}", t, t // 20, float(x[t])) for t in range(times) if r.random() > gaps]
    return rows + [("g", "still", t, t // 20, 3.0) for t in range(times)] + [("g", "once", 5, 0, 1.0), ("g", "n01", 999, 1, None), ("g", None, 3, 0, 1.0), ("k", "alone", 1, 0, 2.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, name string, at int, y int, v double").withColumn("worst", F.lit("x"))


def low_plain(rows, most, least, years, absolute):
    df = pd.DataFrame([r for r in rows if r[4] is not None and r[1] is not None], columns=["g", "name", "at", "y", "v"])
    out = []
    for g, own in df.groupby("g"):
        for a, b in itertools.combinations(sorted(own["name"].unique()), 2):
            rs = []
            for y in own["y"].unique():
                one, two = (own[(own["name"] == n) & (own["y"] == y)].set_index("at")["v"] for n in (a, b))
                both = pd.concat([one, two], axis=1, join="inner").to_numpy()
                if len(both) >= least and both.std(axis=0).min() > 0:
                    c = np.corrcoef(both.T)[0, 1]
                    rs.append(abs(c) if absolute else c)
            if len(rs) >= years and max(rs) <= most:
                out.append((g, a, b, len(rs), round(max(rs), 8), round(sum(rs) / len(rs), 8)))
    return sorted(out)


@pytest.mark.parametrize("block, absolute, most, years", [(256, True, 0.5, 3), (5, True, 0.4, 2), (5, False, 0.1, 3), (1, False, 0.3, 1)])
def test_low_pairs(spark, monkeypatch, block, absolute, most, years):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows = panel()
    got = pairs.low_pairs(frame(spark, rows), "g", "name", "at", "y", "v", most, 8, years, absolute)
    got = sorted((r.g, r.a, r.b, r.years, round(r.worst, 8), round(r.mean, 8)) for r in got.collect())
    want = low_plain(rows, most, 8, years, absolute)
    assert [x[:4] for x in got] == [x[:4] for x in want] and len(want) > 5
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], atol=1e-7)


def test_low_pairs_of_nothing(spark):
    assert pairs.low_pairs(frame(spark, panel()).limit(0), "g", "name", "at", "y", "v", 0.5, 8, 1).count() == 0


def test_no_join_at_the_level_of_times(spark):
    df = pairs.low_pairs(frame(spark, panel()), "g", "name", "at", "y", "v", 0.5, 8, 1)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "at#" not in "".join(x for x in plan.splitlines() if "Join" in x)  # groups' sizes alone are joined


def ward_plain(far):
    """The closest two clusters again and again."""
    n = len(far)
    d = {(i, j): far[i, j] for i in range(n) for j in range(i)}
    size, out = {i: 1 for i in range(n)}, []
    get = lambda i, j: d[max(i, j), min(i, j)]
    for new in range(n, 2 * n - 1):
        (i, j), h = min(d.items(), key=lambda x: x[1])
        for k in size:
            if k not in (i, j):
                a, b, c = size[i], size[j], size[k]
                d[new, k] = (((a + c) * get(i, k) ** 2 + (b + c) * get(j, k) ** 2 - c * h**2) / (a + b + c)) ** 0.5
        size[new] = size.pop(i) + size.pop(j)
        d = {k: v for k, v in d.items() if i not in k and j not in k}
        out.append((min(i, j), max(i, j), h, size[new]))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 10, 120])
def test_the_tree_is_that_of_the_plain_way(n):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 30)) + r.integers(0, 3, size=(n, 1))
    far = 1 - np.corrcoef(x) if n > 1 else np.zeros((1, 1))
    got, want = pairs.ward_merges(far.copy()), ward_plain(far)
    assert [(m[0], m[1], m[3]) for m in got] == [(m[0], m[1], m[3]) for m in want]
    assert np.allclose([m[2] for m in got], [m[2] for m in want])
    for k in range(1, n + 1):
        assert len(set(pairs.cut(n, got, k, None))) == k
    if n > 3:
        height = got[-3][2]
        assert len(set(pairs.cut(n, got, None, height))) == 3 == len(set(pairs.cut(n, got, None, height + 1e-9)))


def test_trees_of_a_panel(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    rows = [r for r in panel(gaps=0.3) if r[1] != "still"]
    df = pd.DataFrame([r for r in rows if r[4] is not None and r[1] is not None], columns=["g", "name", "at", "y", "v"])
    tree = pairs.ward_tree(frame(spark, rows), ["g"], "name", "at", "v", 5).toPandas()
    leaves = {(r.g, r.name): (r.leaf, r.cluster) for r in pairs.ward_clusters(frame(spark, rows), ["g"], "name", "at", "v", k=3, least=5).collect()}
    for g, own in df.groupby("g"):
        wide = own.pivot(index="at", columns="name", values="v")
        far = 1 - wide.corr(min_periods=5).fillna(0).to_numpy()
        np.fill_diagonal(far, 0)
        want = ward_plain(np.maximum(far, 0))
        got = tree[tree["g"] == g].sort_values("step")
        assert np.allclose(got["height"], [m[2] for m in want]) and list(zip(got["left"], got["right"], got["size"])) == [(m[0], m[1], m[3]) for m in want]
        assert [leaves[g, n][0] for n in wide.columns] == list(range(len(wide.columns)))
        assert [leaves[g, n][1] for n in wide.columns] == pairs.cut(len(wide.columns), want, min(3, len(wide.columns)), None)


def test_too_many_names_are_refused(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_NAMES", 10)
    with pytest.raises(ValueError, match="correlation_clusters"):
        pairs.ward_tree(frame(spark, panel()), ["g"], "name", "at", "v")


def test_pairs_of_factor_residuals(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.sector, r.ticker, r.m.toordinal(), r.y, r.e) for r in studies._monthly_residuals(Tables(spark, folder)).collect()]
    want = low_plain(rows, 0.5, 6, 3, False)
    got = sorted((r.sector, r.a, r.b, r.years) for r in plans.QUERIES["d49_low_residual_pairs"](spark, folder).collect())
    assert got == [w[:4] for w in want] and len(want) > 20
