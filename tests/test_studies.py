"""Studies that SQL can't express, against numpy, and edge cases of series operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import backtest, factor, models, screens, series, technicals
from tidemark.plans import studies
from tidemark.plans.fixtures import Tables
from tidemark.plans.research import _model_rows
from tidemark.streaming import monitor

FOLDER = "/root/testdata/sf0.01"


def test_three_factor_residuals(spark):
    panel = studies._factor_panel(Tables(spark, FOLDER)).where("ticker < 8").toPandas()
    got = plans.QUERIES["d47_three_factors"](spark, FOLDER).where("ticker < 8").toPandas().set_index(["ticker", "d"])
    seen = 0
    for _, g in panel.groupby(["ticker", "y"]):
        own = got.loc[[(t, d) for t, d in zip(g["ticker"], g["d"])]]
        if len(g) < 30:
            assert own["residual"].isna().all()
            continue
        a = np.column_stack([np.ones(len(g)), g["mkt"], g["f_area"], g["f_size"]])
        e = g["r"] - a @ np.linalg.lstsq(a, g["r"], rcond=None)[0]
        assert np.allclose(own["residual"].to_numpy(), e.to_numpy(), atol=2e-6)
        seen += 1
    assert seen > 20


def test_unit_roots(spark):
    r = np.random.default_rng(3)
    walks = {k: np.cumsum(r.normal(size=200)) for k in range(3)} | {9: r.normal(size=200), 7: np.zeros(200), 8: r.normal(size=12)}
    rows = [(k, i, float(v)) for k, x in walks.items() for i, v in enumerate(x)] + [(9, 500, None)]
    got = {x.k: (x.n, x.rho, x.t) for x in series.unit_roots(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", 2).collect()}
    for k in (0, 1, 2, 9):
        x, d = walks[k], np.diff(walks[k])
        a = np.column_stack([np.ones(197), x[2:-1], d[1:-1], d[:-2]])
        beta = np.linalg.lstsq(a, d[2:], rcond=None)[0]
        e = d[2:] - a @ beta
        t = beta[1] / np.sqrt(e @ e / (197 - 4) * np.linalg.inv(a.T @ a)[1, 1])
        assert got[k][0] == 197 and np.allclose(got[k][1:], (beta[1], t), rtol=1e-5)
    assert got[9][2] < -5 and got[7][1:] == (None, None) == got[8][1:]


def test_vector_autoregression(spark):
    r = np.random.default_rng(5)
    x = np.zeros((300, 2))
    for i in range(2, 300):
        x[i] = [0.1, -0.2] + x[i - 1] @ [[0.5, 0.1], [0.0, 0.3]] + r.normal(size=2)
    got = {(w.name, w.term): w.weight for w in series.vector_autoregression(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double"), "i", ["a", "b"], 2).collect()}
    a = np.column_stack([np.ones(298), x[1:-1], x[:-2]])
    beta = np.linalg.lstsq(a, x[2:], rcond=None)[0]
    want = {(n, t): beta[i, k] for k, n in enumerate("ab") for i, t in enumerate(("const", "a_1", "b_1", "a_2", "b_2"))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert series.vector_autoregression(spark.createDataFrame([], "i int, a double, b double"), "i", ["a", "b"]).count() == 0


def test_names_that_move_together_share_a_cluster(spark):
    r = np.random.default_rng(7)
    drivers = r.normal(size=(3, 40))
    rows = [(k, m, float(5 * k + (k + 1) * (drivers[k % 3, m] + 0.2 * r.normal()))) for k in range(30) for m in range(40) if (k + m) % 11]
    got = {x.k: x.cluster for x in models.correlation_clusters(spark.createDataFrame(rows, "k int, m int, v double"), "k", "m", "v", 3, 3).collect()}
    assert len(got) == 30 and all(len({got[k] for k in range(g, 30, 3)}) == 1 for g in range(3)) and len({*got.values()}) == 3


def test_folds_hold_whole_groups(spark):
    t = Tables(spark, FOLDER)
    scored = models.group_folds(_model_rows(t), "ticker", ["day", "gap", "volume_ratio", "r5", "r20"], "label").select("ticker", "fold", "score", "label").toPandas()
    assert scored.groupby("ticker")["fold"].nunique().max() == 1 and scored["score"].between(0, 1).all() and len(scored) == _model_rows(t).count()
    areas = series.curve_areas(spark.createDataFrame(scored), ["fold"], "score", "label").collect()
    for a in areas:
        own = scored[scored["fold"] == a.fold]
        pos, neg = (own.loc[own["label"] == v, "score"].to_numpy() for v in (1, 0))
        won = (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2
        assert abs(a.roc - won / len(pos) / len(neg)) < 1e-9 and a.n == len(own)


def test_class_weights(spark):
    got = {x.y: x.w for x in models.class_weights(spark.createDataFrame([(i, int(i < 3)) for i in range(12)], "i int, y int"), "y", "w").collect()}
    assert got == {1: 2.0, 0: 12 / 2 / 9}


@pytest.mark.parametrize("own, other, status, diff", [("1234", "12.3", "OK", 0), ("1235", "12.4", "OK", 0), ("1239", "12.3", "OK", 0), ("1234", "12.5", "OK", 0.1), ("1234", "13.5", "NG", 1.1), ("1234", "13.0", "OK", 0), ("1234", "14", "NG", 1), ("x", "1", None, None), ("", "1", None, None), (None, "1", None, None), ("5", None, "NODATA", None), ("5", "-", "NON_NUMERIC", None), ("1200", "12", "OK", 0), ("-1234", "-12.3", "OK", 0), ("1250", "12", "OK", 0), ("0", "0.001", "OK", 0.001)])
def test_reconciled(spark, own, other, status, diff):
    rows = screens.reconciled(spark.createDataFrame([(own, other)], "a string, b string"), "a", "b", F.lit(0.01), F.lit(0.0)).collect()
    assert [(r.status, r.diff) for r in rows] == ([(status, diff if diff is None else pytest.approx(diff))] if status else [])


def test_shown_places(spark):
    values = {1.0: 0, 12.5: 1, 0.001: 3, 123456789.1234: 1, 1234567890123.5: 0, 1 / 3: 10, -2.25: 2, 0.0: 0, 100.10: 1}
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", screens.shown_places(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in got} == values


def test_windows_of_weekdays(spark):
    """Against pandas' own business days: weekends, events on them, keys without rows, null scores."""
    r = np.random.default_rng(3)
    days = pd.date_range("2024-01-01", "2024-03-31")
    rows = [(k, d.date(), None if r.random() < 0.1 else float(r.integers(100))) for k in "ab" for d in days if r.random() < 0.6]
    events = [(k, d.date(), i) for i, (k, d) in enumerate((k, d) for k in "abc" for d in pd.date_range("2024-01-20", "2024-02-12"))]
    got = {(x.k, x.e): x for x in backtest.window_maxima(spark.createDataFrame(rows, "k string, d date, s double"), spark.createDataFrame(events, "k string, e date, s int"), "k", "d", "e", ["s"], [1, 3, 10]).collect()}
    assert len(got) == len(events)
    for k, e, i in events:
        for n in (1, 3, 10):
            lo, hi = (pd.Timestamp(e) - pd.tseries.offsets.BDay(m) for m in (n, 1))
            inside = [s for key, d, s in rows if key == k and lo <= pd.Timestamp(d) <= hi and s is not None]
            assert got[k, e][f"s_{n}"] == (max(inside) if inside else None) and got[k, e]["s"] == i


def test_lead_lag_against_plain_steps(spark):
    """Signals of the last date and of an early one, worked out step by step from the returns and the prior."""
    t = Tables(spark, FOLDER)
    x = technicals.weekly_closes(t.bars10).where("r is not null").groupBy("week").pivot("ticker", list(range(10))).agg(F.first(F.log1p("r"))).na.fill(0.0).orderBy("week").toPandas()
    r = x[[str(i) for i in range(10)]].to_numpy(float)
    early = (x["week"] < dt.date(1997, 1, 1)).to_numpy()
    v1 = np.ones(10) / np.sqrt(10)
    v2 = np.array([1 / np.sqrt(6)] * 6 + [-1 / np.sqrt(4)] * 4)
    v2 = v2 - (v2 @ v1) * v1
    v2 = v2 / np.linalg.norm(v2)
    v3 = np.array([1, -1, 0, 1, -1, 0, 1, -1, 0, 1.0])
    v3 = v3 - (v3 @ v1) * v1
    v3 = v3 - (v3 @ v2) * v2
    v3 = v3 / np.linalg.norm(v3)
    v = np.column_stack([v1, v2, v3])
    assert np.allclose(v.T @ v, np.eye(3)) and np.allclose(factor.prior_directions([1, -1, 0, 1, -1, 0], [1, -1, 0, 1]), v)
    z = (r[early] - r[early].mean(axis=0)) / r[early].std(axis=0)
    raw = v @ np.diag(np.diag(v.T @ (z.T @ z / (len(z) - 1)) @ v)) @ v.T
    prior = raw / np.sqrt(np.outer(np.diag(raw), np.diag(raw)))
    assert np.allclose(np.diag(prior), 1)
    got = plans.QUERIES["d39_m7_lead_lag"](spark, FOLDER).toPandas()
    assert got["d"].min() == x["week"][max(early.sum(), 60)] and len(got) == 4 * (len(r) - max(early.sum(), 60))
    for at in (len(r) - 1, int(max(early.sum(), 60))):
        past, today = r[at - 60 : at], r[at]
        z = (past - past.mean(axis=0)) / past.std(axis=0)
        u = np.linalg.eigh(0.1 * (z.T @ z / 59) + 0.9 * prior)[1][:, -3:]
        want = u[6:] @ (u[:6].T @ ((today[:6] - past[:, :6].mean(axis=0)) / past[:, :6].std(axis=0)))
        own = got[got["d"] == x["week"][at]].sort_values("name")
        assert own["name"].tolist() == ["n6", "n7", "n8", "n9"] and np.allclose(own["signal"], want, atol=2e-6)


def test_directions_that_say_nothing_new_are_left_out():
    assert factor.prior_directions([0, 0], [0, 0, 0]).shape == (5, 2) and factor.prior_directions([1, 1], [-1, -1]).shape == (4, 2) and factor.prior_directions([1, -1], []).shape == (2, 2)


def areas_plain(rows):
    """Every pair of a positive and a negative; precision step by step down the scores."""
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    roc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
    pr = sum(sum(y for s, y in rows if s == t) * sum(y for s, y in rows if s >= t) / sum(s >= t for s, _ in rows) for t in {s for s, _ in rows}) / len(pos) if pos else None
    return roc, pr


def test_areas_of_many_scores(spark):
    r = np.random.default_rng(6)
    rows = [("many", float(x), int(r.random() < 0.2 + x / 4)) for x in r.normal(size=900)] + [("ties", float(x), int(r.random() < 0.3)) for x in r.choice([0.5, 0.5, 0.5, 1.0, -1.0, 7.0], 600)] + [("one", 0.5, 1), ("same", 0.5, 0), ("same", 0.5, 1)]
    df = spark.createDataFrame(rows + [("many", None, 1), ("many", 0.3, None)], "g string, s double, y int").repartition(5)
    got = {x.g: x for x in series.curve_areas(df, ["g"], "s", "y").collect()}
    for g in ("many", "ties", "one", "same"):
        own = [(s, y) for h, s, y in rows if h == g]
        roc, pr = areas_plain(own)
        assert got[g].n == len(own) and got[g].roc == (roc and pytest.approx(roc)) and got[g].pr == pytest.approx(pr)
    whole = series.curve_areas(df, [], "s", "y")
    roc, pr = areas_plain([(s, y) for _, s, y in rows])
    one = whole.first()
    assert (one.n, one.roc, one.pr) == (len(rows), pytest.approx(roc), pytest.approx(pr))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_piece" in x for x in windows)
    assert series.curve_areas(df.limit(0), ["g"], "s", "y").count() == 0


def test_cross_correlations_of_what_is_left(spark):
    """Orders by Akaike's criterion, the second series filtered by the first one's weights, all lags, against numpy."""
    r = np.random.default_rng(11)
    series_ = {}
    for k in range(3):
        x, y = np.zeros(260), r.normal(size=260)
        e = r.normal(size=260)
        for i in range(2, 260):
            x[i] = 0.7 * x[i - 1] - 0.3 * (x[i - 2] if k else 0) + e[i]
        if k < 2:
            y[3:] += 0.8 * x[:-3]
        series_[k] = (x, y)
    rows = [(k, i, float(x[i]), float(y[i])) for k, (x, y) in series_.items() for i in range(260)] + [(0, 999, None, 1.0), (1, 998, 1.0, None)] + [(7, i, 1.0, float(i % 3)) for i in range(50)] + [(8, i, float(i), 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double").repartition(4)
    lags = (-2, 0, 1, 3, 5)
    for own in (False, True):
        got = {(x.k, x.lag): x for x in series.cross_correlations(df, ["k"], "i", "a", "b", lags, 6, own).collect()}
        for k, (x, y) in series_.items():
            def model(s):
                best = (np.inf, 0, None)
                m = np.column_stack([np.ones(254), *(s[6 - p : 260 - p] for p in range(1, 7))])
                for p in range(1, 7):
                    beta = np.linalg.lstsq(m[:, : p + 1], s[6:], rcond=None)[0]
                    left = ((s[6:] - m[:, : p + 1] @ beta) ** 2).sum()
                    aic = 254 * np.log(left / 254) + 2 * (p + 1)
                    if aic < best[0]:
                        best = (aic, p, beta[1:])
                return best[1:]

            (p, wa), (q, wb) = model(x), model(y) if own else model(x)
            left = lambda s, w: np.concatenate([np.full(len(w), np.nan), s[len(w) :] - sum(c * s[len(w) - j - 1 : len(s) - j - 1] for j, c in enumerate(w))])
            ea, eb = left(x, wa), left(y, wb)
            joint = 0
            for lag in lags:
                a, b = (ea[: 260 - lag], eb[lag:]) if lag >= 0 else (ea[-lag:], eb[:lag])
                ok = ~np.isnan(a) & ~np.isnan(b)
                c = np.corrcoef(a[ok], b[ok])[0, 1]
                g = got[k, lag]
                assert (g.n, g.order) == (ok.sum(), p) and abs(g.r - c) < 1e-8 and abs(g.bound - 1.96 / np.sqrt(ok.sum())) < 1e-9 and g.beyond == (abs(c) > g.bound)
                joint += ok.sum() * c * c
            assert abs(got[k, 0].joint - joint) < 1e-6 and (got[k, 0].p < 0.001) == (k < 2)
            assert k == 2 or max(lags, key=lambda lag: abs(got[k, lag].r)) == 3
        assert got[7, 0].r is None and got[7, 0].order == 0 and got[8, 0].r is None and got[8, 0].joint is None


def test_prewhitened_innovations(spark):
    r = np.random.default_rng(2)
    x = np.zeros(120)
    for i in range(1, 120):
        x[i] = 0.6 * x[i - 1] + r.normal()
    got = models.prewhitened(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double"), ["k"], "i", "v", 2).orderBy("i").toPandas()["innovation"].to_numpy()
    a = np.column_stack([np.ones(118), x[1:-1], x[:-2]])
    assert np.isnan(got[:2]).all() and np.allclose(got[2:], x[2:] - a @ np.linalg.lstsq(a, x[2:], rcond=None)[0])


def test_walk_forward_sees_no_later_rows(spark):
    """The label is known from a feature whose meaning turns round later: models of earlier rows must miss that."""
    rows = [(y, float(i % 2), float((i % 2) ^ (y >= 2002))) for y in range(1999, 2004) for i in range(60)]
    scored = models.walk_forward(spark.createDataFrame(rows, "y int, f double, label double"), "y", ["f"], "label", [2001, 2002, 2003], "forest").toPandas()
    right = (scored["score"] > 0.5) == (scored["label"] == 1)
    assert right[scored["y"] == 2001].all() and not right[scored["y"] == 2002].any()


def test_retries_wait_longer_each_time():
    waits, left = [], [3]

    def job():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError

    assert monitor.run_retrying(job, wait=2, longest=5, sleep=waits.append) == 3 and waits == [2, 4, 5]
    left[0] = 9
    with pytest.raises(OSError):
        monitor.run_retrying(job, tries=2, sleep=waits.append)


def test_factor_movers(spark):
    got = plans.QUERIES["d50_factor_movers"](spark, FOLDER).toPandas()
    x = plans.QUERIES["d47_three_factors"](spark, FOLDER).toPandas()
    x["residual"] += x["alpha"]
    x = x[(x["d"] >= dt.date(2001, 1, 1)) & x["residual"].notna()].groupby("ticker")[["residual", "r"]].sum()
    want = x.reindex(x["residual"].abs().sort_values(ascending=False).index[:20])
    got = got.set_index("ticker")
    assert set(got.index) == set(want.index) and len(got) == 20 and np.allclose(got.loc[want.index, ["own", "total"]], want[["residual", "r"]], atol=2e-5)


def test_depth_is_chosen_on_earlier_rows(spark):
    """An exclusive or needs two levels: the shallow candidate loses on the last earlier year."""
    r = np.random.default_rng(1)
    rows = [(y, float(a), float(b), float(a ^ b)) for y in range(2000, 2004) for a, b in r.integers(0, 2, (150, 2))]
    got = models.tuned_walk_forward(spark.createDataFrame(rows, "y int, a double, b double, label double"), "y", ["a", "b"], "label", [2002, 2003, 2004], depths=(1, 3)).toPandas()
    assert set(got["depth"]) == {3} and ((got["score"] > 0.5) == (got["label"] == 1)).all() and len(got) == 300
