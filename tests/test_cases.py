"""Hand-computed cases and argument contracts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import calendars as E
from barloom.operators import cross_section as X
from barloom.operators import microstructure as M
from barloom.operators import positioning as P
from barloom.operators import predictions as H
from barloom.operators import signals as G
from barloom.operators import splits as S
from barloom.operators import targets as T
from barloom.operators import thresholds as D
from barloom.operators import trades as R
from barloom.operators import performance as PF
from barloom.operators import sweeps as W
from barloom.sources import incremental as N
from barloom.sources import landed as L


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def daily(n, start="2024-01-01"):
    return pd.date_range(start, periods=n, freq="D")


# --- labels and splits -------------------------------------------------------

def test_label_up_and_short(spark):
    df = frame(spark, ticker=["a"] * 3, ts=daily(3), open=[90.0, 100, 105], close=[95.0, 110, 108])
    long = T.cost_labels_long(df, (1,), entry_cost=0.001, exit_cost=0.001).orderBy("ts").collect()
    assert long[0]["target_h1"] == 1.0
    assert math.isclose(long[0]["lr_h1"], math.log(110 * 0.999 / (100 * 1.001)), rel_tol=1e-6)
    assert long[2]["target_h1"] is None
    short = T.cost_labels_short(df, (1,), entry_cost=0.001, exit_cost=0.001).orderBy("ts").collect()
    assert short[0]["target_h1"] == 0.0


def test_label_below_cost_and_smoothing(spark):
    df = frame(spark, ticker=["a"] * 2, ts=daily(2), open=[99.0, 100], close=[99.0, 100.15])
    out = T.cost_labels(df, (1,), entry_cost=0.001, exit_cost=0.001, label_smoothing=0.1).orderBy("ts").first()
    assert math.isclose(out["target_h1"], 0.1, rel_tol=1e-6)
    with pytest.raises(ValueError):
        T.cost_labels(df, (1,), entry_cost=0, exit_cost=0, label_smoothing=0.5)


def test_meta_target(spark):
    df = frame(spark, lr_h6=[0.005, 0.001, -0.002, 0.010, 0.0, np.nan]).withColumn("lr_h6", F.nanvl("lr_h6", F.lit(None)))
    got = [r["meta_target_h6"] for r in T.meta_target(df, (6,)).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0, 0.0, None]


def test_purge(spark):
    df = frame(spark, ticker=["a"] * 20 + ["b"] * 20, ts=list(daily(20)) * 2, split=["train"] * 40)
    assert {r["count"] for r in S.purge_tail(df, 3).groupBy("ticker").count().collect()} == {17}
    assert S.purge_tail(df, 0).count() == 40
    assert S.purge_tail(df, 20).count() == 0


def test_split_needs_three_times(spark):
    df = frame(spark, ticker=["a", "a"], ts=daily(2))
    with pytest.raises(Exception, match="Not enough timestamps"):
        S.chrono_split(df).collect()


# --- bars --------------------------------------------------------------------

def test_bars_per_year():
    assert B.bars_per_year(5) == 26460


def test_session_ends_are_inclusive(spark):
    ts = pd.to_datetime(["2024-01-02 07:00", "2024-01-02 15:45", "2024-01-02 15:46", "2024-01-06 10:00"])
    assert B.session_filter(frame(spark, ts=ts)).count() == 2


def test_index_returns_only_where_the_index_moves(spark):
    grid = pd.date_range("2024-01-02 07:00", periods=20, freq="5min")
    bars = frame(spark, ticker=["a"] * 20, ts=grid)
    idx = frame(spark, ts=grid[::5], index_x_close=[100.0, 101, 102, 103])
    out = B.index_logret_on_grid(bars, idx).toPandas()
    assert (out["index_x_logret"].abs() > 0).sum() == 3


# --- cross section -----------------------------------------------------------

def test_cross_section(spark):
    df = frame(spark, ts=daily(1).repeat(3), ticker=list("abc"), v=[0.1, 0.5, 0.3], c=[0.5, 0.5, 0.5])
    r = X.xs_features(df, ["v", "c"], relative_mode="ratio").orderBy("ticker").toPandas()
    assert r["v_xrank"].tolist() == [0.0, 1.0, 0.5]
    assert r["c_xzscore"].tolist() == [0.0] * 3 and r["c_xrank"].tolist() == [0.5] * 3
    one = X.xs_rank(df.filter("ticker = 'a'"), "v").first()
    assert one["v_xrank"] == 0.5
    with pytest.raises(ValueError):
        X.xs_relative(df, "v", "other")


# --- microstructure and positioning -------------------------------------------

def test_imbalance(spark):
    df = frame(spark, ticker=["a", "b"], ts=daily(2), vol=[100.0, 0], vol_b=[70.0, 0], vol_s=[30.0, 0])
    assert [r["aps_vol_imb"] for r in M.tradestats_features(df).orderBy("ticker").collect()] == [0.4, 0.0]


def test_concentration_is_not_visible_on_its_day(spark):
    met = frame(spark, ticker=["a"] * 2, tradedate=["2024-01-02", "2024-01-03"], tradetime=["18:40:00"] * 2, metric=["hhi"] * 2, value=[50.0, 90.0])
    bars = frame(spark, ticker=["a"] * 3, ts=pd.to_datetime(["2024-01-02 07:00", "2024-01-03 07:00", "2024-01-04 07:00"]))
    got = [r["aps_hi2_hhi"] for r in M.concentration_asof(met, bars, ["hhi"]).orderBy("ts").collect()]
    assert got == [0.0, 50.0, 90.0]


def test_positioning(spark):
    raw = frame(
        spark, ticker=["a"] * 3, tradedate=["2024-01-02"] * 2 + ["2024-01-03"], tradetime=["10:00:00", "18:40:00", "18:40:00"],
        clgroup=["YUR"] * 3, pos=[1, 100, 130], pos_long=[10, 150, 150], pos_short=[-9, -50, -50],
    )
    out = P.build_positioning(raw).orderBy("day").toPandas()
    assert out["futoi_yur_pos"].tolist() == [100.0, 130.0]
    assert out["futoi_yur_pos_d1"].tolist() == [0.0, 30.0]
    assert out["futoi_yur_imbalance"].tolist() == [0.5, 0.5]


# --- calendar ----------------------------------------------------------------

def test_event_distances(spark):
    days = pd.to_datetime(["2024-01-01", "2024-01-05", "2024-01-10", "2024-03-01"])
    ev = frame(spark, d=["2024-01-08", "2024-02-23"])
    got = E.days_to_next_event(frame(spark, ts=days), ev, "d").orderBy("ts").toPandas()
    assert got["days_to_event"].tolist() == [7, 3, 44, 0]
    null = E.days_to_next_event(frame(spark, ts=days), ev, "d", compat=False).orderBy("ts").collect()
    assert null[3]["days_to_event"] is None
    since = E.days_since_event(frame(spark, ts=days), ev, "d").orderBy("ts").toPandas()
    assert since["days_since_event"].tolist() == [0, 0, 2, 7]


def test_dividends(spark):
    div = frame(spark, registryclosedate=pd.to_datetime(["2024-05-10", "2025-05-10"]), value=[25.0, 33.3])
    out = E.dividend_features(frame(spark, ts=daily(15, "2024-05-01")), div).orderBy("ts").toPandas()
    assert out["div_days_to_ex"][0] == 9 and out["div_value_next"][0] == 25.0
    assert out["div_days_to_ex"][9] == 0 and out["div_is_ex_day"][9] == 1
    assert out["div_value_next"][10] == 33.3 and out["div_value_last"][10] == 25.0


# --- predictions and thresholds ------------------------------------------------

def test_wrong_horizon_count_is_an_error(spark):
    df = spark.sql("select timestamp'2024-01-01' ts, 'a' ticker, array(0.1D) mean, array(0.2D) std")
    with pytest.raises(Exception, match="expected 2 horizons"):
        H.predictions_long(df, (6, 12)).collect()


def long(spark, n=300, seed=0, horizons=(6,)):
    rng = np.random.default_rng(seed)
    ts = daily(n)
    rows = [(t, "a", h) for t in ts for h in horizons]
    df = pd.DataFrame(rows, columns=["ts", "ticker", "horizon"])
    df["mean"] = rng.uniform(0.3, 0.8, len(df))
    df["std"] = 0.1
    return df


def test_auc_matches_pairs(spark):
    p = long(spark, 200)
    p["mean"] = p["mean"].round(2)
    p["actual"] = (np.random.default_rng(1).uniform(size=len(p)) < p["mean"]).astype(float)
    pos, neg = p.loc[p.actual == 1, "mean"].to_numpy(), p.loc[p.actual == 0, "mean"].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(H.auc(spark.createDataFrame(p)).first()["auc"] - want) < 1e-12


def test_joint_grid_matches_brute_force(spark):
    # returns fall with the score, but for a planted cell: primary over 0.6 and the upper fifth of the meta scores
    draw = np.random.RandomState(77)
    m = pd.DataFrame({"primary": draw.beta(5, 4, 900), "meta": draw.exponential(0.2, 900)})
    planted = (m.primary > 0.6) & (m.meta > np.percentile(m.meta, 80))
    m["lr"] = np.where(planted, 0.02, -0.01 * m.primary) + draw.standard_t(8, 900) / 1000
    got = D.joint_threshold_grid(spark.createDataFrame(m), min_trades=50).toPandas()
    best, pick = -np.inf, None
    for t in D.PRIMARY_THRESHOLDS:
        for pct in D.META_PERCENTILES:
            c = np.percentile(m.meta, 100 - pct)
            sub = m[(m.primary > t) & (m.meta > c)]
            row = got[(got.t_primary == t) & (got.meta_pct == pct)].iloc[0]
            assert row.n_trades == len(sub)
            if len(sub) >= 50 and sub.lr.mean() - 0.001 > best:
                best, pick = sub.lr.mean() - 0.001, (t, pct)
    chosen = got[got.chosen].iloc[0]
    assert (chosen.t_primary, chosen.meta_pct) == pick and chosen.t_primary >= 0.6 and chosen.meta_pct <= 20
    none = D.joint_threshold_grid(spark.createDataFrame(m), min_trades=10**6).toPandas()
    assert none.chosen.sum() == 1


def test_conformal_bounds(spark):
    p = long(spark, 100)
    p["mean"] = np.random.default_rng(3).uniform(0.4, 0.6, 100)
    j = spark.createDataFrame(p.assign(actual=1.0))
    c = D.conformal_directional(j).first()
    assert c["n_calibration"] == 100 and 0.35 <= c["threshold"] <= 0.5
    empty = D.conformal_directional(j.filter("actual < 0")).first()
    assert (empty["threshold"], empty["n_calibration"]) == (0.5, 0)
    with pytest.raises(ValueError):
        D.conformal_threshold(j, 1.0)


def test_consensus_truth_table(spark):
    f = frame(spark, p_long=[0.7, 0.3, 0.8, 0.2], p_short=[0.2, 0.7, 0.7, 0.3])
    d = G.consensus_decisions(f, 0.5, 0.5).collect()
    assert [(r["open_long"], r["close_long"]) for r in d] == [(True, False), (False, True), (False, False), (False, False)]
    with pytest.raises(ValueError):
        G.consensus_decisions(f, 0.0, 0.5)


def test_kelly(spark):
    f = frame(spark, mean=[0.4, 0.75, 1.0], meta=[0.9, 0.75, 1.0])
    got = [round(r["size_fraction"], 6) for r in G.kelly_size(f).collect()]
    assert got == [0.0, 0.125, 0.2]


# --- trades --------------------------------------------------------------------

def prices(spark, n=20, low=None):
    c = np.linspace(100, 119, n)
    df = pd.DataFrame({"ticker": "a", "ts": daily(n), "open": c, "high": c + 1, "low": c - 1, "close": c})
    if low:
        df.loc[low[0], "low"] = low[1]
    return df


def signal(spark, bar, h=3, **extra):
    row = {"ts": daily(20)[bar], "ticker": "a", "horizon": h, "mean": 0.9, "action": "BUY", **extra}
    return pd.DataFrame([row])


def test_trade_timing(spark):
    t = R.trade_outcomes(spark.createDataFrame(signal(spark, 0)), spark.createDataFrame(prices(spark))).first()
    assert (t["entry_bar"], t["exit_bar"], t["exit_reason"]) == (1, 4, "horizon")
    late = R.trade_outcomes(spark.createDataFrame(signal(spark, 17)), spark.createDataFrame(prices(spark)))
    assert late.count() == 0


def test_stop_price(spark):
    p = prices(spark, low=(3, 89.0))
    p[["open", "close", "high"]] = 100.0
    p["low"] = np.where(p.index == 3, 89.0, 99.5)
    t = R.trade_outcomes(spark.createDataFrame(signal(spark, 0, 5)), spark.createDataFrame(p), stop_loss=0.02).first()
    assert (t["exit_price"], t["exit_reason"], t["exit_bar"]) == (98.0, "stop_loss", 3)


def test_book_per_series(spark):
    rows = [("a", 1, 4, 0.1), ("a", 2, 4, -0.2), ("a", 6, 9, 0.3), ("b", 1, 2, 0.5)]
    df = spark.createDataFrame(rows, ["ticker", "entry_bar", "exit_bar", "return_pct"])
    got = {(r["ticker"], r["entry_bar"]): r for r in R.per_series_book(df, capital=2000.0, fraction=0.5).collect()}
    assert len(got) == 4 and all(r["invested"] == 500.0 for r in got.values())
    assert [round(got[k]["cash"], 6) for k in (("a", 1), ("a", 2), ("a", 6), ("b", 1))] == [950.0, 950.0, 1100.0, 1250.0]


def test_sizing_modes(spark):
    t = spark.createDataFrame([(0.3, 0.1), (0.0, 0.1), (None, 0.1)], "size_fraction double, return_pct double")
    own = R.position_budget(t, mode="signal_kelly", capital=1000.0, fraction=0.1, cap=0.2).orderBy("invested").collect()
    assert [r["invested"] for r in own] == [100.0, 200.0]
    with pytest.raises(ValueError):
        R.position_budget(t, mode="?")


def test_profit_target(spark):
    p = prices(spark)
    t = R.trade_outcomes(spark.createDataFrame(signal(spark, 0, 5)), spark.createDataFrame(p), profit_target=0.02).first()
    assert t["exit_reason"] == "profit_target" and round(t["exit_price"] / t["entry_price"], 9) == 1.02


def test_rates_of_a_strategy(spark):
    p = spark.createDataFrame(prices(spark))
    s = spark.createDataFrame(pd.concat([signal(spark, b, h) for b, h in ((0, 3), (1, 3), (2, 6))]))
    r = PF.strategy_rates(s, R.trade_outcomes(s, p), p, max_positions=2).first()
    assert (round(r["probability"], 9), r["avg_horizon"]) == (3 / 40, 4)
    none = PF.strategy_rates(s.limit(0), R.trade_outcomes(s.limit(0), p), p).first()
    assert (none["probability"], none["avg_horizon"]) == (0.05, 5)


def test_threshold_sweep_adds_up(spark):
    p = pd.concat([prices(spark).assign(ticker=k) for k in "ab"])
    f = pd.DataFrame([(daily(20)[b], k, h, m, 0.1) for b, k, h, m in
                      ((0, "a", 2, 0.52), (1, "b", 3, 0.61), (5, "a", 2, 0.9), (6, "b", 2, 0.4))],
                     columns=["ts", "ticker", "horizon", "mean", "std"])
    got = {r["threshold"]: r for r in W.threshold_sweep(spark.createDataFrame(f), spark.createDataFrame(p), (0.5, 0.6, 0.95)).collect()}
    assert [(got[t]["n_buy_signals"], got[t]["n_trades"]) for t in (0.5, 0.6, 0.95)] == [(3, 3), (2, 2), (0, 0)]
    assert got[0.95]["final_equity"] == R.INITIAL_CAPITAL
    s = spark.createDataFrame(f[f["mean"] > 0.6].assign(action="BUY"))
    alone = R.position_budget(R.trade_outcomes(s, spark.createDataFrame(p)))
    want = PF.metrics_report(R.book_equity(alone, spark.createDataFrame(p)), alone).first()
    for c in ("final_equity", "sharpe", "max_drawdown", "win_rate", "profit_factor"):
        assert math.isclose(got[0.6][c], want[c], rel_tol=1e-9, abs_tol=1e-12), c


def test_consensus_sweep_keeps_empty_pairs(spark):
    p = spark.createDataFrame(prices(spark))
    f = pd.DataFrame([(daily(20)[1], "a", 3, 0.9, 0.1), (daily(20)[4], "a", 3, 0.1, 0.9)],
                     columns=["ts", "ticker", "horizon", "p_long", "p_short"])
    f = spark.createDataFrame(f)
    got = {(r["t_long"], r["t_short"]): r for r in W.consensus_sweep(f, p, (0.5, 0.95), (0.5, 0.95), max_hold=12).collect()}
    assert len(got) == 4
    assert [(got[k]["n_open_signals"], got[k]["n_close_signals"], got[k]["n_trades"]) for k in sorted(got)] == [(1, 1, 1), (1, 0, 1), (0, 1, 0), (0, 0, 0)]
    assert got[0.95, 0.5]["final_equity"] == R.INITIAL_CAPITAL
    with pytest.raises(ValueError):
        W.consensus_sweep(f, p, (1.0,), (0.5,))


# --- sources -------------------------------------------------------------------

def test_dedupe_keeps_conflicting_values(spark):
    t = daily(1)[0]
    rows = [(t, f"m{i}", 1.0, "1") for i in range(10)] + [(t, "m0", 1.0, "2"), (t, "m1", 7.0, "2")]
    out = N.dedupe_rows(spark.createDataFrame(rows, ["ts", "metric", "value", "SYSTIME"]))
    assert out.count() == 11 and out.filter("metric = 'm0'").first()["SYSTIME"] == "2"


def test_month_chunks(spark):
    df = spark.createDataFrame([("2020-01-01", "2021-01-01")], ["a", "b"])
    c = N.month_chunks(df, "a", "b", 3).orderBy("chunk_start").collect()
    assert len(c) == 4 and str(c[-1]["chunk_start"]) == "2020-10-01" and str(c[-1]["chunk_end"]) == "2021-01-01"
    with pytest.raises(ValueError):
        N.month_chunks(df, "a", "b", 0)


def test_files(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("ts,open,high,low,close,volume\n2024-01-01 07:00:00,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n")
    (tmp_path / "BBB.csv").write_text("ts,open,high,low,close,volume\n2024-01-01 07:00:00,1,2,0.5,,10\n")
    got = L.scan_ticker_files(spark, str(tmp_path)).collect()
    assert [(r["ticker"], r["close"]) for r in got] == [("AAA", 1.5)]
    env = tmp_path / "e.json"
    env.write_text('{"meta": {"x": 1}, "stats": {"columns": ["A", "b"], "data": [[1, "u"], [2, null]]}}')
    rows = L.scan_json_envelope(spark, str(env), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", "u"), ("2", None)]
    xml = tmp_path / "r.xml"
    xml.write_text('<C><Record Date="31.12.2023"><Nominal>10</Nominal><Value>91,5</Value></Record><Record Date="x"><Value>1</Value></Record></C>')
    assert [r["value"] for r in L.scan_fx_rates(spark, str(xml)).collect()] == [9.15]
    kr = tmp_path / "k.xml"
    kr.write_text('<E xmlns:w="http://example.org"><w:KR><w:DT>2024-01-01</w:DT><w:Rate>16,0</w:Rate></w:KR><w:KR><w:DT>2024-01-02</w:DT></w:KR></E>')
    assert [r["key_rate"] for r in L.scan_key_rates(spark, str(kr)).collect()] == [16.0]


def test_permutation_null_by_hand(spark):
    """Labels dealt by the order of md5("k:i"); the starts of the buckets go to the copies, which travel once."""
    from hashlib import md5

    from barloom.operators.predictions import permutation_null

    n, k = 60, 5
    y, p = [float(i * 7 % 3 == 0) for i in range(n)], [0.05 + 0.9 * (i * 37 % n) / n for i in range(n)]
    df = frame(spark, ts=daily(n), ticker=["a"] * n, horizon=[1] * n, mean=p, actual=y)
    out = permutation_null(df, k)
    null = []
    for s in range(k):
        order = sorted(range(n), key=lambda i: md5(f"{s}:{i}".encode()).hexdigest())
        moved = [y[i] for i in order]
        null.append(-sum(math.log(q if one else 1 - q) for one, q in zip(moved, p)) / n)
    got = out.first()
    assert math.isclose(got["loss_null_mean"], sum(null) / k) and math.isclose(got["loss_null_min"], min(null))
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()


def test_book_marks_of_long_and_gappy_trades(spark):
    """Trades over several blocks of bars; a bar without a close keeps the entry price. Bars are not shuffled."""
    n, gaps = 200, {5, 64, 130, 199}
    close = {b: 10.0 + b % 17 for b in range(n) if b not in gaps}
    days = daily(n)
    p = frame(spark, ts=[days[b] for b in close] + list(days), ticker=["a"] * len(close) + ["b"] * n, close=[*close.values(), *[1.0] * n])
    held = [(1, "a", 10.0, 3, 4, 100.0, 1.0), (1, "a", 12.0, 1, 199, 50.0, 2.0), (2, "a", 20.0, 64, 129, 70.0, 3.0), (2, "c", 5.0, 128, 140, 10.0, 0.0)]
    t = spark.createDataFrame(held, "run int, ticker string, entry_price double, entry_bar bigint, exit_bar bigint, invested double, pnl double")
    _, marked, _ = R.book_marks(t, p, run=["run"], cost=0.01)
    want = {}
    for run, ticker, price, entry, leave, money, _ in held:
        for b in range(entry - 1, leave):
            now = close.get(b, price) if ticker == "a" else price
            want[run, b] = want.get((run, b), 0.0) + money * 0.99 / price * now - money
    got = {(r["run"], r["bar"]): r["_open"] for r in marked.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(greatest") < plan.index("Join LeftOuter")


def test_microstructure_panel_folds_once(spark):
    """Orders per trade come from the fold of the snapshots, not from a second reading of them."""
    from barloom.operators.microstructure import microstructure_panel, order_to_trade

    trades = spark.createDataFrame([("A", "2024-01-01", 4.0), ("A", "2024-01-02", 0.0)], "ticker string, ts string, trades double")
    orders = spark.createDataFrame([("A", "2024-01-01", 6.0), ("B", "2024-01-01", 5.0)], "ticker string, ts string, put_orders double")
    out = microstructure_panel(trades=trades, orders=orders)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {tuple(r) for r in out.select("ticker", "ts", "aps_order_to_trade").collect()}
    assert got == {("A", "2024-01-01", 1.5), ("A", "2024-01-02", 0.0), ("B", "2024-01-01", 0.0)}
    assert got == {tuple(r) for r in order_to_trade(orders, trades).collect()}


def test_concentration_takes_the_last_time_whole(spark):
    from barloom.operators.microstructure import concentration_asof

    rows = [("A", "2024-01-01", "10:00:00", "x", 0.4), ("A", "2024-01-01", "18:40:00", "y", 0.3), ("A", "2024-01-01", "10:00:00", "y", 0.2)]
    metrics = spark.createDataFrame(rows, "ticker string, tradedate string, tradetime string, metric string, value double")
    bars = spark.createDataFrame([("A", "2024-01-01", 7), ("A", "2024-01-03", 8)], "ticker string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    out = concentration_asof(metrics, bars, ["x", "y"], keep=["n"]).orderBy("ts").collect()
    assert [(r.n, r.aps_hi2_x, r.aps_hi2_y) for r in out] == [(7, 0.0, 0.0), (8, 0.0, 0.3)]
