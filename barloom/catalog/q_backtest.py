"""Queries of trades, equity, metrics and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.q_decisions import BEST, CONS
from barloom.catalog.q_evaluation import sel
from barloom.catalog.q_sources import landing
from barloom.catalog.registry import query, rnd
from barloom.operators import performance as P
from barloom.operators import signals as G
from barloom.operators import sweeps as W
from barloom.operators import trades as R
from barloom.operators.single_book import single_position_book
from barloom.plans import panels as S
from barloom.session import materialize
from barloom.sources import incremental as N

T = 0.6
FEE = "0.0005::DOUBLE"


def stored(spark, sf):
    return materialize(S.model_panel(spark, sf))


def prices_of(panel):
    return panel.select("ts", "ticker", "open", "high", "low", "close")


def trades_of(spark, sf, **kw):
    """Trades of the threshold strategy and the prices they were made on."""
    panel = stored(spark, sf)
    signals = G.threshold_signals(S.predictions(spark, sf, panel=panel), T)
    return R.trade_outcomes(signals, prices_of(panel), **kw), prices_of(panel)


AXIS = """axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM bars)),
ix AS (SELECT bars.*, bar FROM bars JOIN axis USING (ts)), lastbar AS (SELECT max(bar) AS last FROM axis)"""


def trades_sql(buys: str) -> str:
    """``buys``: a query of ts, ticker, horizon, mean (+ keys)."""
    return f"""{AXIS}, buys AS ({buys}),
b1 AS (SELECT b.*, bar + 1 AS entry_bar, bar + 1 + horizon AS due_bar FROM buys b JOIN axis USING (ts), lastbar WHERE bar + 1 + horizon <= last),
b2 AS (SELECT b1.*, ix.ts AS open_ts, ix.open AS entry_price FROM b1 JOIN ix ON ix.ticker = b1.ticker AND ix.bar = entry_bar WHERE ix.open > 0),
t0 AS (SELECT b2.*, coalesce(ix.bar, last) AS exit_bar, coalesce(ix.open, entry_price) AS exit_price
  FROM b2 CROSS JOIN lastbar ASOF LEFT JOIN ix ON b2.ticker = ix.ticker AND b2.due_bar <= ix.bar),
t1 AS (SELECT t0.* EXCLUDE (ts), t0.ts AS signal_ts, axis.ts AS close_ts,
  (1 - {FEE}) * exit_price / entry_price * (1 - {FEE}) - 1 AS return_pct FROM t0 JOIN axis ON axis.bar = exit_bar)"""


BUYS = f"SELECT ts, ticker, horizon, mean FROM ranked WHERE rk <= 5 AND mean > {T}"
TR = f"{S.PREDS}, {BEST}, {trades_sql(BUYS)}"
_TCOLS = f"""ticker, horizon, {', '.join(f"strftime({t}, '%Y-%m-%d %H:%M:%S') AS {t}" for t in ('signal_ts', 'open_ts', 'close_ts'))},
  entry_bar, exit_bar, exit_reason, {', '.join(f'{rnd(c)} AS {c}' for c in ('mean', 'entry_price', 'exit_price', 'return_pct'))}"""
_TOUT = ["ticker", "horizon", "signal_ts", "open_ts", "close_ts", "entry_bar", "exit_bar", "exit_reason",
         "mean", "entry_price", "exit_price", "return_pct"]


@query(f"WITH {TR}, o AS (SELECT *, 'horizon' AS exit_reason FROM t1) SELECT {_TCOLS} FROM o")
def q_trade_outcomes(spark, sf):
    return trades_of(spark, sf)[0].select(*_TOUT)


def barrier_sql(sl: float, pt: float) -> str:
    return f"""steps AS (SELECT DISTINCT ticker, entry_bar, horizon, entry_price, unnest(range(entry_bar + 1, due_bar + 1) || [exit_bar]) AS bar FROM t1),
hits AS (SELECT s.ticker, s.entry_bar, s.horizon, s.bar, ix.ts, CASE WHEN low <= entry_price * (1.0::DOUBLE - {sl}::DOUBLE) THEN 'stop_loss'
    WHEN high >= entry_price * (1.0::DOUBLE + {pt}::DOUBLE) THEN 'profit_target' END AS why FROM steps s JOIN ix ON ix.ticker = s.ticker AND ix.bar = s.bar),
h1 AS (SELECT ticker, entry_bar, horizon, min(bar) AS hit, arg_min(why, bar) AS why, arg_min(ts, bar) AS hit_ts FROM hits WHERE why IS NOT NULL GROUP BY 1, 2, 3),
tb0 AS (SELECT t1.* EXCLUDE (exit_price, exit_bar, close_ts, return_pct), CASE why WHEN 'stop_loss' THEN entry_price * (1.0::DOUBLE - {sl}::DOUBLE)
    WHEN 'profit_target' THEN entry_price * (1.0::DOUBLE + {pt}::DOUBLE) ELSE exit_price END AS exit_price, coalesce(hit, exit_bar) AS exit_bar,
    coalesce(hit_ts, close_ts) AS close_ts, coalesce(why, 'horizon') AS exit_reason FROM t1 LEFT JOIN h1 USING (ticker, entry_bar, horizon)),
tb AS (SELECT *, (1 - {FEE}) * exit_price / entry_price * (1 - {FEE}) - 1 AS return_pct FROM tb0)"""


@query(f"WITH {TR}, {barrier_sql(0.2, 0.3)} SELECT {_TCOLS} FROM tb")
def q_barrier_exit(spark, sf):
    return trades_of(spark, sf, stop_loss=0.2, profit_target=0.3)[0].select(*_TOUT)


@query(f"""WITH {TR}, {barrier_sql(0.2, 0.3)} SELECT horizon, count(*) FILTER (exit_reason = 'horizon') AS horizon_exits,
  count(*) FILTER (exit_reason = 'stop_loss') AS stop_loss, count(*) FILTER (exit_reason = 'profit_target') AS profit_target FROM tb GROUP BY horizon""")
def q_exit_reasons(spark, sf):
    t = trades_of(spark, sf, stop_loss=0.2, profit_target=0.3)[0].withColumnRenamed("horizon", "h")
    r = P.exit_reasons(t, ["h"])
    return r.select(F.col("h").alias("horizon"), F.col("horizon").alias("horizon_exits"), "stop_loss", "profit_target")


@query(f"""WITH {TR}, o AS (SELECT ticker, entry_bar, least(0.1::DOUBLE * 1000000, 1000000.0::DOUBLE) AS invested, 100000.0::DOUBLE * return_pct AS pnl FROM t1)
  SELECT ticker, entry_bar, {sel(['invested', 'pnl'], 2)} FROM o""", digits=2)
def q_position_budget(spark, sf):
    return R.position_budget(trades_of(spark, sf)[0]).select("ticker", "entry_bar", "invested", "pnl")


BOOK = f"""{TR}, cap AS (SELECT 1000000.0::DOUBLE / count(DISTINCT ticker) AS c FROM t1),
book AS (SELECT *, c * 0.1::DOUBLE AS invested, c * 0.1::DOUBLE * return_pct AS pnl,
  c + sum(c * 0.1::DOUBLE * return_pct) OVER (PARTITION BY ticker ORDER BY exit_bar RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cash FROM t1, cap)"""


@query(f"WITH {BOOK} SELECT ticker, horizon, entry_bar, exit_bar, {sel(['invested', 'pnl', 'cash'], 2)} FROM book", digits=2)
def q_per_series_book(spark, sf):
    return R.per_series_book(trades_of(spark, sf)[0]).select("ticker", "horizon", "entry_bar", "exit_bar", "invested", "pnl", "cash")


@query(f"""WITH RECURSIVE {TR}, u AS MATERIALIZED (SELECT * FROM t1 QUALIFY row_number() OVER (PARTITION BY ticker, entry_bar ORDER BY mean DESC, horizon, exit_bar) = 1),
  nx AS MATERIALIZED (SELECT a.ticker, a.entry_bar, b.entry_bar AS nxt FROM u a ASOF JOIN u b ON a.ticker = b.ticker AND b.entry_bar >= greatest(a.exit_bar, a.entry_bar + 1)),
  chain AS (SELECT ticker, min(entry_bar) AS entry_bar FROM u GROUP BY ticker UNION ALL SELECT c.ticker, n.nxt FROM chain c JOIN nx n ON n.ticker = c.ticker AND n.entry_bar = c.entry_bar),
  cap AS (SELECT 1000000.0::DOUBLE / count(DISTINCT ticker) AS c FROM u),
  o AS (SELECT u.ticker, horizon, u.entry_bar, exit_bar, return_pct, c * exp(sum(ln(1 + return_pct)) OVER w) AS cash,
      c * exp(sum(ln(1 + return_pct)) OVER w - ln(1 + return_pct)) AS invested FROM u JOIN chain ON chain.ticker = u.ticker AND chain.entry_bar = u.entry_bar, cap
    WINDOW w AS (PARTITION BY u.ticker ORDER BY u.entry_bar))
  SELECT ticker, horizon, entry_bar, exit_bar, {rnd('ln(invested)')} AS log_invested, {rnd('ln(cash)')} AS log_cash, {rnd('return_pct')} AS return_pct FROM o""")
def q_single_position_book(spark, sf):
    """One open position per series, the whole cash of the series in it; amounts as logarithms, since they grow by factors."""
    book = single_position_book(trades_of(spark, sf)[0])
    return book.select("ticker", "horizon", "entry_bar", "exit_bar", F.log("invested").alias("log_invested"), F.log("cash").alias("log_cash"), "return_pct")


@query(f"""WITH {TR}, z AS (SELECT t1.*, CAST(least(0.2::DOUBLE, greatest(0, t1.mean - 0.5::DOUBLE) / 0.5::DOUBLE
    * (greatest(0, m.mean - 0.5::DOUBLE) / 0.5::DOUBLE) * 0.5::DOUBLE) AS FLOAT)::DOUBLE AS f FROM t1 JOIN meta_preds m ON m.ts = t1.signal_ts AND m.ticker = t1.ticker AND m.horizon = t1.horizon),
  o AS (SELECT ticker, horizon, entry_bar, least(f, 0.1::DOUBLE) * 1000000.0::DOUBLE AS invested, least(f, 0.1::DOUBLE) * 1000000.0::DOUBLE * return_pct AS pnl FROM z WHERE f > 0)
  SELECT ticker, horizon, entry_bar, {sel(['invested', 'pnl'], 2)} FROM o""", digits=2)
def q_kelly_budget(spark, sf):
    """Positions of the signal's own Kelly share, capped at a tenth of the capital."""
    panel = stored(spark, sf)
    signals = G.threshold_signals(S.predictions(spark, sf, panel=panel), T).filter("action = 'BUY'")
    meta = S.predictions(spark, sf, "meta", panel).select("ts", "ticker", "horizon", F.col("mean").alias("meta"))
    sized = G.kelly_size(signals.join(meta, ["ts", "ticker", "horizon"]))
    trades = R.trade_outcomes(sized, prices_of(panel), keep=["size_fraction"])
    return R.position_budget(trades, mode="signal_kelly", cap=0.1).select("ticker", "horizon", "entry_bar", "invested", "pnl")


PAIRS = f"""{AXIS}, d AS (SELECT dec.*, bar FROM dec JOIN axis USING (ts)),
o1 AS MATERIALIZED (SELECT ticker, ts AS signal_ts, bar + 1 AS entry_bar, p_long FROM d WHERE open_long),
o2 AS (SELECT o1.*, ix.open AS entry_price, ix.ts AS open_ts FROM o1 JOIN ix ON ix.ticker = o1.ticker AND ix.bar = entry_bar WHERE ix.open > 0),
o3 AS MATERIALIZED (SELECT o2.*, c.bar AS cb FROM o2 ASOF LEFT JOIN (SELECT ticker, bar FROM d WHERE close_long) c ON o2.ticker = c.ticker AND o2.entry_bar <= c.bar),
o4 AS (SELECT *, least(coalesce(cb, entry_bar + 12), entry_bar + 12) AS stop, CASE WHEN cb <= entry_bar + 12 THEN 'signal' ELSE 'max_hold' END AS exit_reason FROM o3),
o5 AS (SELECT o4.*, stop - entry_bar AS horizon, coalesce(ix.bar, last) AS exit_bar, coalesce(ix.open, entry_price) AS exit_price FROM o4 CROSS JOIN lastbar
  ASOF LEFT JOIN ix ON o4.ticker = ix.ticker AND o4.stop + 1 <= ix.bar),
o6 AS MATERIALIZED (SELECT *, (1 - {FEE}) * exit_price / entry_price * (1 - {FEE}) - 1 AS return_pct FROM o5)"""


@query(f"""WITH {CONS}, {PAIRS} SELECT ticker, strftime(signal_ts, '%Y-%m-%d %H:%M:%S') AS signal_ts, entry_bar, exit_bar, horizon, exit_reason,
  {sel(['entry_price', 'exit_price', 'return_pct'])} FROM o6""")
def q_signal_exit_pairs(spark, sf):
    panel = stored(spark, sf)
    frame = G.consensus_frame(S.predictions(spark, sf, panel=panel), S.predictions(spark, sf, "short", panel))
    dec = materialize(G.consensus_decisions(frame, 0.5, 0.5))
    return R.signal_exit_pairs(dec, prices_of(panel), max_hold=12).select(
        "ticker", "signal_ts", "entry_bar", "exit_bar", "horizon", "exit_reason", "entry_price", "exit_price", "return_pct"
    )


# --- equity and metrics of the fixed-fraction book per horizon ---------------

EQ = f"""{TR}, sized AS (SELECT *, 100000.0::DOUBLE AS invested, 100000.0::DOUBLE * return_pct AS pnl FROM t1),
held AS (SELECT horizon, ticker, entry_price, invested, invested * (1 - {FEE}) / entry_price AS q, unnest(range(entry_bar - 1, exit_bar)) AS bar FROM sized),
marked AS (SELECT horizon, h.bar, sum(q * coalesce(ix.close, entry_price) - invested) AS op FROM held h LEFT JOIN ix ON ix.ticker = h.ticker AND ix.bar = h.bar GROUP BY 1, 2),
real AS (SELECT horizon, exit_bar AS bar, sum(pnl) AS pnl FROM sized GROUP BY 1, 2),
grid AS (SELECT horizon, axis.ts, axis.bar FROM axis, (SELECT DISTINCT horizon FROM sized)),
equity AS MATERIALIZED (SELECT horizon, ts, bar, 1000000.0::DOUBLE + sum(coalesce(pnl, 0)) OVER (PARTITION BY horizon ORDER BY bar) + coalesce(op, 0) AS equity
  FROM grid LEFT JOIN marked USING (horizon, bar) LEFT JOIN real USING (horizon, bar)),
rets AS (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY horizon ORDER BY bar) - 1, 0) AS ret,
  equity / max(equity) OVER (PARTITION BY horizon ORDER BY bar) - 1 AS drawdown FROM equity)"""


def equity_of(spark, sf):
    trades, prices = trades_of(spark, sf)
    sized = materialize(R.position_budget(trades))
    return materialize(R.book_equity(sized, prices, run=["horizon"])), sized


@query(f"WITH {EQ} SELECT horizon, bar, {rnd('equity', 2)} AS equity FROM equity", digits=2)
def q_book_equity(spark, sf):
    return equity_of(spark, sf)[0].drop("ts")


@query(f"WITH {EQ} SELECT horizon, bar, {rnd('ret')} AS ret FROM rets")
def q_equity_returns(spark, sf):
    return P.equity_returns(equity_of(spark, sf)[0], ["horizon"]).select("horizon", "bar", "ret")


@query(f"WITH {EQ} SELECT horizon, bar, {rnd('drawdown')} AS drawdown FROM rets")
def q_drawdown(spark, sf):
    return P.drawdown(equity_of(spark, sf)[0], ["horizon"]).select("horizon", "bar", "drawdown")


_SH = "CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(252.0::DOUBLE) ELSE 0 END"


@query(f"WITH {EQ} SELECT horizon, {rnd(_SH)} AS sharpe FROM rets GROUP BY horizon")
def q_sharpe(spark, sf):
    return P.sharpe(P.equity_returns(equity_of(spark, sf)[0], ["horizon"]), ["horizon"])


_TM = """SELECT horizon, count(*) AS n_trades, avg(CAST(pnl > 0 AS INT)) AS win_rate,
  sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor, sum(pnl) AS total_pnl FROM sized GROUP BY horizon"""


@query(f"WITH {EQ}, o AS ({_TM}) SELECT horizon, n_trades, {sel(['win_rate', 'profit_factor'])}, {rnd('total_pnl', 2)} AS total_pnl FROM o", money=("total_pnl", "final_equity"))
def q_trade_metrics(spark, sf):
    return P.trade_metrics(R.position_budget(trades_of(spark, sf)[0]), ["horizon"])


_ENDS = """SELECT horizon, count(*) AS n_bars, arg_max(equity, bar) AS final_equity, arg_max(equity, bar) / arg_min(equity, bar) - 1 AS total_return,
  pow(arg_max(equity, bar) / arg_min(equity, bar), 252.0::DOUBLE / count(*)) - 1 AS annualized_return FROM equity GROUP BY horizon"""
_EC = ["final_equity", "total_return", "annualized_return"]


@query(f"WITH {EQ}, o AS ({_ENDS}) SELECT horizon, n_bars, {sel(_EC[1:])}, {rnd('final_equity', 2)} AS final_equity FROM o", money=("total_pnl", "final_equity"))
def q_total_return(spark, sf):
    return P.total_return(equity_of(spark, sf)[0], ["horizon"])


@query(f"""WITH {EQ}, a AS ({_ENDS}), b AS ({_TM}), c AS (SELECT horizon, {_SH} AS sharpe, min(drawdown) AS max_drawdown FROM rets GROUP BY horizon)
  SELECT horizon, n_bars, n_trades, {sel([*_EC[1:], 'sharpe', 'max_drawdown', 'win_rate', 'profit_factor'])}, {sel(['final_equity', 'total_pnl'], 2)}
  FROM a JOIN b USING (horizon) JOIN c USING (horizon)""", money=("total_pnl", "final_equity"))
def q_metrics_report(spark, sf):
    equity, sized = equity_of(spark, sf)
    return P.metrics_report(equity, sized, ["horizon"])


# --- null distribution --------------------------------------------------------

_DRAW = "((({s} + agent::BIGINT * {a} + bar * {b}) % 2147483648) / 2147483648.0::DOUBLE)"
RATES = """rates AS (SELECT CASE WHEN nb > 0 THEN greatest(least(nb / (bars * 5.0::DOUBLE), 1), 1e-4) ELSE 0.05 END AS prob,
    CAST(coalesce(round_even((SELECT avg(horizon) FROM t1), 0), 5) AS BIGINT) AS avg_h
  FROM (SELECT count(*) AS nb FROM buys), (SELECT count(DISTINCT ts) AS bars FROM bars))"""
NULLS = f"""{TR}, {RATES}, num AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS number, count(*) OVER () AS nt FROM (SELECT DISTINCT ticker FROM bars)),
draws AS (SELECT agent, bar, floor({_DRAW.format(s=11, a=69069, b=1664525)} * (SELECT max(nt) FROM num))::BIGINT AS number,
    greatest(avg_h - 2, 1) + floor({_DRAW.format(s=13, a=22695477, b=1013904)} * (greatest(avg_h + 3, 2) - greatest(avg_h - 2, 1)))::BIGINT AS hold
  FROM axis, rates, (SELECT unnest(range(100))::BIGINT AS agent) WHERE {_DRAW.format(s=7, a=1103515245, b=12345)} < prob),
nt AS (SELECT d.*, e.close AS entry_price, coalesce(x.close, e.close) AS exit_price FROM draws d CROSS JOIN lastbar JOIN num USING (number)
  JOIN ix e ON e.ticker = num.ticker AND e.bar = d.bar LEFT JOIN ix x ON x.ticker = num.ticker AND x.bar = d.bar + hold WHERE d.bar + hold <= last),
agents AS (SELECT agent::INT AS agent, count(entry_price) AS n_trades,
    1000000.0::DOUBLE + coalesce(sum(((1 - {FEE}) * exit_price / entry_price * (1 - {FEE}) - 1) * 100000.0::DOUBLE), 0) AS final_equity
  FROM (SELECT unnest(range(100)) AS agent) LEFT JOIN nt USING (agent) GROUP BY agent)"""


@query(f"WITH {NULLS} SELECT agent, n_trades, {rnd('final_equity', 2)} AS final_equity FROM agents", money=("final_equity",))
def q_random_entry_null(spark, sf):
    """Agents that enter as often and hold as long as the threshold strategy."""
    return null_of(spark, sf)[0]


def null_of(spark, sf):
    panel = stored(spark, sf)
    signals = materialize(G.threshold_signals(S.predictions(spark, sf, panel=panel), T))
    trades = materialize(R.trade_outcomes(signals, prices_of(panel)))
    rates = P.strategy_rates(signals, trades, prices_of(panel))
    return P.random_entry_null(prices_of(panel), rates=rates), trades, panel


_Z = ["null_mean", "null_std", "strategy_final", "threshold", "z_score"]


@query(f"""WITH {NULLS}, f AS (SELECT 1000000.0::DOUBLE + sum(100000.0::DOUBLE * return_pct) AS strategy_final FROM t1),
  o AS (SELECT avg(final_equity) AS null_mean, stddev_pop(final_equity) AS null_std, any_value(strategy_final) AS strategy_final,
    avg(final_equity) + 3 * stddev_pop(final_equity) AS threshold, (any_value(strategy_final) - avg(final_equity)) / stddev_pop(final_equity) AS z_score FROM agents, f)
  SELECT {sel(_Z, 4)}, CAST(strategy_final >= threshold AS INT) AS significant FROM o""", digits=4)
def q_three_sigma_test(spark, sf):
    """The final equity of the threshold strategy against the agents."""
    agents, trades, panel = null_of(spark, sf)
    equity = R.book_equity(materialize(R.position_budget(trades)), prices_of(panel))
    return P.three_sigma_test(agents, P.total_return(equity).select("final_equity"))


@query(f"""WITH {TR}, s AS (SELECT min(return_pct) AS lo, max(return_pct) AS hi FROM t1), b AS (
  SELECT CAST(least(39, floor((return_pct - lo) / ((hi - lo) / 40))) AS INT) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM t1, s GROUP BY 1)
  SELECT bin, n, {rnd('(lo + bin * ((hi - lo) / 40))')} AS left_edge FROM b""")
def q_histogram(spark, sf):
    return P.histogram(materialize(trades_of(spark, sf)[0].select("return_pct")), "return_pct")


# --- sweeps -------------------------------------------------------------------

_TS = list(W.SWEEP_THRESHOLDS)
SWEEP = f"""{S.PREDS}, {BEST}, {trades_sql('SELECT ts, ticker, horizon, mean FROM ranked WHERE rk <= 5')},
g AS (SELECT unnest({_TS}::DOUBLE[]) AS threshold),
nb AS (SELECT threshold, count(*) FILTER (mean > threshold) AS n_buy_signals FROM (SELECT mean FROM ranked WHERE rk <= 5), g GROUP BY threshold),
sized AS (SELECT t1.*, threshold, 100000.0::DOUBLE AS invested, 100000.0::DOUBLE * return_pct AS pnl FROM t1, g WHERE mean > threshold)"""
SWEEP_EQ = f"""{SWEEP}, {EQ.split('held AS', 1)[1].join(['held AS', '']).replace('horizon', 'threshold')}"""
_SW = ["final_equity", "total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor"]


# the null distribution is of the strategy at T; its trades and the sweep's share the names, so it goes first
_NULL = f"WITH {NULLS} SELECT avg(final_equity) AS m, stddev_pop(final_equity) AS s FROM agents"


@query(f"""WITH nulls AS ({_NULL}), {SWEEP_EQ}, a AS ({_ENDS.replace('horizon', 'threshold')}), b AS ({_TM.replace('horizon', 'threshold')}),
  c AS (SELECT threshold, {_SH} AS sharpe, min(drawdown) AS max_drawdown FROM rets GROUP BY threshold),
  o AS (SELECT threshold, n_buy_signals, coalesce(n_trades, 0) AS n_trades, coalesce(final_equity, 1000000) AS final_equity,
    {', '.join(f"coalesce({x}, 0) AS {x}" for x in _SW[1:])}, CASE WHEN n_buy_signals > 0 THEN (coalesce(final_equity, 1000000) - m) / s ELSE 0 END AS z_score
  FROM nb LEFT JOIN a USING (threshold) LEFT JOIN b USING (threshold) LEFT JOIN c USING (threshold), nulls)
  SELECT threshold, n_buy_signals, n_trades, {rnd('final_equity', 2)} AS final_equity, {sel([*_SW[1:], 'z_score'], 5)}, CAST(z_score >= 3 AS INT) AS significant
  FROM o""", digits=5, money=("final_equity",))
def q_threshold_sweep(spark, sf):
    null, _, panel = null_of(spark, sf)
    return W.threshold_sweep(S.predictions(spark, sf, panel=panel), prices_of(panel), null=materialize(null))


_GRID = list(W.CONSENSUS_GRID)
_PAIRS_G = (
    PAIRS.replace("SELECT ticker, ts AS signal_ts, bar + 1 AS entry_bar, p_long FROM d", "SELECT ticker, pair, ts AS signal_ts, bar + 1 AS entry_bar, p_long FROM d")
    .replace("(SELECT ticker, bar FROM d WHERE close_long) c ON o2.ticker = c.ticker", "(SELECT ticker, pair, bar FROM d WHERE close_long) c ON o2.ticker = c.ticker AND o2.pair = c.pair")
)
_EQ_TAIL = EQ.split("held AS", 1)[1].join(["held AS", ""])


@query(f"""WITH {CONS.split('dec AS', 1)[0]} pairs AS (SELECT t_long, t_short, row_number() OVER (ORDER BY t_long, t_short) AS pair
    FROM (SELECT unnest({_GRID}::DOUBLE[]) AS t_long), (SELECT unnest({_GRID}::DOUBLE[]) AS t_short)),
  dec AS MATERIALIZED (SELECT cons.*, pair, p_long > t_long AND NOT p_short > t_short AS open_long,
    p_short > t_short AND NOT p_long > t_long AS close_long FROM cons, pairs), {_PAIRS_G},
  sized AS (SELECT *, 100000.0::DOUBLE AS invested, 100000.0::DOUBLE * return_pct AS pnl FROM o6), {_EQ_TAIL.replace('horizon', 'pair')},
  n AS (SELECT pair, count(*) FILTER (open_long) AS n_open_signals, count(*) FILTER (close_long) AS n_close_signals FROM dec GROUP BY pair),
  a AS ({_ENDS.replace('horizon', 'pair')}), b AS ({_TM.replace('horizon', 'pair')}),
  c AS (SELECT pair, {_SH} AS sharpe, min(drawdown) AS max_drawdown FROM rets GROUP BY pair),
  o AS (SELECT t_long, t_short, n_open_signals, n_close_signals, coalesce(n_trades, 0) AS n_trades, coalesce(final_equity, 1000000) AS final_equity,
    {', '.join(f"coalesce({x}, 0) AS {x}" for x in ('total_return', 'sharpe', 'max_drawdown', 'win_rate'))}
    FROM pairs LEFT JOIN n USING (pair) LEFT JOIN a USING (pair) LEFT JOIN b USING (pair) LEFT JOIN c USING (pair))
  SELECT t_long, t_short, n_open_signals, n_close_signals, n_trades, {rnd('final_equity', 2)} AS final_equity,
    {sel(['total_return', 'sharpe', 'max_drawdown', 'win_rate'], 5)} FROM o""", digits=5, money=("final_equity",))
def q_consensus_sweep(spark, sf):
    panel = stored(spark, sf)
    frame = G.consensus_frame(S.predictions(spark, sf, panel=panel), S.predictions(spark, sf, "short", panel))
    return W.consensus_sweep(frame, prices_of(panel), max_hold=12)


_RP, _RM = list(W.RELAX_PRIMARY), list(W.RELAX_META)


@query(f"""WITH {S.PREDS}, both_p AS (SELECT p.*, m.mean AS meta FROM preds p JOIN meta_preds m USING (ts, ticker, horizon)),
  cuts AS ({' UNION ALL '.join(f"SELECT {p}::DOUBLE AS meta_percent, quantile_cont(meta, {1 - p / 100}) AS t_meta FROM both_p" for p in _RM)}),
  grid0 AS (SELECT *, row_number() OVER (ORDER BY t_primary, meta_percent) AS pair FROM cuts, (SELECT unnest({_RP}::DOUBLE[]) AS t_primary)),
  fits AS (SELECT b.ts, b.ticker, b.horizon, b.mean, pair FROM both_p b, grid0 g WHERE b.mean > t_primary AND b.meta > t_meta),
  nb AS (SELECT pair, count(*) AS n_buy FROM fits GROUP BY pair HAVING count(*) >= 5), {trades_sql('SELECT * FROM fits SEMI JOIN nb USING (pair)')},
  sized AS (SELECT *, 100000.0::DOUBLE AS invested, 100000.0::DOUBLE * return_pct AS pnl FROM t1), {_EQ_TAIL.replace('horizon', 'pair')},
  a AS ({_ENDS.replace('horizon', 'pair')}), b AS ({_TM.replace('horizon', 'pair')}), c AS (SELECT pair, {_SH} AS sharpe FROM rets GROUP BY pair),
  o AS (SELECT t_primary, meta_percent, t_meta, n_buy, coalesce(n_trades, 0) AS n_trades, coalesce(sharpe, 0) AS sharpe, coalesce(total_return, 0) AS total_return
    FROM nb JOIN grid0 USING (pair) LEFT JOIN a USING (pair) LEFT JOIN b USING (pair) LEFT JOIN c USING (pair))
  SELECT t_primary, meta_percent, {sel(['t_meta', 'sharpe', 'total_return'], 5)}, n_buy, n_trades FROM o""", digits=5)
def q_relaxation_sweep(spark, sf):
    panel = stored(spark, sf)
    return W.relaxation_sweep(S.predictions(spark, sf, panel=panel), S.predictions(spark, sf, "meta", panel), prices_of(panel))


_SL, _PTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5], [0.0, 0.1, 0.3, 0.5, 0.7, 1.0]
BARRIERS = f"""{TR}, lv AS (SELECT sl, pt FROM (SELECT unnest({_SL}::DOUBLE[]) AS sl), (SELECT unnest({_PTS}::DOUBLE[]) AS pt)),
steps AS (SELECT DISTINCT ticker, entry_bar, horizon, entry_price, unnest(range(entry_bar + 1, due_bar + 1) || [exit_bar]) AS bar FROM t1),
path AS (SELECT s.*, low, high FROM steps s JOIN ix ON ix.ticker = s.ticker AND ix.bar = s.bar),
hits AS (SELECT ticker, entry_bar, horizon, sl, pt, min(bar) AS hit, arg_min(CASE WHEN sl > 0 AND low <= entry_price * (1.0::DOUBLE - sl) THEN 's' ELSE 'p' END, bar) AS why
  FROM path, lv WHERE (sl > 0 AND low <= entry_price * (1.0::DOUBLE - sl)) OR (pt > 0 AND high >= entry_price * (1.0::DOUBLE + pt)) GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT t1.horizon, lv.sl, lv.pt, why, (1 - {FEE}) * CASE why WHEN 's' THEN entry_price * (1.0::DOUBLE - lv.sl) WHEN 'p' THEN entry_price * (1.0::DOUBLE + lv.pt)
    ELSE exit_price END / entry_price * (1 - {FEE}) - 1 AS r FROM t1 CROSS JOIN lv LEFT JOIN hits h ON h.ticker = t1.ticker AND h.entry_bar = t1.entry_bar
    AND h.horizon = t1.horizon AND h.sl = lv.sl AND h.pt = lv.pt),
sweep AS (SELECT horizon, sl AS sl_pct, pt AS pt_pct, count(*) AS n_trades, count(*) FILTER (why = 's') AS sl_exits, count(*) FILTER (why = 'p') AS pt_exits,
  avg(CAST(r > 0 AS INT)) AS win_rate, avg(r) AS mean_return, CASE WHEN stddev_pop(r) > 1e-12 THEN avg(r) / stddev_pop(r) END AS sharpe FROM x GROUP BY 1, 2, 3)"""
_BS = ["win_rate", "mean_return", "sharpe"]


def barrier_results(spark, sf):
    trades, prices = trades_of(spark, sf)
    return W.barrier_sweep(materialize(trades), prices, _SL, _PTS)


@query(f"WITH {BARRIERS} SELECT horizon, sl_pct, pt_pct, n_trades, sl_exits, pt_exits, {sel(_BS)} FROM sweep")
def q_barrier_sweep(spark, sf):
    return barrier_results(spark, sf)


@query(f"""WITH {BARRIERS}, r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY sharpe DESC NULLS LAST, sl_pct, pt_pct) AS rank,
    row_number() OVER (PARTITION BY horizon ORDER BY CASE WHEN n_trades >= 30 THEN 0 ELSE 1 END, sharpe DESC NULLS LAST, sl_pct, pt_pct) AS b FROM sweep)
  SELECT horizon, CAST(rank AS INT) AS rank, sl_pct, pt_pct, n_trades, {rnd('sharpe')} AS sharpe, CAST(sl_pct = 0 AND pt_pct = 0 AS INT) AS baseline, CAST(b = 1 AS INT) AS best
  FROM r WHERE rank <= 3 OR b = 1 OR (sl_pct = 0 AND pt_pct = 0)""")
def q_best_config(spark, sf):
    return W.best_config(barrier_results(spark, sf)).select(
        "horizon", "rank", "sl_pct", "pt_pct", "n_trades", "sharpe", "baseline", "best"
    )


@query(f"""WITH {BARRIERS} SELECT horizon, {', '.join(f"{rnd(f'max(sharpe) FILTER (sl_pct = {s} AND pt_pct = 0.3)')} AS sl_{round(s * 100)}" for s in _SL)}
  FROM sweep GROUP BY horizon""")
def q_strategy_matrix(spark, sf):
    named = barrier_results(spark, sf).filter("pt_pct = 0.3").withColumn(
        "strategy", F.concat(F.lit("sl_"), F.round(F.col("sl_pct") * 100).cast("int"))
    )
    return W.strategy_matrix(named, [f"sl_{round(s * 100)}" for s in _SL])


_FR = [0.05, 0.1, 0.2]


@query(f"""WITH {TR}, f AS (SELECT unnest({_FR}::DOUBLE[]) AS fraction), z AS (SELECT horizon, fraction, fraction * 1000000.0::DOUBLE * return_pct AS pnl FROM t1, f),
  o AS (SELECT horizon, fraction, count(*) AS n_trades, avg(CAST(pnl > 0 AS INT)) AS win_rate, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor,
    sum(pnl) AS total_pnl, sum(pnl) / 1000000.0::DOUBLE AS return_on_capital FROM z GROUP BY 1, 2)
  SELECT horizon, fraction, n_trades, {sel(['win_rate', 'profit_factor', 'return_on_capital'], 5)}, {rnd('total_pnl', 2)} AS total_pnl FROM o""", digits=5, money=("total_pnl",))
def q_sizing_sweep(spark, sf):
    return W.sizing_sweep(trades_of(spark, sf)[0], _FR)


TICKER_EQ = f"{TR}, sized AS (SELECT *, ticker AS book, 100000.0::DOUBLE AS invested, 100000.0::DOUBLE * return_pct AS pnl FROM t1), {_EQ_TAIL.replace('horizon', 'book')}"


@query(f"""WITH {TICKER_EQ}, a AS ({_ENDS.replace('horizon', 'book')}), b AS ({_TM.replace('horizon', 'book')}),
  c AS (SELECT book, {_SH} AS sharpe, min(drawdown) AS max_drawdown FROM rets GROUP BY book)
  SELECT book AS ticker, n_trades, {sel(['total_return', 'sharpe', 'max_drawdown', 'win_rate'], 4)}, {rnd('final_equity', 2)} AS final_equity
  FROM a JOIN b USING (book) JOIN c USING (book)""", digits=4, money=("final_equity",))
def q_report_tables(spark, sf):
    """Every ticker on its own: independent trades at a tenth of the capital each."""
    trades, prices = trades_of(spark, sf)
    sized = materialize(R.position_budget(trades).withColumn("book", F.col("ticker")))
    per = P.metrics_report(R.book_equity(sized, prices, run=["book"]), sized, ["book"])
    return P.report_tables(per.withColumnRenamed("book", "ticker"), 8)


@query(f"WITH {S.PREDS}, {BEST} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, horizon, {sel(['mean', 'std'], 4)} FROM ranked WHERE rk <= 5 AND mean > {T}", digits=4)
def q_report_signals(spark, sf):
    return P.signal_table(G.threshold_signals(S.predictions(spark, sf), T), 8)


@query(f"WITH {EQ} SELECT horizon, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {rnd('equity', 2)} AS equity FROM equity", digits=2)
def q_report_equity(spark, sf):
    return P.equity_table(equity_of(spark, sf)[0], ["horizon"], 6)


# name -> (SQL rows, the number summed)
_ARTIFACTS = {
    "signals": ("buys", "mean"), "predictions": ("preds", "mean"), "prices": ("bars", "close"), "equity": ("equity", "equity"),
    "trades": ("sized", "pnl"), "per_ticker_metrics": ("per_ticker", "total_pnl"), "metrics": ("per_horizon", "total_pnl"),
}


@query(f"""WITH {EQ}, per_horizon AS ({_TM}), per_ticker AS ({_TM.replace('horizon', 'ticker')})
  {' UNION ALL '.join(f"SELECT '{n}' AS name, count(*) AS n, {rnd(f'sum({c})', 2)} AS total FROM {t}" for n, (t, c) in _ARTIFACTS.items())}""", digits=2)
def q_run_artifacts(spark, sf):
    """All tables of a run, saved and read back."""
    root, panel = landing(spark, "runs"), stored(spark, sf)
    predictions = S.predictions(spark, sf, panel=panel)
    signals = G.threshold_signals(predictions, T).filter("action = 'BUY'")
    sized = materialize(R.position_budget(R.trade_outcomes(signals, prices_of(panel))).withColumn("book", F.col("ticker")))
    equity = materialize(R.book_equity(sized, prices_of(panel), run=["horizon"]))
    alone = R.book_equity(sized, prices_of(panel), run=["book"])
    N.save_run(spark, root, "r1", {
        "signals": signals, "predictions": predictions, "prices": prices_of(panel), "equity": equity, "trades": sized,
        "per_ticker_metrics": P.metrics_report(alone, sized, ["book"]), "metrics": P.metrics_report(equity, sized, ["horizon"]),
    })
    out = None
    for name, (_, c) in _ARTIFACTS.items():
        part = N.load_run(spark, root, "r1", name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(c).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out
