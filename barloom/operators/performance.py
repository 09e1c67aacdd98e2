"""Performance metrics of equity curves and trades, grouped by run."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import hash_draw, or_zero
from barloom.operators.blocks import IDX, HaloBlocks, over_blocks, running
from barloom.operators.splits import time_index
from barloom.operators.trades import BAR_BLOCK, COST_PER_SIDE, INITIAL_CAPITAL, net_return, on_axis

C = F.col
TRADING_DAYS = 252.0
SIGMAS = 3.0


def _by_bar(df: DataFrame, run: Sequence[str]) -> DataFrame:
    from barloom.operators.blocks import index_rows

    return index_rows(df, run, "bar", bucket=F.floor(C("bar") / BAR_BLOCK))


def equity_returns(equity: DataFrame, run: Sequence[str] = (), **blocks) -> DataFrame:
    """Add ``ret``: change to the previous bar, 0 on the first."""

    def build(df: DataFrame, b: HaloBlocks) -> DataFrame:
        prev = F.lag("equity").over(b.window)
        return df.withColumn("ret", or_zero(C("equity") / prev - 1.0))

    return over_blocks(_by_bar(equity, run), build, back=1, key=tuple(run), **blocks).drop(IDX)


def drawdown(equity: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Add ``drawdown``: equity over its running maximum minus one."""
    top = running(
        equity, run, "bar", {"_top": ("max", "equity")}, bucket=F.floor(C("bar") / BAR_BLOCK)
    )
    return top.withColumn("drawdown", C("equity") / C("_top") - 1.0).drop("_top")


def sharpe_of(ret: str | Column, ppy: float = TRADING_DAYS, risk_free: float = 0.0) -> Column:
    """Annualised mean over population deviation; 0 for a flat series."""
    r = (C(ret) if isinstance(ret, str) else ret) - risk_free / ppy
    sd = F.stddev_pop(r)
    return F.when(sd > 1e-12, F.avg(r) / sd * math.sqrt(ppy)).otherwise(0.0)


def sharpe(returns: DataFrame, run: Sequence[str] = (), ppy: float = TRADING_DAYS, risk_free: float = 0.0) -> DataFrame:
    return returns.groupBy(*run).agg(sharpe_of("ret", ppy, risk_free).alias("sharpe"))


def win_rate_of(pnl: str = "pnl") -> Column:
    return F.coalesce(F.avg((C(pnl) > 0).cast("double")), F.lit(0.0))


def profit_factor_of(pnl: str = "pnl") -> Column:
    gains = or_zero(F.sum(F.when(C(pnl) > 0, C(pnl))))
    losses = or_zero(-F.sum(F.when(C(pnl) < 0, C(pnl))))
    endless = F.when(gains > 0, F.lit(float("inf"))).otherwise(0.0)
    return F.when(losses <= 1e-12, endless).otherwise(gains / losses)


def trade_sums(trades: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """What trade metrics are made of; sums of disjoint groups of trades add up."""
    return trades.groupBy(*run).agg(
        F.count("*").alias("n_trades"),
        F.count_if(C("pnl") > 0).alias("_wins"),
        or_zero(F.sum(F.when(C("pnl") > 0, C("pnl")))).alias("_gains"),
        or_zero(-F.sum(F.when(C("pnl") < 0, C("pnl")))).alias("_losses"),
    )


def metrics_of_sums(sums: DataFrame) -> DataFrame:
    endless = F.when(C("_gains") > 0, F.lit(float("inf"))).otherwise(0.0)
    return sums.withColumns(
        {
            "win_rate": F.when(C("n_trades") > 0, C("_wins") / C("n_trades")).otherwise(0.0),
            "profit_factor": F.when(C("_losses") <= 1e-12, endless).otherwise(C("_gains") / C("_losses")),
            "total_pnl": C("_gains") - C("_losses"),
        }
    ).drop("_wins", "_gains", "_losses")


def trade_metrics(trades: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    return trades.groupBy(*run).agg(
        F.count("*").alias("n_trades"),
        win_rate_of().alias("win_rate"),
        profit_factor_of().alias("profit_factor"),
        F.sum("pnl").alias("total_pnl"),
    )


def total_return(equity: DataFrame, run: Sequence[str] = (), ppy: float = TRADING_DAYS) -> DataFrame:
    """Total and annualised return and the last equity."""
    ends = equity.groupBy(*run).agg(
        F.count("*").alias("n_bars"),
        F.min_by("equity", "bar").alias("_first"),
        F.max_by("equity", "bar").alias("final_equity"),
    )
    growth = C("final_equity") / C("_first")
    return ends.withColumns(
        {
            "total_return": growth - 1.0,
            "annualized_return": F.when(
                C("n_bars") >= 2, F.pow(growth, F.lit(float(ppy)) / C("n_bars")) - 1.0
            ).otherwise(0.0),
        }
    ).drop("_first")


def metrics_report(
    equity: DataFrame, trades: DataFrame, run: Sequence[str] = (), ppy: float = TRADING_DAYS
) -> DataFrame:
    """All metrics, one row per run."""
    return report_of(equity, trade_metrics(trades, run), run, ppy)


def report_of(equity: DataFrame, deals: DataFrame, run: Sequence[str], ppy: float = TRADING_DAYS) -> DataFrame:
    """All metrics from equity curves and trade metrics."""
    run = list(run)
    curve = drawdown(equity_returns(equity, run), run).groupBy(*run).agg(
        sharpe_of("ret", ppy).alias("sharpe"), F.min("drawdown").alias("max_drawdown")
    )
    ends = total_return(equity, run, ppy)
    if run:
        out = curve.join(ends, run).join(deals, run, "left")
    else:
        out = curve.crossJoin(ends).crossJoin(deals)
    return out.na.fill(0, subset=["n_trades"]).na.fill(
        0.0, subset=["win_rate", "profit_factor", "total_pnl"]
    )


def exit_reasons(trades: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Counts per exit reason, one column each."""
    # Reasons a trade can end.
    reasons = ("horizon", "stop_loss", "profit_target")
    return trades.groupBy(*run).agg(
        *[F.count_if(C("exit_reason") == r).alias(r) for r in reasons]
    )


# --------------------------------------------------------------------------
# null distribution of random entries
# --------------------------------------------------------------------------

def random_entry_null(
    prices: DataFrame,
    *,
    n_agents: int = 100,
    rates: DataFrame | None = None,
    probability: float = 0.05,
    avg_horizon: int = 5,
    cost: float = COST_PER_SIDE,
    capital: float = INITIAL_CAPITAL,
    fraction: float = 0.10,
) -> DataFrame:
    """Final equity of agents that enter at random with the strategy's rate.

    At each bar an agent enters with ``probability`` one ticker, drawn evenly,
    at its close and leaves ``avg_horizon`` +- 2 bars later at a close.  Trades
    are independent and sized as a fixed fraction; draws are integer hashes of
    (agent, bar), so a rerun gives the same agents.  ``rates`` (one row of
    ``strategy_rates``) stands in for ``probability`` and ``avg_horizon``.
    """
    if rates is None:
        rates = prices.sparkSession.range(1).select(
            F.lit(probability).alias("probability"), F.lit(avg_horizon).alias("avg_horizon")
        )
    tickers = prices.select("ticker").distinct()
    numbered = _number(tickers)
    indexed = on_axis(prices.select("ts", "ticker", "close")).join(numbered, "ticker")
    axis = time_index(prices)
    last = axis.agg(F.max("bar").alias("_last")).crossJoin(
        tickers.agg(F.count("*").alias("_tickers"))
    )
    last = last.crossJoin(rates)
    lo = F.greatest(C("avg_horizon") - 2, F.lit(1))
    hi = F.greatest(C("avg_horizon") + 3, F.lit(2))
    draws = (
        axis.select("bar")
        .withColumn("agent", F.explode(F.sequence(F.lit(0), F.lit(n_agents - 1))))
        .crossJoin(F.broadcast(last))
        .filter(hash_draw(7, ("agent", 1103515245), ("bar", 12345)) < C("probability"))
        .withColumns(
            {
                "number": F.floor(
                    hash_draw(11, ("agent", 69069), ("bar", 1664525)) * C("_tickers")
                ),
                "hold": lo
                + F.floor(hash_draw(13, ("agent", 22695477), ("bar", 1013904)) * (hi - lo)),
            }
        )
        .filter(C("bar") + C("hold") <= C("_last"))
    )
    entry = indexed.select("number", "bar", C("close").alias("entry_price")).filter(C("entry_price") > 0)
    exit_ = indexed.select(
        "number", (C("bar")).alias("exit_bar"), C("close").alias("exit_price")
    )
    trades = (
        draws.join(entry, ["number", "bar"])
        .withColumn("exit_bar", C("bar") + C("hold"))
        .join(exit_, ["number", "exit_bar"], "left")
        .withColumn("exit_price", F.coalesce("exit_price", "entry_price"))
    )
    gained = trades.groupBy("agent").agg(
        F.count("*").alias("n_trades"), F.sum(net_return(cost) * fraction * capital).alias("_pnl")
    )
    agents = prices.sparkSession.range(n_agents).select(C("id").cast("int").alias("agent"))
    return agents.join(gained, "agent", "left").select(
        "agent",
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        (F.lit(capital) + or_zero("_pnl")).alias("final_equity"),
    )


def strategy_rates(
    signals: DataFrame, trades: DataFrame, prices: DataFrame, max_positions: int = 5
) -> DataFrame:
    """One row: entries per bar and slot (``probability``) and mean holding time
    (``avg_horizon``) of a strategy, for agents that trade as often and as long."""
    n = signals.agg(F.count_if(C("action") == "BUY").alias("_buys"))
    bars = prices.agg(F.countDistinct("ts").alias("_bars"))
    held = trades.agg(F.coalesce(F.rint(F.avg("horizon")), F.lit(5.0)).cast("int").alias("avg_horizon"))
    rate = F.greatest(F.least(C("_buys") / (C("_bars") * max_positions), F.lit(1.0)), F.lit(1e-4))
    return n.crossJoin(bars).crossJoin(held).select(
        F.when(C("_buys") > 0, rate).otherwise(0.05).alias("probability"), "avg_horizon"
    )


def _number(tickers: DataFrame) -> DataFrame:
    from barloom.operators.blocks import index_rows

    return index_rows(tickers, (), "ticker", bucket=F.substring("ticker", 1, 3), name="number")


def three_sigma_test(
    agents: DataFrame, strategy_final: float | DataFrame, sigmas: float = SIGMAS
) -> DataFrame:
    """Is the strategy's final equity beyond mean + 3 deviations of the agents?"""
    stats = agents.agg(
        F.avg("final_equity").alias("null_mean"), F.stddev_pop("final_equity").alias("null_std")
    )
    if isinstance(strategy_final, DataFrame):
        stats = stats.crossJoin(strategy_final.select(C("final_equity").alias("strategy_final")))
    else:
        stats = stats.withColumn("strategy_final", F.lit(float(strategy_final)))
    return stats.withColumns(
        {
            "threshold": C("null_mean") + sigmas * C("null_std"),
            "z_score": F.when(
                C("null_std") > 1e-9, (C("strategy_final") - C("null_mean")) / C("null_std")
            ).otherwise(0.0),
        }
    ).withColumn("significant", C("strategy_final") >= C("threshold"))


def histogram(df: DataFrame, value: str, bins: int = 40, scale: float = 1.0) -> DataFrame:
    """Equal-width bins between the observed minimum and maximum."""
    x = (C(value) * scale).alias("_x")
    known = df.filter(C(value).isNotNull()).select(x)
    span = known.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (C("_hi") - C("_lo")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor((C("_x") - C("_lo")) / width).cast("int"))
    return (
        known.crossJoin(F.broadcast(span))
        .groupBy(F.coalesce(bin_, F.lit(0)).alias("bin"), "_lo", "_hi")
        .agg(F.count("*").alias("n"))
        .select("bin", "n", (C("_lo") + C("bin") * width).alias("left_edge"))
    )


def report_tables(per_ticker: DataFrame, digits: int = 4) -> DataFrame:
    """Per-ticker results sorted for a report, rounded."""
    return per_ticker.select(
        "ticker",
        "n_trades",
        *[
            F.round(c, digits).alias(c)
            for c in ("total_return", "sharpe", "max_drawdown", "win_rate", "final_equity")
        ],
    ).orderBy("total_return")


def signal_table(signals: DataFrame, digits: int = 4) -> DataFrame:
    """Bought signals in time order, numbers rounded."""
    numbers = [F.round(c, digits).alias(c) for c in ("mean", "std")]
    return signals.filter(C("action") == "BUY").select("ts", "ticker", "horizon", *numbers).orderBy(
        "ts", "ticker", "horizon"
    )


def equity_table(equity: DataFrame, run: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Equity curves in time order, rounded."""
    return equity.select(*run, "ts", F.round("equity", digits).alias("equity")).orderBy(*run, "ts")
