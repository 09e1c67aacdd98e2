"""Trades of signals: entries, exits, barriers, books and equity, set-based.

A signal at bar t enters at the open of bar t+1 and leaves at the open of bar
t+1+h on the shared bar axis; a series without a bar there leaves at its next
bar.  Cash and slots shared between tickers are not simulated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import or_zero
from barloom.operators.asof import asof
from barloom.operators.blocks import running
from barloom.operators.splits import time_index
from barloom.session import materialize

C = F.col
BAR_BLOCK = 4096
MARK_BLOCK = 64  #: bars whose closes of a ticker meet a trade as one row

# Costs per side and starting capital.
COST_PER_SIDE = 0.0005
INITIAL_CAPITAL = 1_000_000.0


def on_axis(prices: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``bar``, the position of the time on the axis shared by all tickers."""
    return prices.join(time_index(prices, ts), ts)


def _bucket() -> Column:
    return F.floor(C("bar") / BAR_BLOCK)


def trade_outcomes(
    signals: DataFrame,
    prices: DataFrame,
    *,
    cost: float = COST_PER_SIDE,
    stop_loss: float = 0.0,
    profit_target: float = 0.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per executable BUY: entry, exit, reason, return after costs.

    ``prices``: ts, ticker, open and optionally high, low.  ``keep`` names
    signal columns to carry.  Signals whose exit bar lies beyond the axis, or
    without an entry price, give no trade.  ``return_pct`` is the profit over
    the money invested, fees of both sides included.
    """
    indexed = on_axis(prices)
    last_bar = indexed.agg(F.max("bar").alias("_last"))
    axis = indexed.select("ts", "bar").distinct()
    buys = (
        signals.filter(C("action") == "BUY")
        .select("ts", "ticker", "horizon", "mean", *keep)
        .join(F.broadcast(axis), "ts")
        .crossJoin(F.broadcast(last_bar))
        .filter(C("bar") + 1 + C("horizon") <= C("_last"))
        .withColumnRenamed("ts", "signal_ts")
        .withColumns({"entry_bar": C("bar") + 1, "due_bar": C("bar") + 1 + C("horizon")})
        .drop("bar")
    )
    entry = indexed.select(
        "ticker", C("bar").alias("entry_bar"), C("ts").alias("open_ts"), C("open").alias("entry_price")
    ).filter(C("entry_price") > 0)
    opened = materialize(buys.join(entry, ["ticker", "entry_bar"]))
    # leaving: the first bar of the ticker at or after the due bar
    quotes = indexed.select(
        "ticker", "bar", C("bar").alias("exit_bar"), C("ts").alias("close_ts"), C("open").alias("exit_price")
    )
    due = opened.select("ticker", C("due_bar").alias("bar")).distinct()
    leave = asof(
        due, quotes, key=("ticker",), ts="bar", direction="forward", bucket=_bucket(),
        values=["exit_bar", "close_ts", "exit_price"],
    ).withColumnRenamed("bar", "due_bar")
    never = C("exit_bar").isNull()
    trades = (
        opened.join(leave, ["ticker", "due_bar"])
        .withColumns(
            {
                "exit_price": F.coalesce("exit_price", "entry_price"),
                "exit_bar": F.when(never, C("_last")).otherwise(C("exit_bar")),
                "exit_reason": F.lit("horizon"),
            }
        )
        .drop("_last")
    )
    ends = axis.select(C("bar").alias("exit_bar"), C("ts").alias("_end_ts"))
    trades = (
        trades.join(F.broadcast(ends), "exit_bar")
        .withColumn("close_ts", F.coalesce("close_ts", "_end_ts"))
        .drop("_end_ts")
    )
    if (stop_loss > 0 or profit_target > 0) and {"high", "low"} <= set(prices.columns):
        trades = barrier_exit(materialize(trades), indexed, stop_loss, profit_target)
    return trades.withColumn("return_pct", net_return(cost)).drop("due_bar")


def net_return(cost: float) -> Column:
    """Profit over invested money: fees at entry on the money, at exit on the value."""
    return (1.0 - cost) * C("exit_price") / C("entry_price") * (1.0 - cost) - 1.0


def barrier_exit(
    trades: DataFrame, indexed: DataFrame, stop_loss: float, profit_target: float
) -> DataFrame:
    """Replace the exit by the first touch of a stop or target, stop first.

    Bars ``entry+1 .. due`` and the actual exit bar are tested: each trade is
    expanded to its few bars and met with the prices by equality.
    """
    steps = F.array_distinct(
        F.concat(
            F.sequence(C("entry_bar") + 1, C("due_bar")),
            F.array(C("exit_bar")),
        )
    )
    tid = ["ticker", "entry_bar", "horizon"]
    seen = trades.select(*tid, "entry_price", F.explode(steps).alias("bar"))
    quotes = indexed.select("ticker", "bar", C("ts").alias("_hit_ts"), "high", "low")
    stop, target = C("entry_price") * (1.0 - stop_loss), C("entry_price") * (1.0 + profit_target)
    stopped = (C("low") <= stop) if stop_loss > 0 else F.lit(False)
    reached = (C("high") >= target) if profit_target > 0 else F.lit(False)
    first = (
        seen.join(quotes, ["ticker", "bar"])
        .withColumn("_why", F.when(stopped, "stop_loss").when(reached, "profit_target"))
        .filter(C("_why").isNotNull())
        .groupBy(*tid)
        .agg(
            F.min("bar").alias("_hit_bar"),
            F.min_by("_why", "bar").alias("_why"),
            F.min_by("_hit_ts", "bar").alias("_hit_ts"),
        )
    )
    hit = C("_hit_bar").isNotNull()
    return (
        trades.join(first, tid, "left")
        .withColumns(
            {
                "exit_price": F.when(C("_why") == "stop_loss", stop)
                .when(C("_why") == "profit_target", target)
                .otherwise(C("exit_price")),
                "exit_bar": F.coalesce("_hit_bar", "exit_bar"),
                "close_ts": F.when(hit, C("_hit_ts")).otherwise(C("close_ts")),
                "exit_reason": F.coalesce("_why", "exit_reason"),
            }
        )
        .drop("_hit_bar", "_why", "_hit_ts")
    )


def position_budget(
    trades: DataFrame,
    *,
    mode: str = "fixed_frac",
    capital: float = INITIAL_CAPITAL,
    fraction: float = 0.10,
    cap: float = 1.0,
) -> DataFrame:
    """Add ``invested`` and ``pnl``: a fixed share of capital or the signal's own."""
    if mode == "fixed_frac":
        share = F.lit(fraction)
    elif mode == "signal_kelly":
        own = C("size_fraction").cast("double") if "size_fraction" in trades.columns else F.lit(None)
        share = F.coalesce(own, F.lit(fraction))
    else:
        raise ValueError(f"no such way to size positions: {mode!r}")
    invested = F.least(share * capital, F.lit(cap * capital))
    return trades.withColumn("invested", invested).filter(C("invested") > 0).withColumn(
        "pnl", C("invested") * C("return_pct")
    )


def signal_exit_pairs(
    decisions: DataFrame, prices: DataFrame, *, max_hold: int = 48, cost: float = COST_PER_SIDE,
    keep: Sequence[str] = (), runs: str | None = None,
) -> DataFrame:
    """Each open decision with its exit: the first close decision at or after the
    entry bar, or ``max_hold`` bars, leaving at the next open.

    Every open decision is treated on its own; no slot or cash limits.  An exit lies
    within ``max_hold`` bars, so a decision looks no further, in blocks of bars.
    With ``runs``, ``open_long`` and ``close_long`` are bit sets of runs that share
    their rows: a decision gives one row per exit, ``runs`` is the set that leaves there.
    """
    indexed = on_axis(prices)
    axis = indexed.select("ts", "bar").distinct()
    last_bar = indexed.agg(F.max("bar").alias("_last"))
    carried = [c for c in ("p_long",) if c in decisions.columns]
    # one row a time: signals stay where they are
    dec = decisions.join(F.broadcast(axis), "ts").select(
        "ticker", "bar", C("ts").alias("signal_ts"), *carried, *keep,
        *[F.coalesce(C(c).cast("bigint"), F.lit(0)).alias(c) for c in ("open_long", "close_long")],
    ).filter((C("open_long") != 0) | (C("close_long") != 0))
    # rows within reach of an earlier block are copied to it
    size, reach = max(BAR_BLOCK, max_hold + 1), max(max_hold, 0) + 1
    blocks = F.array_distinct(F.array(F.floor(C("bar") / size), F.floor((C("bar") - reach) / size)))
    ahead = Window.partitionBy("ticker", *keep, "_blk").orderBy("bar").rangeBetween(1, reach)
    later = F.collect_list(F.when(C("close_long") != 0, F.struct("bar", C("close_long").alias("set")))).over(ahead)
    opens = (
        dec.withColumn("_blk", F.explode(blocks))
        .withColumn("_later", later)
        .filter((C("open_long") != 0) & (C("_blk") == F.floor(C("bar") / size)))
        .withColumn("entry_bar", C("bar") + 1)
        .select("ticker", "signal_ts", "entry_bar", *carried, *keep, "open_long", "_later")
    )
    # the sets that leave at each later close decision, in order of the bars; the others leave at the last bar
    due = C("entry_bar") + max_hold
    none = F.array().cast("array<struct<stop:bigint,set:bigint,reason:string>>")

    def leaving(held: Column, x: Column) -> Column:
        out = held["left"].bitwiseAND(x["set"])
        mine = F.array(F.struct(x["bar"].alias("stop"), out.alias("set"), F.lit("signal").alias("reason")))
        gone = (out != 0) & (x["bar"] <= due)
        return F.struct(
            F.when(gone, held["left"] - out).otherwise(held["left"]).alias("left"),
            F.when(gone, F.concat(held["done"], mine)).otherwise(held["done"]).alias("done"),
        )

    def ended(held: Column) -> Column:
        rest = F.array(F.struct(due.alias("stop"), held["left"].alias("set"), F.lit("max_hold").alias("reason")))
        return F.when(held["left"] != 0, F.concat(held["done"], rest)).otherwise(held["done"])

    begun = F.struct(C("open_long").alias("left"), none.alias("done"))
    exits = F.aggregate(F.array_sort("_later"), begun, leaving, ended)
    entry = indexed.select(
        "ticker", C("bar").alias("entry_bar"), C("ts").alias("open_ts"), C("open").alias("entry_price")
    ).filter(C("entry_price") > 0)
    paired = (
        opens.join(entry, ["ticker", "entry_bar"])
        .crossJoin(F.broadcast(last_bar))
        .withColumn("_exit", F.explode(exits))
        .withColumns({"_stop": C("_exit.stop"), "exit_reason": C("_exit.reason"), "horizon": C("_exit.stop") - C("entry_bar")})
    )
    if runs:
        paired = paired.withColumn(runs, C("_exit.set"))
    paired = materialize(paired.drop("_exit", "_later", "open_long"))
    quotes = indexed.select(
        "ticker", "bar", C("bar").alias("exit_bar"), C("ts").alias("close_ts"), C("open").alias("exit_price")
    )
    due_bars = paired.select("ticker", (C("_stop") + 1).alias("bar")).distinct()
    leave = asof(
        due_bars, quotes, key=("ticker",), ts="bar", direction="forward", bucket=_bucket(),
        values=["exit_bar", "close_ts", "exit_price"],
    ).select("ticker", (C("bar") - 1).alias("_stop"), "exit_bar", "close_ts", "exit_price")
    out = paired.join(leave, ["ticker", "_stop"]).withColumns(
        {
            "exit_price": F.coalesce("exit_price", "entry_price"),
            "exit_bar": F.coalesce("exit_bar", "_last"),
        }
    )
    return out.withColumn("return_pct", net_return(cost)).drop("_stop", "_last")


# --------------------------------------------------------------------------
# one book per series
# --------------------------------------------------------------------------

def per_series_book(
    trades: DataFrame, *, capital: float = INITIAL_CAPITAL, fraction: float = 0.10,
    key: Sequence[str] = ("ticker",),
) -> DataFrame:
    """Independent books: capital split evenly over the series, a fixed share of it in every trade.

    Adds ``invested``, ``pnl`` and ``cash``, the book's cash when the trade is closed (all trades
    of its series that left by that bar are in it).
    """
    own = F.lit(capital) / C("_n")
    n = trades.select(*key).distinct().agg(F.count("*").alias("_n"))
    sized = trades.crossJoin(F.broadcast(n)).withColumn("invested", own * fraction)
    sized = sized.withColumn("pnl", C("invested") * C("return_pct"))
    closed = sized.groupBy(*key, "exit_bar", "_n").agg(F.sum("pnl").alias("_pnl"))
    summed = running(closed, key, "exit_bar", {"_sum": ("sum", "_pnl")}, bucket=F.floor(C("exit_bar") / BAR_BLOCK))
    cash = summed.select(*key, "exit_bar", (own + C("_sum")).alias("cash"))
    return sized.drop("_n").join(cash, [*key, "exit_bar"])


# --------------------------------------------------------------------------
# equity
# --------------------------------------------------------------------------

def book_equity(
    trades: DataFrame, prices: DataFrame, *, run: Sequence[str] = (),
    capital: float = INITIAL_CAPITAL, cost: float = COST_PER_SIDE,
) -> DataFrame:
    """Equity per bar: capital + realised profit + open positions at the close.

    ``trades`` need ``invested`` and ``pnl``.  Cash is not limited, which is
    exact while positions are a fixed fraction and limits do not bind.
    Positions are open on bars ``entry-1 .. exit-1``: the money leaves at the
    signal bar.  A bar without a price of the ticker keeps the entry price.
    """
    axis, marked, realised = book_marks(trades, prices, run=run, cost=cost)
    runs = trades.select(*run).distinct() if run else None
    return equity_of_marks(axis, marked, realised, run=run, runs=runs, capital=capital)


def book_marks(
    trades: DataFrame, prices: DataFrame, *, run: Sequence[str] = (), cost: float = COST_PER_SIDE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bar axis, and per run and bar the open profit (``_open``) and the realised one (``_pnl``)."""
    indexed = on_axis(prices)
    axis = indexed.select("ts", "bar").distinct()
    quantity = C("invested") * (1.0 - cost) / C("entry_price")
    # a trade meets the closes of a block of bars in one row; its bars are made after the join and
    # summed at once, so they are never shuffled
    block = F.floor(C("bar") / MARK_BLOCK).alias("_blk")
    at = F.map_from_entries(F.collect_list(F.struct(C("bar") - F.floor(C("bar") / MARK_BLOCK) * MARK_BLOCK, "close")))
    closes = indexed.select("ticker", "bar", "close").groupBy("ticker", block).agg(at.alias("_at")).select(
        "ticker", "_blk",
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(MARK_BLOCK - 1).cast("bigint")), lambda i: F.try_element_at("_at", i)).alias("_closes"),
    )
    first, last = C("entry_bar") - 1, C("exit_bar") - 1
    spans = trades.select(
        *run, "ticker", "entry_price", "invested", quantity.alias("_q"), first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(F.floor(first / MARK_BLOCK), F.floor(last / MARK_BLOCK))).alias("_blk"),
    )
    start = C("_blk") * MARK_BLOCK
    bars = F.sequence(F.greatest("_first", start), F.least("_last", start + (MARK_BLOCK - 1)))
    marked = (
        spans.join(closes, ["ticker", "_blk"], "left")
        .select(*run, "entry_price", "invested", "_q", "_closes", start.alias("_start"), F.explode(bars).alias("bar"))
        .withColumn("close", F.get("_closes", (C("bar") - C("_start")).cast("int")))
        .groupBy(*run, "bar")
        .agg(F.sum(C("_q") * F.coalesce("close", "entry_price") - C("invested")).alias("_open"))
    )
    realised = trades.groupBy(*run, C("exit_bar").alias("bar")).agg(F.sum("pnl").alias("_pnl"))
    return axis, marked, realised


def equity_of_marks(
    axis: DataFrame, marked: DataFrame, realised: DataFrame, *, run: Sequence[str] = (),
    runs: DataFrame | None = None, capital: float = INITIAL_CAPITAL,
) -> DataFrame:
    """Equity of every run on every bar of the axis."""
    # the result itself: every run has a value on every bar
    grid = axis if runs is None else axis.crossJoin(runs)
    both = grid.join(marked, [*run, "bar"], "left").join(realised, [*run, "bar"], "left")
    both = both.withColumn("_pnl", or_zero("_pnl"))
    summed = running(
        both, run, "bar", {"_real": ("sum", "_pnl")}, bucket=_bucket()
    )
    return summed.select(
        *run, "ts", "bar", (F.lit(capital) + C("_real") + or_zero("_open")).alias("equity")
    )
