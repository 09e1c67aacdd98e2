"""Parameter sweeps: the grid becomes a run key, the expensive part runs once.

Trades are computed once for the loosest setting; a stricter setting is a
subset or a cheap rewrite of them, so only trades are multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.performance import (
    TRADING_DAYS, metrics_of_sums, metrics_report, report_of, trade_metrics, trade_sums,
)
from barloom.operators.predictions import KEY3
from barloom.operators.ranks import quantiles
from barloom.operators.signals import best_horizon, top_k
from barloom.operators.trades import (
    COST_PER_SIDE, INITIAL_CAPITAL, book_equity, book_marks, equity_of_marks, net_return, on_axis,
    position_budget, signal_exit_pairs, trade_outcomes,
)
from barloom.session import materialize

C = F.col

# The reported grids.
SWEEP_THRESHOLDS = (0.51, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
CONSENSUS_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
RELAX_PRIMARY = (0.45, 0.50, 0.55)
RELAX_META = (10.0, 20.0, 30.0, 50.0)
WORD = 62  #: settings in one bit set


def _values(xs: Sequence[float], name: str) -> Column:
    return F.explode(F.array(*[F.lit(float(x)) for x in xs])).alias(name)


def candidate_trades(
    predictions: DataFrame, prices: DataFrame, k: int = 5, cost: float = COST_PER_SIDE
) -> DataFrame:
    """Trades of every top-k best-horizon prediction: the superset of a sweep."""
    signals = top_k(best_horizon(predictions), k).withColumn("action", F.lit("BUY"))
    return trade_outcomes(signals, prices, cost=cost)


def threshold_sweep(
    predictions: DataFrame,
    prices: DataFrame,
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    *,
    k: int = 5,
    fraction: float = 0.10,
    capital: float = INITIAL_CAPITAL,
    cost: float = COST_PER_SIDE,
    ppy: float = TRADING_DAYS,
    null: DataFrame | None = None,
) -> DataFrame:
    """One row per threshold: signals, trades, metrics and, with ``null`` (agents'
    final equities), the z-score.  Being in the top-k does not depend on the
    threshold, so each setting is a subset of the candidate trades."""
    levels = sorted(float(t) for t in thresholds)
    prices = materialize(prices)
    passed = sum((C("mean") > t).cast("int") for t in levels)
    # a row is counted once, in the bin of the thresholds it passes; bins add up to the settings
    cand = materialize(top_k(best_horizon(predictions), k).withColumn("_bin", passed))
    buys = cand.filter(C("_bin") > 0).withColumn("action", F.lit("BUY"))
    trades = position_budget(
        trade_outcomes(buys, prices, cost=cost, keep=["_bin"]), capital=capital, fraction=fraction
    )
    trades = materialize(trades)

    def added(binned: DataFrame, *by: str) -> DataFrame:
        mine = F.slice(F.array(*[F.lit(t) for t in levels]), F.lit(1), C("_bin"))
        sums = [F.sum(c).alias(c) for c in binned.columns if c not in (*by, "_bin")]
        return binned.withColumn("threshold", F.explode(mine)).groupBy("threshold", *by).agg(*sums)

    axis, marked, realised = book_marks(trades, prices, run=["_bin"], cost=cost)
    grid = cand.sparkSession.createDataFrame([(t,) for t in levels], "threshold double")
    n_buy = grid.join(
        added(cand.groupBy("_bin").agg(F.count("*").alias("n_buy_signals"))), "threshold", "left"
    ).na.fill(0)
    deals = metrics_of_sums(added(trade_sums(trades, ["_bin"])))
    equity = equity_of_marks(
        axis, added(marked, "bar"), added(realised, "bar"), run=["threshold"],
        runs=deals.select("threshold"), capital=capital,
    )
    report = report_of(equity, deals, ["threshold"], ppy)
    out = n_buy.join(report, "threshold", "left").select(
        "threshold",
        "n_buy_signals",
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        F.coalesce("final_equity", F.lit(float(capital))).alias("final_equity"),
        *[
            F.coalesce(c, F.lit(0.0)).alias(c)
            for c in ("total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor")
        ],
    )
    if null is None:
        return out
    stats = null.agg(F.avg("final_equity").alias("_m"), F.stddev_pop("final_equity").alias("_s"))
    z = F.when(
        (C("n_buy_signals") > 0) & (C("_s") > 0), (C("final_equity") - C("_m")) / C("_s")
    ).otherwise(0.0)
    return out.crossJoin(F.broadcast(stats)).withColumn("z_score", z).withColumn(
        "significant", C("z_score") >= 3.0
    ).drop("_m", "_s")


def consensus_sweep(
    frame: DataFrame,
    prices: DataFrame,
    t_long: Sequence[float] = CONSENSUS_GRID,
    t_short: Sequence[float] = CONSENSUS_GRID,
    *,
    max_hold: int = 48,
    cost: float = COST_PER_SIDE,
    fraction: float = 0.10,
    capital: float = INITIAL_CAPITAL,
    ppy: float = TRADING_DAYS,
) -> DataFrame:
    """Signals, trades and equity metrics of every pair of consensus thresholds.

    A pair without trades keeps its row: the starting capital and zeros.
    """
    for v in (*t_long, *t_short):
        if not 0.0 < v < 1.0:
            raise ValueError(f"a consensus threshold lies between 0 and 1, not at {v}")
    longs, shorts = (sorted({float(t) for t in ts}) for ts in (t_long, t_short))
    run = ["t_long", "t_short"]
    prices = materialize(prices)
    # a row is stored once, by the levels it passes on either side; the pairs it opens or closes are a bit set
    places = [(a, b) for a in range(len(longs)) for b in range(len(shorts))]
    words = [places[i : i + WORD] for i in range(0, len(places), WORD)]
    word = F.explode(F.sequence(F.lit(0), F.lit(len(words) - 1))).alias("_word")

    def passed(x: str, levels: list[float]) -> Column:
        return sum((C(x) > t).cast("int") for t in levels)

    def pairs_where(holds) -> Column:
        """The bit set of the row's word of pairs (a, b) for which ``holds(levels passed, a, b)``."""
        cells = [
            F.lit(sum(1 << k for k, (a, b) in enumerate(w) if holds(i, j, a, b))).cast("bigint")
            for w in words for i in range(len(longs) + 1) for j in range(len(shorts) + 1)
        ]
        at = (C("_word") * (len(longs) + 1) + C("_i")) * (len(shorts) + 1) + C("_j")
        return F.get(F.array(*cells), at)

    sides = {
        "open_long": pairs_where(lambda i, j, a, b: a < i and not b < j),
        "close_long": pairs_where(lambda i, j, a, b: b < j and not a < i),
    }
    seen = frame.filter(C("p_long").isNotNull() & C("p_short").isNotNull())
    seen = seen.select("ts", "ticker", passed("p_long", longs).alias("_i"), passed("p_short", shorts).alias("_j"))
    # a row acts in a pair that one of its sides passes and the other does not
    acts = ((C("_i") > 0) & (C("_j") < len(shorts))) | ((C("_j") > 0) & (C("_i") < len(longs)))
    seen = materialize(seen.filter(acts))

    spelt = F.array(*[
        F.array(*[F.struct(F.lit(longs[a]).alias("t_long"), F.lit(shorts[b]).alias("t_short")) for a, b in w])
        for w in words
    ])

    def pairs_in(x: str) -> Column:
        """The pairs of a bit set."""
        word_pairs = F.get(spelt, C("_word"))
        return F.filter(word_pairs, lambda _, k: F.getbit(C(x), k) == 1)

    def added(binned: DataFrame, *by: str, of: str = "_runs") -> DataFrame:
        sums = [F.sum(c).alias(c) for c in binned.columns if c not in (*by, of, "_word")]
        each = binned.withColumn("_pair", F.explode(pairs_in(of)))
        return each.select("*", "_pair.*").groupBy(*run, *by).agg(*sums)

    pairs = signal_exit_pairs(
        seen.select("*", word).withColumns(sides), prices, max_hold=max_hold, cost=cost, keep=["_word"], runs="_runs"
    )
    sized = materialize(position_budget(pairs, capital=capital, fraction=fraction))
    bins = materialize(seen.groupBy("_i", "_j").count()).select("*", word).withColumns(sides)
    counts = None
    for side, n in (("open_long", "n_open_signals"), ("close_long", "n_close_signals")):
        part = added(bins.select("_word", side, C("count").alias(n)), of=side)
        counts = part if counts is None else counts.join(part, run, "full")
    deals = metrics_of_sums(added(trade_sums(sized, ["_word", "_runs"])))
    axis, marked, realised = book_marks(sized, prices, run=["_word", "_runs"], cost=cost)
    equity = equity_of_marks(
        axis, added(marked, "bar"), added(realised, "bar"), run=run, runs=deals.select(*run), capital=capital
    )
    report = report_of(equity, deals, run, ppy)
    every = frame.sparkSession.range(1).select(_values(longs, "t_long")).select("*", _values(shorts, "t_short"))
    found = every.join(counts, run, "left").join(report, run, "left")
    return found.select(
        *run,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_open_signals", "n_close_signals", "n_trades")],
        F.coalesce("final_equity", F.lit(float(capital))).alias("final_equity"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_return", "sharpe", "max_drawdown", "win_rate")],
    )


def relaxation_sweep(
    primary: DataFrame, meta: DataFrame, prices: DataFrame, primary_levels: Sequence[float] = RELAX_PRIMARY,
    meta_percents: Sequence[float] = RELAX_META, *, min_buys: int = 5, fraction: float = 0.10,
    capital: float = INITIAL_CAPITAL, cost: float = COST_PER_SIDE, ppy: float = TRADING_DAYS,
) -> DataFrame:
    """Looser joint thresholds: a primary level with the top percent of the meta scores.

    One row per pair with at least ``min_buys`` signals: the meta level, signals,
    trades, Sharpe and return.
    """
    run, bins = ["t_primary", "meta_percent"], ["_i", "_m"]
    levels = sorted({float(t) for t in primary_levels})
    prices = materialize(prices)
    both = primary.select(*KEY3, "mean").join(meta.select(*KEY3, C("mean").alias("meta")), list(KEY3))
    both = materialize(both)
    cuts = quantiles(both, [], "meta", [1.0 - p / 100.0 for p in meta_percents]).select(
        C("quantile").alias("t_meta"), F.round(100.0 * (1.0 - C("q")), 6).alias("meta_percent")
    )
    # one row: the cuts from the lowest on
    cuts = F.broadcast(materialize(cuts.agg(F.array_sort(F.collect_list(F.struct("t_meta", "meta_percent"))).alias("_cuts"))))
    # a row is stored once, by the number of levels and cuts it passes; its trade is the same in every pair
    passed = {
        "_i": sum((C("mean") > t).cast("int") for t in levels),
        "_m": F.size(F.filter("_cuts", lambda x: C("meta") > x["t_meta"])),
    }
    fits = both.crossJoin(cuts).withColumns(passed).filter((C("_i") > 0) & (C("_m") > 0))
    fits = materialize(fits.select(*KEY3, "mean", *bins, F.lit("BUY").alias("action")))

    def added(binned: DataFrame, *by: str) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in binned.columns if c not in (*by, *bins)]
        mine = F.slice(F.array(*[F.lit(t) for t in levels]), F.lit(1), C("_i"))
        each = binned.crossJoin(cuts).withColumn("t_primary", F.explode(mine))
        each = each.withColumn("_cut", F.explode(F.slice("_cuts", F.lit(1), C("_m"))))
        return each.select("*", "_cut.*").groupBy(*run, "t_meta", *by).agg(*sums)

    counts = added(fits.groupBy(*bins).agg(F.count("*").alias("n_buy"))).filter(C("n_buy") >= min_buys)
    trades = trade_outcomes(fits, prices, cost=cost, keep=bins)
    sized = materialize(position_budget(trades, capital=capital, fraction=fraction))
    deals = metrics_of_sums(added(trade_sums(sized, bins)).drop("t_meta"))
    axis, marked, realised = book_marks(sized, prices, run=bins, cost=cost)
    equity = equity_of_marks(
        axis, added(marked, "bar").drop("t_meta"), added(realised, "bar").drop("t_meta"), run=run,
        runs=deals.select(*run), capital=capital,
    )
    report = report_of(equity, deals, run, ppy)
    return counts.join(report, run, "left").select(
        *run, "t_meta", "n_buy", F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sharpe", "total_return")],
    )


def barrier_sweep(
    trades: DataFrame,
    prices: DataFrame,
    stops: Sequence[float],
    targets: Sequence[float],
    *,
    cost: float = COST_PER_SIDE,
) -> DataFrame:
    """Every (stop, target) pair per horizon.

    The path of a trade is read once and reduced to the first touch of each stop
    and of each target level; pairs are combined afterwards, stop first.
    """
    indexed = on_axis(prices).select("ticker", "bar", "high", "low")
    tid = ["ticker", "entry_bar", "horizon"]
    due = C("entry_bar") + C("horizon")
    steps = F.array_distinct(
        F.concat(F.sequence(C("entry_bar") + 1, due), F.array(C("exit_bar")))
    )
    path = trades.select(*tid, "entry_price", F.explode(steps).alias("bar")).join(
        indexed, ["ticker", "bar"]
    )
    touch = {}
    for i, s in enumerate(stops):
        touch[f"_s{i}"] = F.min(F.when(C("low") <= C("entry_price") * (1.0 - s), C("bar"))) if s > 0 else F.lit(None).cast("bigint")
    for i, t in enumerate(targets):
        touch[f"_t{i}"] = F.min(F.when(C("high") >= C("entry_price") * (1.0 + t), C("bar"))) if t > 0 else F.lit(None).cast("bigint")
    first = path.groupBy(*tid).agg(*[c.alias(n) for n, c in touch.items()])
    s_levels = F.array(*[F.struct(F.lit(float(s)).alias("sl"), C(f"_s{i}").alias("s_bar")) for i, s in enumerate(stops)])
    t_levels = F.array(*[F.struct(F.lit(float(t)).alias("pt"), C(f"_t{i}").alias("t_bar")) for i, t in enumerate(targets)])
    runs = (
        trades.select(*tid, "entry_price", "exit_price")
        .join(first, tid, "left")
        .withColumn("_s", F.explode(s_levels))
        .withColumn("_t", F.explode(t_levels))
        .select(*tid, "entry_price", "exit_price", "_s.*", "_t.*")
    )
    stopped = C("s_bar").isNotNull() & (C("t_bar").isNull() | (C("s_bar") <= C("t_bar")))
    reached = ~stopped & C("t_bar").isNotNull()
    runs = runs.withColumn(
        "exit_price",
        F.when(stopped, C("entry_price") * (1.0 - C("sl")))
        .when(reached, C("entry_price") * (1.0 + C("pt")))
        .otherwise(C("exit_price")),
    ).withColumn("return_pct", net_return(cost))
    return runs.groupBy("horizon", C("sl").alias("sl_pct"), C("pt").alias("pt_pct")).agg(
        F.count("*").alias("n_trades"),
        F.count_if(stopped).alias("sl_exits"),
        F.count_if(reached).alias("pt_exits"),
        F.avg((C("return_pct") > 0).cast("double")).alias("win_rate"),
        F.avg("return_pct").alias("mean_return"),
        F.when(
            F.stddev_pop("return_pct") > 1e-12, F.avg("return_pct") / F.stddev_pop("return_pct")
        ).alias("sharpe"),
    )


def sizing_sweep(
    trades: DataFrame, fractions: Sequence[float], *, capital: float = INITIAL_CAPITAL
) -> DataFrame:
    """Fixed fractions per horizon: trade metrics and profit over capital."""
    sized = trades.select("*", _values(fractions, "fraction")).withColumn(
        "pnl", C("fraction") * capital * C("return_pct")
    )
    return trade_metrics(sized, ["horizon", "fraction"]).withColumn(
        "return_on_capital", C("total_pnl") / capital
    )


def strategy_matrix(
    results: DataFrame, strategies: Sequence[str], metric: str = "sharpe",
    by: Sequence[str] = ("horizon",), strategy: str = "strategy",
) -> DataFrame:
    """One row per ``by``, one column per strategy."""
    return results.groupBy(*by).agg(
        *[F.max(F.when(C(strategy) == s, C(metric))).alias(s) for s in strategies]
    )


def best_config(
    results: DataFrame, n: int = 3, *, metric: str = "sharpe", group: str = "horizon",
    config: Sequence[str] = ("sl_pct", "pt_pct"), min_trades: int = 30,
) -> DataFrame:
    """Top-n settings per group plus the all-zero baseline; ``best`` marks the
    top setting with enough trades, or of any if none has."""
    order = [C(metric).desc_nulls_last(), *[C(c) for c in config]]
    w = Window.partitionBy(group).orderBy(*order)
    enough = C("n_trades") >= min_trades
    base = F.lit(True)
    for c in config:
        base = base & (C(c) == 0.0)
    picked = F.row_number().over(
        Window.partitionBy(group).orderBy(F.when(enough, 0).otherwise(1), *order)
    )
    return (
        results.withColumns(
            {"rank": F.row_number().over(w), "baseline": base, "best": picked == 1}
        )
        .filter((C("rank") <= n) | C("baseline") | C("best"))
    )
