"""One open position per series: non-overlapping trades by pointer doubling, compounded by sums of logarithms.

The first trade of a series is taken; after a trade the next one that enters at or after its exit. Every
trade points to that successor (one forward as-of join). Pointers are doubled by self-joins, so 2^k steps ahead are known
after k of them, and what the first trade reaches is marked with one join per doubling: a series of n trades needs
about log2(n) joins on (series, entry), which spread a hot series over all tasks. No series is walked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.asof import asof
from barloom.operators.blocks import running
from barloom.operators.trades import BAR_BLOCK, INITIAL_CAPITAL
from barloom.session import materialize

C = F.col
#: What is left of a stake that is lost whole: its logarithm must be finite.
LEFT = 1e-12


def non_overlapping(trades: DataFrame, *, key: Sequence[str] = ("ticker",), entry: str = "entry_bar", leave: str = "exit_bar") -> DataFrame:
    """The trades that a series with one open position makes. Of trades that enter together the one of the highest ``mean``
    counts, then of the shorter ``horizon``. A trade that leaves no later than it enters is followed by a later entry.
    Trades without series, entry or exit are left out."""
    keys = list(key)
    known = trades.dropna(subset=[*keys, entry, leave])
    best = F.min_by(F.struct(*trades.columns), F.struct(-C("mean"), "horizon", leave)).alias("_t")
    one = materialize(known.groupBy(*keys, entry).agg(best).select("_t.*"))
    bucket = F.floor(C("_at") / BAR_BLOCK)
    ends = one.select(*keys, C(entry).alias("_from"), F.greatest(C(leave), C(entry) + 1).alias("_at"))
    entries = one.select(*keys, C(entry).alias("_at"), C(entry).alias("_to"))
    step = asof(ends, entries, key=keys, ts="_at", values=["_to"], direction="forward", bucket=bucket)
    steps = [materialize(step.filter(C("_to").isNotNull()).select(*keys, "_from", "_to"))]
    while not steps[-1].isEmpty():
        last = steps[-1]
        ahead = last.select(*keys, C("_from").alias("_to"), C("_to").alias("_next"))
        steps.append(materialize(last.join(ahead, [*keys, "_to"]).select(*keys, "_from", C("_next").alias("_to"))))
    taken = one.groupBy(*keys).agg(F.min(entry).alias("_from"))
    for jump in steps[-2::-1]:
        reached = taken.join(jump, [*keys, "_from"]).select(*keys, C("_to").alias("_from"))
        taken = materialize(taken.unionByName(reached))
    return one.join(taken.withColumnRenamed("_from", entry), [*keys, entry], "left_semi")


def single_position_book(
    trades: DataFrame, *, capital: float = INITIAL_CAPITAL, key: Sequence[str] = ("ticker",), entry: str = "entry_bar", leave: str = "exit_bar",
) -> DataFrame:
    """Books with one open position and compounding cash: adds ``invested`` (the cash before), ``pnl`` and ``cash`` (after).

    The capital is split evenly over the series that trade.
    """
    keys = list(key)
    taken = materialize(non_overlapping(trades, key=key, entry=entry, leave=leave))
    own = taken.select(*keys).distinct().agg((F.lit(capital) / F.count("*")).alias("_own"))
    grown = taken.withColumn("_log", F.log(F.greatest(1 + C("return_pct"), F.lit(LEFT))))
    sums = running(grown.select(*keys, entry, "_log"), keys, entry, {"_sum": ("sum", "_log")}, bucket=F.floor(C(entry) / BAR_BLOCK))
    out = grown.join(sums.select(*keys, entry, "_sum"), [*keys, entry]).crossJoin(F.broadcast(own))
    before = C("_own") * F.exp(C("_sum") - C("_log"))
    out = out.withColumns({"invested": before, "cash": C("_own") * F.exp("_sum")})
    return out.withColumn("pnl", C("invested") * C("return_pct")).drop("_log", "_sum", "_own")
