"""Per-series indicators over OHLCV bars.

Each family is a ``build(df, blocks, **params)`` step on halo blocks together
with the number of rows it looks back, so families can run alone or be chained
in ``indicator_panel`` where they share one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import update_wrapper

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import TINY, flag, full_window, or_zero, zero_to_null
from barloom.operators.bars import SESSION_MINUTES
from barloom.operators.blocks import HaloBlocks, memory, over_blocks, smooth, span_decay

C = F.col


class Family:
    """An indicator family usable alone or inside a panel."""

    def __init__(self, build: Callable[..., DataFrame], back: Callable[..., int]) -> None:
        self.build = build
        self.back = back
        update_wrapper(self, build)

    def __call__(
        self, bars: DataFrame, *, key: Sequence[str] = ("ticker",), ts: str = "ts",
        size: int = 4096, **params,
    ) -> DataFrame:
        return over_blocks(
            bars, lambda df, b: self.build(df, b, **params),
            back=self.back(**params), key=key, ts=ts, size=size,
        )


def family(back: Callable[..., int]):
    return lambda build: Family(build, back)


def _chg(x: str | Column, b: HaloBlocks, n: int = 1) -> Column:
    x = C(x) if isinstance(x, str) else x
    return x / zero_to_null(F.lag(x, n).over(b.window))


def _mean(x: str, b: HaloBlocks, n: int) -> Column:
    return full_window(F.avg(x), x, b.last(n), n)


def _std(x: str, b: HaloBlocks, n: int) -> Column:
    return full_window(F.stddev_samp(x), x, b.last(n), n)


def _sum(x: str, b: HaloBlocks, n: int) -> Column:
    return full_window(F.sum(x), x, b.last(n), n)


@family(lambda: 1)
def log_return(df, b):
    return df.withColumn("log_return", F.log(_chg("close", b)))


def fracdiff_weights(d: float = 0.4, threshold: float = 1e-4) -> list[float]:
    """Binomial weights of the fractional difference until they fall below threshold."""
    weights = [1.0]
    while True:
        k = len(weights)
        nxt = -weights[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            return weights
        weights.append(nxt)


@family(lambda d=0.4, threshold=1e-4: len(fracdiff_weights(d, threshold)))
def fracdiff(df, b, d=0.4, threshold=1e-4):
    taps = fracdiff_weights(d, threshold)[::-1]
    n = len(taps)
    w = b.last(n)
    dot = F.aggregate(
        F.zip_with("_frame", F.array(*[F.lit(t) for t in taps]), lambda x, t: x * t),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return (
        df.withColumn("_frame", full_window(F.collect_list("close"), "close", w, n))
        .withColumn("fracdiff_close", dot)
        .drop("_frame")
    )


@family(lambda periods=(5, 10, 20, 50): max(periods))
def sma_distance(df, b, periods=(5, 10, 20, 50)):
    return df.withColumns(
        {f"sma_{p}_rel": C("close") / _mean("close", b, p) - 1.0 for p in periods}
    )


@family(lambda spans=(12, 26): max(memory(span_decay(s)) for s in spans))
def ema_distance(df, b, spans=(12, 26)):
    df = smooth(df, b, {f"_ema_{s}": ("close", span_decay(s), 0) for s in spans})
    return df.withColumns(
        {
            f"ema_{s}_rel": F.when(C(b.idx) >= s - 1, C("close") / C(f"_ema_{s}") - 1.0)
            for s in spans
        }
    ).drop(*[f"_ema_{s}" for s in spans])


@family(lambda periods=(3, 6, 12): max(periods))
def momentum(df, b, periods=(3, 6, 12)):
    out = {}
    for p in periods:
        out[f"mom_{p}"] = _chg("close", b, p) - 1.0
        out[f"logret_{p}"] = F.log(_chg("close", b, p))
    return df.withColumns(out)


@family(lambda windows=(12, 24, 48): max(windows) + 1)
def rolling_volatility(df, b, windows=(12, 24, 48)):
    lr = F.log(_chg("close", b))
    df = df.withColumn("_lr", lr).withColumns(
        {
            "_up": F.when(C("_lr").isNotNull(), F.greatest("_lr", F.lit(0.0))),
            "_dn": F.when(C("_lr").isNotNull(), F.least("_lr", F.lit(0.0))),
        }
    )
    df = df.withColumns(
        {
            f"{name}_{w}": _std(src, b, w)
            for w in windows
            for name, src in (("vol", "_lr"), ("rv_up", "_up"), ("rv_dn", "_dn"))
        }
    )
    return df.withColumns(
        {
            f"vol_asym_{w}": (C(f"rv_dn_{w}") - C(f"rv_up_{w}"))
            / (C(f"rv_up_{w}") + C(f"rv_dn_{w}") + TINY)
            for w in windows
        }
    ).drop("_lr", "_up", "_dn")


@family(lambda windows=(12, 24, 48): max(windows))
def volume_profile(df, b, windows=(12, 24, 48)):
    df = df.withColumn("_vol", zero_to_null("volume"))
    out = {"volume_log": F.log(C("_vol") + 1.0)}
    for w in windows:
        mean, std = _mean("_vol", b, w), _std("_vol", b, w)
        out[f"volume_rel_{w}"] = F.coalesce(C("_vol") / mean, F.lit(1.0))
        out[f"volume_zscore_{w}"] = or_zero((C("_vol") - mean) / (std + TINY))
    return df.withColumns(out).drop("_vol")


@family(lambda: 0)
def bar_shape(df, b):
    both = C("open").isNotNull() & C("close").isNotNull()
    top = F.when(both, F.greatest("open", "close"))
    bottom = F.when(both, F.least("open", "close"))
    close, span = zero_to_null("close"), C("high") - C("low")
    return df.withColumns(
        {
            "shadow_upper": (C("high") - top) / close,
            "shadow_lower": (bottom - C("low")) / close,
            "body_dominance": F.abs(C("close") - C("open")) / (span + TINY),
            "range_rel": span / close,
        }
    )


def _rsi_value(up: str, down: str) -> Column:
    rs = C(up) / zero_to_null(down)
    return F.coalesce(100.0 - 100.0 / (1.0 + rs), F.lit(50.0)) / 100.0


@family(lambda period=14: memory(1.0 - 1.0 / period) + 1)
def rsi(df, b, period=14):
    step = C("close") - F.lag("close").over(b.window)
    df = df.withColumns(
        {
            "_gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))),
            "_loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))),
        }
    )
    decay = 1.0 - 1.0 / period
    df = smooth(df, b, {"_rise": ("_gain", decay, 1), "_fall": ("_loss", decay, 1)})
    ready = C(b.idx) >= period  # the first difference sits on row 1
    return df.withColumn(
        f"rsi_{period}", F.when(ready, _rsi_value("_rise", "_fall")).otherwise(0.5)
    ).drop("_gain", "_loss", "_rise", "_fall")


@family(lambda period=14: period + 1)
def natr(df, b, period=14):
    prev = F.lag("close").over(b.window)
    true_range = F.greatest(
        C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev)
    )
    return (
        df.withColumn("_tr", true_range)
        .withColumn(f"natr_{period}", _mean("_tr", b, period) / zero_to_null("close"))
        .drop("_tr")
    )


@family(lambda: 0)
def garman_klass(df, b):
    hl = F.log(C("high") / zero_to_null("low"))
    co = F.log(C("close") / zero_to_null("open"))
    return df.withColumn(
        "volatility_gk", 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co
    )


@family(
    lambda fast=12, slow=26, signal=9: memory(span_decay(slow)) + memory(span_decay(signal))
)
def macd(df, b, fast=12, slow=26, signal=9):
    df = smooth(
        df, b,
        {"_fast": ("close", span_decay(fast), 0), "_slow": ("close", span_decay(slow), 0)},
    )
    first = max(fast, slow) - 1
    df = df.withColumn(
        "macd", F.when(C(b.idx) >= first, (C("_fast") - C("_slow")) / zero_to_null("close"))
    )
    df = smooth(df, b, {"_sig": ("macd", span_decay(signal), first)})
    return (
        df.withColumn("macd_signal", F.when(C(b.idx) >= first + signal - 1, C("_sig")))
        .withColumn("macd_hist", C("macd") - C("macd_signal"))
        .drop("_fast", "_slow", "_sig")
    )


@family(lambda window=20, n_std=2.0: window)
def bollinger(df, b, window=20, n_std=2.0):
    df = df.withColumns({"_mid": _mean("close", b, window), "_sd": _std("close", b, window)})
    lower, upper = C("_mid") - n_std * C("_sd"), C("_mid") + n_std * C("_sd")
    return df.withColumns(
        {
            "bb_pct_b": (C("close") - lower) / zero_to_null(upper - lower),
            "bb_bandwidth": (upper - lower) / zero_to_null("_mid"),
        }
    ).drop("_mid", "_sd")


def _high_low(df: DataFrame, b: HaloBlocks, n: int) -> DataFrame:
    return df.withColumns(
        {
            "_top": full_window(F.max("high"), "high", b.last(n), n),
            "_bot": full_window(F.min("low"), "low", b.last(n), n),
        }
    )


@family(lambda window=14, smooth_n=3: window + smooth_n)
def stochastic(df, b, window=14, smooth_n=3):
    df = _high_low(df, b, window).withColumn(
        "stoch_k", (C("close") - C("_bot")) / zero_to_null(C("_top") - C("_bot"))
    )
    return df.withColumn("stoch_d", _mean("stoch_k", b, smooth_n)).drop("_top", "_bot")


@family(lambda window=14: window)
def williams_r(df, b, window=14):
    return (
        _high_low(df, b, window)
        .withColumn("williams_r", -(C("_top") - C("close")) / zero_to_null(C("_top") - C("_bot")))
        .drop("_top", "_bot")
    )


def _typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3.0


@family(lambda window=20: window)
def cci(df, b, window=20):
    df = df.withColumn("_tp", _typical()).withColumns(
        {
            "_sma": _mean("_tp", b, window),
            "_frame": full_window(F.collect_list("_tp"), "_tp", b.last(window), window),
        }
    )
    mad = (
        F.aggregate("_frame", F.lit(0.0), lambda acc, x: acc + F.abs(x - C("_sma"))) / window
    )
    return df.withColumn(
        f"cci_{window}", (C("_tp") - C("_sma")) / (0.015 * zero_to_null(mad))
    ).drop("_tp", "_sma", "_frame")


@family(lambda periods=(5, 10, 20): max(periods))
def roc(df, b, periods=(5, 10, 20)):
    return df.withColumns({f"roc_{p}": _chg("close", b, p) - 1.0 for p in periods})


@family(lambda window=50: window + 1)
def obv_zscore(df, b, window=50):
    """The z-score does not change when a constant is added to the balance, so
    the cumulative balance may start at the block instead of the series."""
    step = F.signum(C("close") - F.lag("close").over(b.window))
    df = df.withColumn("_flow", C("volume") * or_zero(step))
    df = df.withColumn("_obv", F.sum("_flow").over(b.window.rowsBetween(Window.unboundedPreceding, 0)))
    z = (C("_obv") - _mean("_obv", b, window)) / (_std("_obv", b, window) + TINY)
    return df.withColumn("obv_zscore", or_zero(z)).drop("_flow", "_obv")


@family(lambda window=14: window + 1)
def mfi(df, b, window=14):
    df = df.withColumn("_tp", _typical())
    df = df.withColumn("_step", C("_tp") - F.lag("_tp").over(b.window))
    flow = C("_tp") * C("volume")
    df = df.withColumns(
        {
            "_in": F.when(C("_step") > 0, flow).otherwise(0.0),
            "_out": F.when(C("_step") < 0, flow).otherwise(0.0),
        }
    )
    ratio = _sum("_in", b, window) / zero_to_null(_sum("_out", b, window))
    return df.withColumn(
        f"mfi_{window}", F.coalesce(100.0 - 100.0 / (1.0 + ratio), F.lit(50.0)) / 100.0
    ).drop("_tp", "_step", "_in", "_out")


@family(lambda window=60: window + 1)
def hurst_rs(df, b, window=60):
    """Rescaled range of the last ``window`` log-returns."""
    if window < 20:
        return df.withColumn(f"hurst_{window}", F.lit(None).cast("double"))
    df = df.withColumn("_lr", F.log(_chg("close", b)))
    df = df.withColumns(
        {
            "_frame": full_window(F.collect_list("_lr"), "_lr", b.last(window), window),
            "_m": _mean("_lr", b, window),
            "_s": _std("_lr", b, window),
        }
    )

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + (x - C("_m"))
        return F.struct(
            total.alias("total"),
            F.greatest(acc["top"], total).alias("top"),
            F.least(acc["bot"], total).alias("bot"),
        )

    start = F.struct(
        F.lit(0.0).alias("total"),
        F.lit(float("-inf")).alias("top"),
        F.lit(float("inf")).alias("bot"),
    )
    spread = F.aggregate("_frame", start, step, lambda acc: acc["top"] - acc["bot"])
    value = F.log(spread / C("_s") + 1e-10) / math.log(window)
    return df.withColumn(f"hurst_{window}", F.when(C("_s") >= 1e-10, value)).drop(
        "_lr", "_frame", "_m", "_s"
    )


# Fixed value: first session minute of the day (UTC).
SESSION_OPEN_MINUTE = 420


def cyclic_time(df: DataFrame, ts: str = "ts", exchange: bool = True) -> DataFrame:
    """Sine and cosine of session fraction, weekday and day of month."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    if exchange:
        frac = F.greatest(
            F.lit(0.0),
            F.least(F.lit(1.0), (minute - SESSION_OPEN_MINUTE) / F.lit(float(SESSION_MINUTES))),
        )
    else:
        frac = minute / F.lit(1440.0)
    turn = 2.0 * math.pi
    angles = {
        "daily": turn * frac,
        "dow": turn * F.weekday(ts) / 7.0,
        "dom": turn * F.day(ts) / 31.0,
    }
    names = {"daily": ("time_sin_daily", "time_cos_daily"), "dow": ("dow_sin", "dow_cos"),
             "dom": ("dom_sin", "dom_cos")}
    out = {}
    for k, a in angles.items():
        out[names[k][0]], out[names[k][1]] = F.sin(a), F.cos(a)
    return df.withColumns(out)


@family(lambda windows=(5, 15, 30): max(windows) + 1)
def logret_sums(df, b, windows=(5, 15, 30)):
    df = df.withColumn("lr_1", F.log(_chg("close", b)))
    return df.withColumns({f"lr_{w}": _sum("lr_1", b, w) for w in windows})


@family(lambda windows=(5, 15), sector="sec_pr_close": max(windows) + 1)
def sector_relative(df, b, windows=(5, 15), sector="sec_pr_close"):
    df = df.withColumns(
        {
            "_sec": F.log(_chg(sector, b)),
            "_own": F.log(_chg("close", b)),
            "sec_rel_strength": F.coalesce(C("close") / zero_to_null(sector), F.lit(1.0)) - 1.0,
        }
    )
    out = {"sec_lr_1": or_zero("_sec"), "sec_lr_residual": or_zero(C("_own") - C("_sec"))}
    for w in windows:
        out[f"sec_lr_{w}"] = or_zero(_sum("_sec", b, w))
    return df.withColumns(out).drop("_sec", "_own")


@family(lambda window=384, cols=("close", "volume"), eps=1e-5: window)
def window_instance_norm(df, b, window=384, cols=("close", "volume"), eps=1e-5):
    """Each value against the mean and population variance of its own window."""
    return df.withColumns(
        {
            f"{c}_norm": (C(c) - full_window(F.avg(c), c, b.last(window), window))
            / F.sqrt(full_window(F.var_pop(c), c, b.last(window), window) + eps)
            for c in cols
        }
    )


def ticker_dummies(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """``tid``: the one-hot vector of the ticker, sparse, as a map of the names whose indicator is one.

    No list of tickers is gathered and no column is added per ticker; a null ticker has an empty vector.
    """
    none = F.create_map().cast("map<string,double>")
    return df.withColumn("tid", F.when(C(ticker).isNull(), none).otherwise(F.create_map(C(ticker), F.lit(1.0))))


def dummy(name: str) -> Column:
    """The indicator of one ticker, read from ``tid``."""
    return F.coalesce(F.element_at("tid", F.lit(name)), F.lit(0.0)).alias(f"tid_{name}")


BASIC: tuple[Family, ...] = (
    log_return, sma_distance, ema_distance, momentum, rolling_volatility,
    volume_profile, bar_shape, rsi, natr, garman_klass,
)
EXTENDED: tuple[Family, ...] = (
    macd, bollinger, stochastic, williams_r, cci, roc, obv_zscore, mfi,
)


def indicator_panel(
    bars: DataFrame,
    *,
    use_fracdiff: bool = True,
    use_hurst: bool = True,
    use_temporal: bool = True,
    hurst_window: int = 60,
    fracdiff_d: float = 0.4,
    params: dict[str, dict] | None = None,
    key: Sequence[str] = ("ticker",),
    ts: str = "ts",
    size: int = 4096,
) -> DataFrame:
    """All families on one set of halo blocks: one shuffle, one sort per block.

    ``params`` overrides a family's arguments by its name.
    """
    steps: list[tuple[Family, dict]] = [(f, {}) for f in (*BASIC, *EXTENDED)]
    if use_fracdiff:
        steps.append((fracdiff, {"d": fracdiff_d}))
    if use_hurst:
        steps.append((hurst_rs, {"window": hurst_window}))
    steps = [(f, {**kw, **(params or {}).get(f.__name__, {})}) for f, kw in steps]

    def build(df: DataFrame, b: HaloBlocks) -> DataFrame:
        for f, kw in steps:
            df = f.build(df, b, **kw)
        return df

    back = max(f.back(**kw) for f, kw in steps)
    out = over_blocks(bars, build, back=back, key=key, ts=ts, size=size)
    return cyclic_time(out, ts) if use_temporal else out
