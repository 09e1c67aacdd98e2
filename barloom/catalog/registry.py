"""Named queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TIME = "yyyy-MM-dd HH:mm:ss"


def present(df: DataFrame, digits: int = 6, money: Sequence[str] = ()) -> DataFrame:
    """Comparable output: rounded doubles without -0.0, text times, integer flags.

    ``money`` names large sums, rounded to cents.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = 10.0 ** (2 if f.name in money else digits)
            c = F.rint(c.cast("double") * scale) / scale + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TIME)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(
    sql: str | None = None, name: str | None = None, digits: int = 6, money: Sequence[str] = ()
):
    def register(fn: Query) -> Query:
        key = name or fn.__name__.removeprefix("q_")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return present(fn(tune(spark), sf), digits, money)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def rounded(
    doubles: Sequence[str], plain: Sequence[str] = (), times: Sequence[str] = ("ts",),
    digits: int = 6,
) -> str:
    """The SQL select list that matches ``present``."""
    parts = [*plain]
    parts += [f"strftime({t}, '%Y-%m-%d %H:%M:%S') AS {t}" for t in times]
    parts += [f"{rnd(d, digits)} AS {d}" for d in doubles]
    return ", ".join(parts)


def rnd(expr: str, digits: int = 6) -> str:
    """Rounding as in ``present``: scale, round half to even, scale back."""
    scale = 10**digits
    return f"(round_even({expr} * {scale}.0::DOUBLE, 0) / {scale}.0::DOUBLE + 0.0::DOUBLE)"
