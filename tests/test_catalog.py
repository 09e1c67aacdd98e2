"""Registry contract and a sample of queries against their SQL on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect


def test_registry():
    qs, sqls = queries(), oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) > 140
    for name, sql in sqls.items():
        assert " LIMIT " not in sql.upper(), name


@pytest.mark.parametrize(
    "name",
    ["resample_ohlcv", "ema_distance", "xs_rank", "dividend_features", "purge_tail",
     "two_stage_signals", "trade_outcomes", "per_series_book"],
)
def test_queries_match_sql(spark, sf, name):
    got = queries()[name](spark, sf).toPandas()
    assert compare(got, connect(sf).execute(oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    df = entry(spark)
    assert "rsi_14" in df.columns and df.count() > 0
