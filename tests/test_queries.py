"""Registered queries against their SQL."""

import math

import numpy as np
import pandas as pd
import pytest

from larkspur.plans import features_catalogue, metrics_catalogue, models_catalogue, rules_catalogue  # noqa: F401
from larkspur.plans.registry import QUERIES, SQL


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return float(f"{v:.9g}")
    if isinstance(v, np.integer):
        return int(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or len(df) and hasattr(df[c].iloc[0], "isoformat"):
            df = df.assign(**{c: pd.to_datetime(df[c])})
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, oracle, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), oracle.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
