"""Order-free comparison of two result frames."""

from __future__ import annotations

import pandas as pd


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = normal(a), normal(b)
    assert len(x) == len(y)
    assert x == y
