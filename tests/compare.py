"""Order-insensitive comparison of a Spark result and a DuckDB result."""

import math

import pandas as pd


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple, dict)):
        return str(v)
    return v


def canonical(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in rec) for rec in df[cols].astype(object).itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame):
    sc, sr = canonical(spark_pdf)
    oc, orr = canonical(oracle_pdf)
    assert sc == oc, f"columns differ: {sc} vs {oc}"
    assert len(sr) == len(orr), f"row count differs: {len(sr)} vs {len(orr)}"
    bad = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
    assert not bad, f"values differ: {bad}"
