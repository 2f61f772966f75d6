"""Order-insensitive comparison of result sets of two engines."""

import pandas as pd


def plain(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "item"):
        return plain(v.item())
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(plain(x) for x in r) for r in pdf.itertuples(index=False))
