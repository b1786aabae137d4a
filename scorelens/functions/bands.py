"""Right-closed score bands over (0, 1] with two-decimal labels.

Fixed values (they must equal the reference's report bands):
  10 bands: (0,0.1] '0.00~0.10', (0.1,0.2] '0.10~0.20', ... (0.9,1] '0.90~1.00'
  20 bands: (0,0.05] '0.00~0.05', (0.05,0.1] '0.05~0.10', ... (0.95,1] '0.95~1.00'
Scores <= 0, > 1, null or NaN get no band (null).  Edges are the decimal
literals themselves (round(i*width, 2)), never i*width, because 3*0.05 != 0.15
in doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(n_bands: int) -> list[tuple[float, float, str]]:
    out = []
    for i in range(n_bands):
        lo, hi = round(i / n_bands, 2), round((i + 1) / n_bands, 2)
        out.append((lo, hi, f"{lo:.2f}~{hi:.2f}"))
    return out


def band_labels(n_bands: int) -> list[str]:
    return [lab for _, _, lab in _edges(n_bands)]


def score_band(col: Column | str, n_bands: int = 20) -> Column:
    """CASE chain on literal edges, evaluated in order like an if/elif chain."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for lo, hi, lab in _edges(n_bands):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr
