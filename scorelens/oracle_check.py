"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB oracle on the same parquet tables and compare row count,
column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os

# SCORELENS_STRICT=1 hashes floats at full precision (no rounding).
STRICT = os.environ.get("SCORELENS_STRICT") == "1"

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        if v.is_integer() and abs(v) < 2**53:  # a long column with nulls comes as floats from one engine
            return str(int(v))
        return repr(v + 0.0) if STRICT else repr(round(v, 8) + 0.0)
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return _norm(float(v))
    except Exception:
        pass
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def frame_digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf[cols].astype(object).to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(pdf), cols, h


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None, show=5):
    sdf = query(spark, sf_dir).toPandas()
    if sql is None:
        return {"name": name, "rows": len(sdf), "oracle": None}
    con = con or duck(sf_dir)
    ddf = con.execute(sql).df()
    a, b = frame_digest(sdf), frame_digest(ddf)
    res = {"name": name, "rows": (a[0], b[0]), "cols_ok": a[1] == b[1], "hash_ok": a[2] == b[2]}
    if not (res["cols_ok"] and res["hash_ok"]):
        res["spark_cols"], res["duck_cols"] = a[1], b[1]
        cols = sorted(set(a[1]) & set(b[1]))
        if cols:
            sa = sorted("|".join(_norm(r[c]) for c in cols) for r in sdf[cols].astype(object).to_dict("records"))
            sb = sorted("|".join(_norm(r[c]) for c in cols) for r in ddf[cols].astype(object).to_dict("records"))
            diff_a = [x for x in sa if x not in set(sb)][:show]
            diff_b = [x for x in sb if x not in set(sa)][:show]
            res["cols"] = cols
            res["spark_only"], res["duck_only"] = diff_a, diff_b
    return res
