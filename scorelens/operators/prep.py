"""Preparation verbs: X/Y splits, location split, null filling, sparse columns.

All return new DataFrames (inputs are never changed).  NaN counts as missing
everywhere here, as it does in pandas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.functions.predicates import split_part
from scorelens.spec import FeatureSpec


def split_x_y(df: DataFrame, y: str) -> tuple[DataFrame, DataFrame]:
    """All columns but y, and y alone."""
    return df.drop(y), df.select(y)


def x_y_split(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """Catalogue columns only (char then numeric), and the target."""
    return df.select(*spec.varlist), df.select(spec.target)


def location_split(df: DataFrame, cols=("mobile_location", "idcard_location"), sep: str = ",") -> DataFrame:
    """For each "prov,city" column c add c_prov (part 0) and c_city (part 1).

    A named column that the frame lacks is an error."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"no such column to split: {', '.join(absent)}")
    out = df
    for c in cols:
        stem = c[: -len("_location")] + "_loc" if c.endswith("_location") else c
        out = out.withColumn(f"{stem}_prov", split_part(c, 0, sep)).withColumn(f"{stem}_city",
                                                                                 split_part(c, 1, sep))
    return out


def _missing(f: T.StructField):
    c = F.col(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


#: Bits of the integral types.
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _holds(kind: T.DataType, number: float) -> bool:
    """Whether a whole number fits an integral or decimal type."""
    if isinstance(kind, T.DecimalType):
        return abs(int(number)) < 10 ** (kind.precision - kind.scale)
    most = 2 ** (BITS[type(kind)] - 1)
    return -most <= int(number) < most


def fill_constant(df: DataFrame, value=0) -> DataFrame:
    """Every missing cell of every column -> value.

    The value is kept as it is: an integral or decimal column that can't hold it
    becomes double, as a pandas column would become float; string columns get
    str(value).  Columns of other types (dates, timestamps, booleans, nested)
    can't hold a number and stay as they are.
    """
    number = float(value) if isinstance(value, str) else value
    whole = float(number).is_integer()
    text = value if isinstance(value, str) else str(value)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(_missing(f), F.lit(text)).otherwise(c)
        elif isinstance(f.dataType, (T.IntegralType, T.DecimalType)) and not (whole and _holds(f.dataType, number)):
            c = F.when(_missing(f), F.lit(float(number))).otherwise(c.cast("double"))
        elif isinstance(f.dataType, T.NumericType):
            c = F.when(_missing(f), F.lit(int(number) if whole and isinstance(f.dataType, T.IntegralType) else number).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def fill_na(df: DataFrame, method=0) -> DataFrame:
    """"mean" -> fill_mean; a number (or numeric string) -> fill_constant."""
    from scorelens.functions.predicates import NUMERIC_PATTERN
    import re

    if method == "mean":
        return fill_mean(df)
    if isinstance(method, (int, float)) or (isinstance(method, str) and re.match(NUMERIC_PATTERN, method)):
        return fill_constant(df, method)
    raise ValueError(f"fill method must be 'mean' or a number, got {method!r}")


def fill_mean(df: DataFrame, cols=None) -> DataFrame:
    """Missing numeric cells -> the column mean (NaN and null skipped).

    One aggregation (an action returning one row of means).  Integral columns
    become double, as a pandas integer column holding NaN is float.
    """
    num = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
           and (cols is None or f.name in cols)]
    if not num:
        return df
    aggs = [F.avg(F.when(~_missing(f), F.col(f.name))).alias(f.name) for f in num]
    means = df.agg(*aggs).first().asDict()
    out = []
    for f in df.schema.fields:
        if f in num and means.get(f.name) is not None:
            m = means[f.name]
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
                out.append(F.when(_missing(f), F.lit(float(m))).otherwise(F.col(f.name).cast("double")).alias(f.name))
            else:
                out.append(F.when(_missing(f), F.lit(m).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sparse_column_report(df: DataFrame, nan_ratio: float = 0.5) -> DataFrame:
    """(column_name, non_null, n_rows, kept): kept unless non_null/n_rows < 1-nan_ratio.

    One single-row aggregation over all columns, unpivoted afterwards; no action.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count(F.when(~_missing(f), 1)).alias(f"c{i}") for i, f in enumerate(fields)
    ]
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"c{i}").alias("non_null"))
                      for i, f in enumerate(fields)])
    rep = one.select(F.col("__n").alias("n_rows"), F.explode(pairs).alias("p")).select(
        "p.column_name", "p.non_null", "n_rows")
    kept = ~((F.col("non_null") / F.col("n_rows")) < F.lit(1.0 - nan_ratio))
    return rep.withColumn("kept", kept)


def drop_sparse_columns(df: DataFrame, nan_ratio: float = 0.5) -> DataFrame:
    """Drop columns whose non-missing share is below 1-nan_ratio (equality kept).

    The output schema depends on the data, so this runs one action.
    """
    keep = [r["column_name"] for r in sparse_column_report(df, nan_ratio).where("kept").collect()]
    return df.select(*[c for c in df.columns if c in set(keep)])
