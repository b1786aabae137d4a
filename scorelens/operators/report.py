"""Report composites: every table of the reference's workbook as a DataFrame.

``score_report`` builds the monitoring tables from a scored DataFrame with a
period column; ``model_report`` first fits the pipeline on dev, scores all
periods once (stored as Parquet: every table reads the columns it needs), then
calls ``score_report`` on the model score.  ``write_bundle`` writes one
Parquet (or CSV) directory per table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators import evaluate as ev
from scorelens.operators import monitor as mon
from scorelens.operators import profile as prof
from scorelens.plans.broadcast import materialize
from scorelens.plans.scoretable import score_table
from scorelens.sources.tables import SAMPLES
from scorelens.spec import FeatureSpec


def score_report(df: DataFrame, score: str = "score", target: str = "target", key: str = "row_id",
                 sample_col: str = "sample", samples=SAMPLES, base: str = "dev", bins: int = 20,
                 psi_k: int = 20, spec: FeatureSpec | None = None, psi: bool = True,
                 materialize_input: bool = False) -> dict[str, DataFrame]:
    """All monitoring tables of one scored DataFrame.  What is about the score is read off one
    score table (``plans.scoretable``), a single pass over ``df``.  With ``materialize_input`` ``df`` is stored
    first, so that the tables about other columns don't plan it again (worth it when
    ``df`` is an expensive plan such as a join, not when it is a stored table)."""
    if materialize_input:
        df = materialize(df)
    table = score_table(df.where(F.col(sample_col).isin(list(samples))), score, target, [sample_col], groups=len(samples))
    out = {
        "samples": sample_sheet(df, target, sample_col),
        "class_balance": prof.class_balance(table.rows, target, [sample_col], counted=True),
        "score_dist": mon.score_distribution(df, score, sample_col, samples, table=table),
        "gains": ev.gains(df, score, target, key, bins, by=[sample_col], table=table, groups=samples),
        "metrics": ev.roc_summary(df, score, target, key, by=[sample_col], table=table, groups=samples),
        "histogram": mon.score_histogram(df, score, by=[sample_col], groups=samples, table=table),
    }
    if psi:
        others = [s for s in samples if s != base]
        out["psi"] = mon.psi_monitor(df, score, key, sample_col, base, others, psi_k, table=table)
    if spec is not None:
        dev = df.where(F.col(sample_col) == base)
        out["describe"] = prof.describe(dev, list(spec.num), (0.25, 0.5, 0.75))
        spans = prof.number_spans(df, spec.num, [sample_col]) if spec.num else None
        binned, listed = prof.route_numeric(df, spec.num, spans=spans)  # every feature is in one of the two
        if binned:
            out["bivar"] = prof.bivar_numeric(df, binned, target, by=[sample_col], min_distinct=None, spans=spans)
        out["bivar_levels"] = prof.bivar_categorical(df, [*spec.char, *listed], target, by=[sample_col])
    return out


def report_summary(tables: dict[str, DataFrame], sample_col: str = "sample") -> DataFrame:
    """One row per period: class balance, KS, AUC and PSI against the base."""
    s = tables["class_balance"].join(tables["metrics"], sample_col, "left")
    if "psi" in tables:
        s = s.join(tables["psi"], sample_col, "left")
    return s


def model_report(df: DataFrame, spec: FeatureSpec, sample_col: str = "sample", key: str = "row_id",
                 base: str = "dev", top: int | None = None, **params) -> dict[str, DataFrame]:
    """Fit on ``base``, score all samples, and every table of the workbook; ``bivar_ranked`` is the single-variable
    analysis in order of importance (the first ``top`` features)."""
    from scorelens.operators.model import DEFAULTS, FEATURE_PREFIX, feature_importance, fit_model, prepare_features, score

    fitted = fit_model(df.where(F.col(sample_col) == base), spec, **params)
    scored = materialize(score(fitted, df, spec))
    tables = score_report(scored, "model_score", spec.target, key, sample_col, base=base, spec=spec)
    tables["importance"] = feature_importance(fitted.model, spec, fitted.features)
    tables["dtypes"] = prof.column_types(df)
    inputs = prepare_features(df.where(F.col(sample_col) == base), fitted.woe_map, spec)
    inputs = inputs.select(*[F.col(FEATURE_PREFIX + c).alias(c) for c in spec.varlist])
    tables["describe"] = prof.describe(inputs, spec.varlist, (0.25, 0.5, 0.75))  # of the inputs as the model gets them
    order = [r["name"] for r in tables["importance"].collect()]  # a row per feature
    tables["bivar_ranked"] = prof.bivar(scored, spec.char, spec.num, spec.target, by=[sample_col], order=order, top=top)
    tables["params"] = params_sheet(df.sparkSession, {**DEFAULTS, **params})
    return tables


def params_sheet(spark, params: dict) -> DataFrame:
    """The model's parameters, a row each."""
    return spark.createDataFrame([(k, str(v)) for k, v in params.items()], "name string, value string")


def sample_sheet(df: DataFrame, target: str = "target", sample_col: str = "sample") -> DataFrame:
    """What the samples are: rows, rows with a target, and class 1 of each."""
    return df.groupBy(sample_col).agg(F.count(F.lit(1)).alias("rows"), F.count(target).alias("labelled"),
                                      F.count(F.when(F.col(target) == 1, 1)).alias("bad"))


def sheet_values(table: DataFrame, sheet: str, keys) -> DataFrame:
    """(sheet, key, name, value): each number of a sheet, ``keys`` joined to one text; nulls are left out."""
    numbers = [f.name for f in table.schema.fields if f.name not in keys]
    rows = table.select(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key"), *[F.col(c).cast("double").alias(c) for c in numbers])
    long = rows.unpivot(["key"], numbers, "name", "value").where(F.col("value").isNotNull())
    return long.select(F.lit(sheet).alias("sheet"), "key", "name", "value")


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each table under path/<name>; returns name -> location."""
    out = {}
    for name, t in tables.items():
        loc = f"{path.rstrip('/')}/{name}"
        w = t.write.mode("overwrite")
        (w.option("header", True).csv(loc) if fmt == "csv" else w.parquet(loc))
        out[name] = loc
    return out
