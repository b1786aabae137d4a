"""Model fitting and scoring: robust scaling + boosted trees.

The reference fits scikit-learn / XGBoost on one machine; here the pipeline is
``VectorAssembler -> RobustScaler(5 %, 95 %) -> boosted trees`` so training and
scoring are distributed.  With L1 / L2 leaf penalties (``reg_alpha``, ``reg_lambda``; the demo's
0.01 are the default) the trees are grown by ``operators.boosting``; with both None
by MLlib's GBTClassifier.  Either way the fitted model is an MLlib pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators.boosting import PenalisedGBT
from scorelens.plans.selection import exact_quantiles
from scorelens.spec import FeatureSpec

#: The demo model's parameters, and the defaults of ``gbt_pipeline``.
DEFAULTS = {"learning_rate": 0.1, "n_estimators": 200, "max_depth": 3, "subsample": 1.0, "lower": 0.05, "upper": 0.95,
            "reg_alpha": 0.01, "reg_lambda": 0.01}


def robust_scale_exact(df: DataFrame, cols, lower: float = 0.05, upper: float = 0.95,
                       with_centering: bool = True) -> DataFrame:
    """(x - median) / (q_upper - q_lower) with exact quantiles (a zero range
    scales by 1); nulls stay null.  Two actions (the quantiles)."""
    cols = list(cols)
    q = exact_quantiles(df, cols, [lower, 0.5, upper])
    out = df
    for c in cols:
        lo, med, hi = q[c]
        if med is None:
            continue
        scale = (hi - lo) if hi is not None and lo is not None and hi != lo else 1.0
        centre = med if with_centering else 0.0
        out = out.withColumn(c, (F.col(c).cast("double") - F.lit(centre)) / F.lit(scale))
    return out


@dataclass
class BoostingPipeline:
    """``fit(df)`` gives the fitted pipeline: assembler, scaler, trees."""

    prepare: Pipeline
    trees: GBTClassifier | PenalisedGBT

    def fit(self, df: DataFrame) -> PipelineModel:
        prepared = self.prepare.fit(df)
        return PipelineModel([*prepared.stages, self.trees.fit(prepared.transform(df))])


def gbt_pipeline(features, label: str = "target", learning_rate: float = 0.1, n_estimators: int = 200,
                 max_depth: int = 3, subsample: float = 1.0, seed: int = 1, lower: float = 0.05,
                 upper: float = 0.95, reg_alpha: float | None = 0.01, reg_lambda: float | None = 0.01, **more) -> BoostingPipeline:
    """Scaling and boosted trees.  A penalty of None means 0 beside one that is given; both None: MLlib's own trees.
    ``more`` (min_child_weight, bins) goes to ``PenalisedGBT``."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_features_raw", handleInvalid="keep")
    scaler = RobustScaler(inputCol="_features_raw", outputCol="_features", lower=lower, upper=upper,
                          withCentering=True, withScaling=True)
    if reg_alpha is None and reg_lambda is None:
        if more:
            raise ValueError(f"MLlib's boosted trees have no {', '.join(sorted(more))}")
        trees = GBTClassifier(featuresCol="_features", labelCol=label, stepSize=learning_rate, maxIter=n_estimators,
                              maxDepth=max_depth, subsamplingRate=subsample, seed=seed)
    else:
        trees = PenalisedGBT("_features", label, learning_rate, n_estimators, max_depth, subsample, reg_alpha or 0.0, reg_lambda or 0.0, seed=seed, **more)
    return BoostingPipeline(Pipeline(stages=[asm, scaler]), trees)


def score_rows(model: PipelineModel, df: DataFrame, out: str = "model_score") -> DataFrame:
    """Probability of class 1 as a double column on the same row (no positional join)."""
    scored = model.transform(df)
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def feature_importance(model: PipelineModel, spec: FeatureSpec | None = None, features=None) -> DataFrame:
    """(name, var_type, importance): the fitted model's importances (bounded by the
    feature count) joined to the catalogue."""
    from pyspark.sql import SparkSession

    tree = model.stages[-1]
    names = list(features) if features is not None else [
        c[len(FEATURE_PREFIX):] if c.startswith(FEATURE_PREFIX) else c for c in model.stages[0].getInputCols()]
    types = dict(spec.var_types) if spec is not None else {}
    imp = tree.featureImportances.toArray().tolist()
    rows = [(n, types.get(n, "number"), float(round(v, 10))) for n, v in zip(names, imp)]
    rows.sort(key=lambda r: (-r[2], r[0]))  # most important first, as the report lists them
    return SparkSession.getActiveSession().createDataFrame(rows, "name string, var_type string, importance double")


@dataclass
class FittedModel:
    woe_map: DataFrame
    model: PipelineModel
    features: list[str]


FEATURE_PREFIX = "__f_"  # model inputs live next to the original columns


def prepare_features(df: DataFrame, wmap: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Add model inputs ``__f_<name>``: WOE of char features (unseen -> 0) and
    numeric features with nulls as 0 (treat).  Original columns are kept, so
    scoring needs no join back to the input."""
    from scorelens.operators.woe import woe_apply

    out = woe_apply(df, wmap, spec.char, fill=0.0, prefix=FEATURE_PREFIX)
    for c in spec.num:
        out = out.withColumn(FEATURE_PREFIX + c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return out


def fit_model(dev: DataFrame, spec: FeatureSpec, **params) -> FittedModel:
    from scorelens.operators.woe import woe_map
    from scorelens.plans.broadcast import materialize

    wmap = materialize(woe_map(dev, spec.char, spec.target))
    feats = spec.varlist
    inputs = [FEATURE_PREFIX + c for c in feats]
    train = materialize(prepare_features(dev, wmap, spec).select(*inputs, spec.target))  # read by every stage's fit
    model = gbt_pipeline(inputs, spec.target, **params).fit(train)
    return FittedModel(wmap, model, feats)


def score(fitted: FittedModel, df: DataFrame, spec: FeatureSpec, out: str = "model_score") -> DataFrame:
    """The input rows with the model score added (one pass per row, no join)."""
    return score_rows(fitted.model, prepare_features(df, fitted.woe_map, spec), out).select(*df.columns, out)


def gbt_fit_eval(df: DataFrame, spec: FeatureSpec, sample_col: str = "sample", dev: str = "dev",
                 evals=("dev", "val"), key: str = "row_id", **params) -> DataFrame:
    """Fit on dev; KS and AUC of the fitted score on each evaluated sample."""
    from scorelens.operators.evaluate import roc_summary

    fitted = fit_model(df.where(F.col(sample_col) == dev), spec, **params)
    s = score(fitted, df.where(F.col(sample_col).isin(*evals)), spec)
    return roc_summary(s, score="model_score", target=spec.target, key=key, by=[sample_col])
