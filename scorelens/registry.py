"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracles.

Every query reads the given parquet tables (through the `sample` view or the
raw tables), so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens import oracles as O
from scorelens.operators import evaluate as ev
from scorelens.sources.tables import SAMPLES, sample_view
from scorelens.functions.bands import score_band
from scorelens.functions.predicates import is_num
from scorelens.operators import autogroup as AG
from scorelens.operators import model as M
from scorelens.operators import monitor as mon
from scorelens.operators import prep
from scorelens.operators import profile as P
from scorelens.operators import report as R
from scorelens.operators import sampling
from scorelens.operators import woe as W
from scorelens.operators.neighbours import knn
from scorelens.operators.smote import smote
from scorelens.session import scratch_path
from scorelens.sources import csv as C
from scorelens.spec import SAMPLE_SPEC
from scorelens.streaming import monitor as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _dev(spark, sf):
    return sample_view(spark, sf).where(F.col("sample") == "dev")


# --- 2F score evaluation -------------------------------------------------------------------

@register("gains_table", O.gains_sql(20, by=(), where="where sample = 'dev'"))
def q_gains_table(spark, sf):
    return ev.gains(_dev(spark, sf), bins=20)


@register("gains_by_sample", O.gains_sql(20, by=("sample",)))
def q_gains_by_sample(spark, sf):
    return ev.gains(sample_view(spark, sf), bins=20, by=["sample"], groups=SAMPLES)


@register("gains_table_balance", O.gains_sql(20, by=(), where="where sample = 'dev'", balance=True))
def q_gains_table_balance(spark, sf):
    return ev.gains(_dev(spark, sf), bins=20, balance="balance")


@register("fraud_report", O.gains_sql(100, by=("sample",), balance=True))
def q_fraud_report(spark, sf):
    return ev.gains(sample_view(spark, sf), bins=100, by=["sample"], balance="balance", groups=SAMPLES)


@register("top_capture", O.gains_sql(100, by=("sample",), balance=True) + " where bin = 1")
def q_top_capture(spark, sf):
    return ev.top_capture(q_fraud_report(spark, sf))


@register("roc_points_thin", O.roc_points_thin_sql(by=("sample",)))
def q_roc_points_thin(spark, sf):
    return ev.roc_points(sample_view(spark, sf), by=["sample"], groups=SAMPLES, thin=True)


@register("ks_max", O.roc_summary_sql(by=(), cols=("ks",)))
def q_ks_max(spark, sf):
    return ev.ks_max(sample_view(spark, sf))


@register("auc", O.roc_summary_sql(by=(), cols=("auc",)))
def q_auc(spark, sf):
    return ev.auc(sample_view(spark, sf))


@register("roc_points", O.roc_points_sql(by=("sample",)))
def q_roc_points(spark, sf):
    return ev.roc_points(sample_view(spark, sf), by=["sample"], groups=SAMPLES)


@register("normal_report", O.roc_summary_sql(by=("sample",), cols=("ks",)))
def q_normal_report(spark, sf):
    return ev.ks_max(sample_view(spark, sf), by=["sample"], groups=SAMPLES)


@register("sample_metrics", O.roc_summary_sql(by=("sample",)))
def q_sample_metrics(spark, sf):
    return ev.roc_summary(sample_view(spark, sf), by=["sample"], groups=SAMPLES)


@register("ks_curve", O.gains_sql(20, by=("sample",)) + """ union all
  select sample, 0 as bin, 0 as cum_bad_num, 0 as cum_good_num, 0.0 as cum_bad_pct, 0.0 as cum_good_pct,
  0.0 as avg_score, 0.0 as ks_value from (select distinct sample from sample)""")
def q_ks_curve(spark, sf):
    return ev.ks_curve(q_gains_by_sample(spark, sf), by=["sample"])


# --- 2F monitoring -------------------------------------------------------------------------


@register("score_band_10", O.band_rows_sql(10))
def q_score_band_10(spark, sf):
    return sample_view(spark, sf).select("row_id", "score", score_band("score", 10).alias("band"))


@register("score_band_20", O.band_rows_sql(20))
def q_score_band_20(spark, sf):
    return sample_view(spark, sf).select("row_id", "score", score_band("score", 20).alias("band"))


@register("score_distribution", O.score_distribution_sql(20))
def q_score_distribution(spark, sf):
    return mon.score_distribution(sample_view(spark, sf))


@register("value_counts", O.band_counts_by_sample_sql(20))
def q_value_counts(spark, sf):
    return mon.band_counts(sample_view(spark, sf), by=["sample"])


@register("score_psi", O.psi_sql(10, ("val", "oft1", "oft2", "oft3")))
def q_score_psi(spark, sf):
    return mon.score_psi(sample_view(spark, sf), others=("val", "oft1", "oft2", "oft3"), k=10)


@register("psi_monitor", O.psi_monitor_sql(20))
def q_psi_monitor(spark, sf):
    return mon.psi_monitor(sample_view(spark, sf), k=20)


@register("score_histogram", O.histogram_sql(20))
def q_score_histogram(spark, sf):
    return mon.score_histogram(sample_view(spark, sf), groups=SAMPLES)


# --- 2B projections, filters, scalar functions -----------------------------------------------


def _sample_dbl(spark, sf):
    """The sample view with balance as double (decimals hash differently across engines)."""
    return sample_view(spark, sf).withColumn("balance", F.col("balance").cast("double"))


@register("split_x_y", O.split_x_y_sql())
def q_split_x_y(spark, sf):
    return prep.split_x_y(_sample_dbl(spark, sf), "target")[0]


@register("x_y_split", O.with_sample(f"select {', '.join(SAMPLE_SPEC.varlist)} from sample"))
def q_x_y_split(spark, sf):
    return prep.x_y_split(sample_view(spark, sf), SAMPLE_SPEC)[0]


@register("is_num", O.with_sample(
    "select row_id, try_cast(num_text as double) is not null as is_num from sample where num_text is not null "
    "union all select row_id, null from sample where num_text is null"))
def q_is_num(spark, sf):
    return sample_view(spark, sf).select("row_id", is_num("num_text").alias("is_num"))


@register("location_split", O.with_sample(
    "select row_id, location, string_split(location, ',')[1] as location_prov, "
    "string_split(location, ',')[2] as location_city from sample"))
def q_location_split(spark, sf):
    return prep.location_split(sample_view(spark, sf), cols=("location",)).select(
        "row_id", "location", "location_prov", "location_city")


@register("fill_constant", O.fill_constant_sql(0))
def q_fill_constant(spark, sf):
    return prep.fill_constant(_sample_dbl(spark, sf), 0)


@register("fill_mean", O.fill_mean_sql())
def q_fill_mean(spark, sf):
    cols = ["totalprice", "acctbal", "sparse_num"]
    out = prep.fill_mean(sample_view(spark, sf), cols=cols)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in cols])


@register("sparse_column_report", O.sparse_report_sql(0.5))
def q_sparse_column_report(spark, sf):
    return prep.sparse_column_report(_sample_dbl(spark, sf), 0.5)


@register("drop_sparse_columns", O.with_sample("select * exclude (sparse_num) replace (cast(balance as double) as balance) from sample"))
def q_drop_sparse_columns(spark, sf):
    return prep.drop_sparse_columns(_sample_dbl(spark, sf), 0.5)


@register("filter_class", O.with_sample("select row_id, sample, score, segment from sample where target = 1"))
def q_filter_class(spark, sf):
    return sample_view(spark, sf).where(F.col("target") == 1).select("row_id", "sample", "score", "segment")


# --- 2C sampling ---------------------------------------------------------------------------


@register("stratified_sample", O.stratified_sql(0.7, 0.7, 1))
def q_stratified_sample(spark, sf):
    return sampling.stratified_sample(sample_view(spark, sf), "target", "row_id", 0.7, 0.7, 1).select(
        "row_id", "target", "sample")


@register("dev_val_split", O.dev_val_split_sql(0.3, 1))
def q_dev_val_split(spark, sf):
    return sampling.dev_val_split(sample_view(spark, sf), "row_id", 0.3, 1).select("row_id", "split")


# --- 2D weight of evidence -----------------------------------------------------------------


CHAR = list(SAMPLE_SPEC.char)


def _build(spark, sf):
    return sample_view(spark, sf).where(F.col("sample").isin("dev", "val"))


def _round_cols(df, cols, d=10):
    return df.select(*[F.round(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("woe_map", O.woe_map_sql())
def q_woe_map(spark, sf):
    return W.woe_map(_build(spark, sf), CHAR, "target")


@register("woe_fit_transform", O.woe_apply_sql("sample = 'dev'", "s.sample = 'dev'"))
def q_woe_fit_transform(spark, sf):
    return W.woe_fit_transform(_dev(spark, sf), CHAR, "target").select("row_id", *CHAR)


@register("woe_fit_apply", O.woe_apply_sql("sample = 'dev'", "s.sample != 'dev'", fill=0.0))
def q_woe_fit_apply(spark, sf):
    s = sample_view(spark, sf)
    return W.woe_fit_apply(s.where(F.col("sample") == "dev"), s.where(F.col("sample") != "dev"), CHAR,
                           "target").select("row_id", *CHAR)


def _cat_stats(spark, sf, where_samples=("dev", "val")):
    s = sample_view(spark, sf).where(F.col("sample").isin(*where_samples))
    return W.category_stats(s, CHAR, "target")


@register("category_stats", O.category_stats_sql())
def q_category_stats(spark, sf):
    return _round_cols(_cat_stats(spark, sf), ["bad_ratio"])


@register("grouped_ks", O.grouped_ks_sql())
def q_grouped_ks(spark, sf):
    return W.grouped_ks(_cat_stats(spark, sf))


@register("grouped_iv", O.grouped_iv_sql())
def q_grouped_iv(spark, sf):
    return W.grouped_iv(_cat_stats(spark, sf))


@register("category_psi", O.category_psi_sql())
def q_category_psi(spark, sf):
    return W.category_psi(_cat_stats(spark, sf), _cat_stats(spark, sf, ("oft1",)))


@register("group_woe", O.group_woe_sql())
def q_group_woe(spark, sf):
    return W.group_woe(_cat_stats(spark, sf))


# --- 2D automatic stable grouping ------------------------------------------------------------


def _ag(spark, sf):
    return AG.auto_group(sample_view(spark, sf), CHAR, "target")


@register("quantile_regroup", O.autogroup_sql("select feature, n, level, idx, grp from lv"))
def q_quantile_regroup(spark, sf):
    return _ag(spark, sf).levels


@register("group_totals", O.autogroup_sql(
    "select feature, n, grp, good, bad, round(bad / (good + bad), 10) as bad_ratio from ng"))
def q_group_totals(spark, sf):
    return _round_cols(_ag(spark, sf).group_totals, ["bad_ratio"])


@register("offtime_apply", O.autogroup_sql("select period, feature, n, grp, good, bad from og"))
def q_offtime_apply(spark, sf):
    return _ag(spark, sf).off_groups


@register("offtime_rows", O.autogroup_sql(
    "select s.row_id, " + ", ".join(f"coalesce(m{i}.grp, 0) as {c}" for i, c in enumerate(CHAR)) + " from sample s "
    + " ".join(f"left join (select level, grp from final where feature = '{c}') m{i} on s.{c} = m{i}.level" for i, c in enumerate(CHAR))
    + " where s.sample in ('oft1', 'oft2', 'oft3')"))
def q_offtime_rows(spark, sf):
    s = sample_view(spark, sf)
    later = s.where(F.col("sample").isin("oft1", "oft2", "oft3"))
    return AG.offtime_apply(later, _ag(spark, sf).final_map, CHAR).select("row_id", *CHAR)


@register("trial_report", O.autogroup_sql("select * from rep2"))
def q_trial_report(spark, sf):
    return _ag(spark, sf).trial_report


@register("best_grouping", O.autogroup_sql("select * from best"))
def q_best_grouping(spark, sf):
    return _ag(spark, sf).best


@register("small_feature_path", O.autogroup_sql(
    "select feature, level, cast(idx as int) as grp, round(case when bad = 0 and good = 0 then -99.0 "
    "when bad = 0 then '-inf'::double when good = 0 then 'inf'::double "
    "else ln((bad / bb) / (good / gg)) end, 10) as woe from kw"))
def q_small_feature_path(spark, sf):
    return _ag(spark, sf).kept_map


@register("char_auto_woe", O.autogroup_sql("select * from final"))
def q_char_auto_woe(spark, sf):
    return _ag(spark, sf).final_map


# --- 2E profiling ----------------------------------------------------------------------------


NUMS = ["totalprice", "acctbal", "sparse_num", "score"]
NUM_FEATURES = list(SAMPLE_SPEC.num)


@register("profile_describe", O.describe_sql(NUMS))
def q_profile_describe(spark, sf):
    return P.describe(sample_view(spark, sf), NUMS)


@register("describe_report", O.describe_sql(NUM_FEATURES, (0.25, 0.5, 0.75), "where sample = 'dev'"))
def q_describe_report(spark, sf):
    return P.describe(_dev(spark, sf), NUM_FEATURES, (0.25, 0.5, 0.75))


@register("class_balance", O.class_balance_sql())
def q_class_balance(spark, sf):
    return P.class_balance(sample_view(spark, sf))


@register("crosstab_margins", O.crosstab_sql())
def q_crosstab_margins(spark, sf):
    return P.crosstab_margins(sample_view(spark, sf), CHAR)


@register("bivar_numeric", O.bivar_numeric_sql(NUM_FEATURES, ("sample",)))
def q_bivar_numeric(spark, sf):
    return P.bivar_numeric(sample_view(spark, sf), NUM_FEATURES, by=["sample"])


@register("bivar_categorical", O.bivar_categorical_sql(CHAR, ("sample",)))
def q_bivar_categorical(spark, sf):
    return P.bivar_categorical(sample_view(spark, sf), CHAR, by=["sample"])


@register("bivar_many", O.bivar_sql(CHAR, NUM_FEATURES, "quarter", "cast(row_id % 4 as int)"))
def q_bivar_many(spark, sf):
    s = sample_view(spark, sf).withColumn("quarter", (F.col("row_id") % 4).cast("int"))  # a number with few values
    return P.bivar(s, CHAR, [*NUM_FEATURES, "quarter"], by=["sample"])


@register("iv_ranking", O.iv_ranking_sql())
def q_iv_ranking(spark, sf):
    return W.iv_ranking(sample_view(spark, sf), CHAR, NUM_FEATURES, "target")


# --- 2G model fitting and scoring ------------------------------------------------------------


@register("robust_scale", O.with_sample(
    "select row_id, " + ", ".join(
        f"round((cast({c} as double) - (select quantile_cont({c}, 0.5) from sample where sample = 'dev')) / "
        f"(select case when q[2] - q[1] = 0 then 1 else q[2] - q[1] end from "
        f"(select quantile_cont({c}, [0.05, 0.95]) as q from sample where sample = 'dev')), 10) as {c}"
        for c in SAMPLE_SPEC.num) + " from sample where sample = 'dev'"))
def q_robust_scale(spark, sf):
    out = M.robust_scale_exact(_dev(spark, sf), NUM_FEATURES)
    return out.select("row_id", *[F.round(c, 10).alias(c) for c in NUM_FEATURES])


def _fitted(spark, sf):
    s = sample_view(spark, sf)
    return s, M.fit_model(s.where(F.col("sample") == "dev"), SAMPLE_SPEC)


@register("gbt_fit_eval")
def q_gbt_fit_eval(spark, sf):
    return M.gbt_fit_eval(sample_view(spark, sf), SAMPLE_SPEC)


@register("gbt_pipeline")
def q_gbt_pipeline(spark, sf):
    s, fitted = _fitted(spark, sf)
    prepared = M.prepare_features(s.where(F.col("sample") == "val"), fitted.woe_map, SAMPLE_SPEC)
    return fitted.model.transform(prepared).select("row_id", "prediction")


@register("score_rows")
def q_score_rows(spark, sf):
    s, fitted = _fitted(spark, sf)
    return M.score(fitted, s, SAMPLE_SPEC).select("row_id", "sample", "target", "model_score")


@register("feature_importance")
def q_feature_importance(spark, sf):
    _, fitted = _fitted(spark, sf)
    return M.feature_importance(fitted.model, SAMPLE_SPEC, fitted.features)


@register("model_report")
def q_model_report(spark, sf):
    tables = R.model_report(sample_view(spark, sf), SAMPLE_SPEC)
    return R.report_summary(tables)


@register("smote_oversample")
def q_smote_oversample(spark, sf):
    d = prep.fill_constant(_dev(spark, sf).select("row_id", "target", *NUM_FEATURES), 0)
    return smote(d, NUM_FEATURES, "target", "row_id", n=100, k=5, seed=1)


@register("smote_neighbours", O.neighbours_sql(SAMPLE_SPEC.num, 5))
def q_smote_neighbours(spark, sf):
    """The exact neighbours that SMOTE draws from: the different minority vectors of dev and their 5 nearest."""
    d = prep.fill_constant(_dev(spark, sf).where("target = 1").select("row_id", *NUM_FEATURES), 0)
    points = d.groupBy(*[F.col(c).cast("double").alias(c) for c in NUM_FEATURES]).agg(F.min("row_id").alias("pid"))
    near = knn(points, NUM_FEATURES, 5)
    return near.select("pid", "cid", F.round("d", 6).alias("d"), F.col("r").cast("int").alias("r"))


@register("gbt_first_split", O.first_split_sql(CHAR, SAMPLE_SPEC.num, 0.01, 0.01, 32))
def q_gbt_first_split(spark, sf):
    """First split of the penalised trees on dev: its feature, sums, gain and both leaves before the learning rate."""
    dev = _dev(spark, sf)
    inputs = [M.FEATURE_PREFIX + c for c in SAMPLE_SPEC.varlist]
    train = M.prepare_features(dev, W.woe_map(dev, CHAR, "target"), SAMPLE_SPEC).select(*inputs, "target")
    pipeline = M.gbt_pipeline(inputs, "target", n_estimators=1, max_depth=1, learning_rate=1.0)
    pipeline.fit(train)
    t = pipeline.trees.trees[0]
    row = (SAMPLE_SPEC.varlist[int(t.feature[0])], *(round(float(x), 6) for x in (t.gain[0], t.weight[1], t.weight[2], t.value[1], t.value[2])))
    return spark.createDataFrame([row], "feature string, gain double, curvature_left double, curvature_right double, leaf_left double, leaf_right double")


# --- 2A sources and sinks -------------------------------------------------------------------


SAMPLE_DDL = ("row_id bigint, sample string, target int, score double, balance double, totalprice double, "
              "acctbal double, sparse_num double, segment string, priority string, nation string, "
              "location string, segment_null string, num_text string")


@register("src_read_csv", O.sample_dbl_sql())
def q_src_read_csv(spark, sf):
    path = scratch_path(spark, "sample_csv")
    C.write_csv(_sample_dbl(spark, sf), path)
    return C.read_csv_sample(spark, path, SAMPLE_DDL)


@register("sink_table_export", O.sample_dbl_sql())
def q_sink_table_export(spark, sf):
    _sample_dbl(spark, sf).createOrReplaceTempView("scorelens_sample")
    path = scratch_path(spark, "export")
    C.export_table(spark, "scorelens_sample", path)
    return C.read_csv_sample(spark, path, SAMPLE_DDL)


@register("sink_reports", O.autogroup_sql(
    "select 'woe' as kind, feature, coalesce(level, 'null') as level, cast(woe as double) as value from final "
    "union all select 'group', feature, coalesce(level, 'null'), cast(grp as double) from final"))
def q_sink_reports(spark, sf):
    final = AG.auto_group(sample_view(spark, sf), CHAR, "target").final_map
    woe_json = C.mapping_json(final, "level", "woe").withColumn("kind", F.lit("woe"))
    grp_json = C.mapping_json(final, "level", "grp").withColumn("kind", F.lit("group"))
    path = scratch_path(spark, "maps")
    woe_json.unionByName(grp_json).write.mode("overwrite").json(path)
    back = spark.read.schema("feature string, mapping string, kind string").json(path)
    pairs = F.explode(F.from_json("mapping", "map<string,string>")).alias("level", "value")
    return back.select("kind", "feature", pairs).withColumn("value", F.col("value").cast("double"))


@register("sink_report_bundle", O.report_bundle_sql())
def q_sink_report_bundle(spark, sf):
    """Every number of every sheet, read back from the written bundle."""
    tables = R.score_report(sample_view(spark, sf), spec=SAMPLE_SPEC, materialize_input=True)
    tables["params"] = R.params_sheet(spark, M.DEFAULTS)
    locs = R.write_bundle(tables, scratch_path(spark, "bundle"))
    out = None
    for name, keys in O.SHEET_KEYS.items():
        part = R.sheet_values(spark.read.parquet(locs[name]), name, keys)
        out = part if out is None else out.unionByName(part)
    return out


# --- streaming: the score distribution kept up to date over a stream of orders ---------------


@register("stream_band_counts", O.band_counts_by_sample_sql(20))
def q_stream_band_counts(spark, sf):
    stream = sample_view(spark, sf, orders=ST.orders_stream(spark, sf))
    return ST.run_available(spark, ST.band_counts_stream(stream))
