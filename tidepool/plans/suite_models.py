"""Model queries (MLlib), fitted on the driver's tables. Trees with one split or none, scores and
round trips are checked against SQL; of the large learners, whose binning and random draws are the
engine's own, row counts and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import epochs, models, split
from tidepool.operators.features import assemble_features, fit_label_encoder, label_encode
from tidepool.plans.flagship import flagship_forecast
from tidepool.plans.suite import query, rounded, table
from tidepool.session import scratch_folder

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
# Boosting runs a job for every level of every tree, whatever the rows: its queries run so many rounds.
ROUNDS = {"n_estimators": 10}


def _params(name: str) -> dict:
    return ROUNDS if "learning_rate" in models.PARAMS[name] else {}


def _lineitem(spark, sf, target: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), *FEATURES, target)


def _regression_sides(spark, sf):
    df = _lineitem(spark, sf, "l_extendedprice")
    data, names, _ = assemble_features(df, "l_extendedprice", exclude=["row_id"])
    data = data.withColumnRenamed("l_extendedprice", "label")
    train, test = split.random_split(data, ["row_id"], 0.2, 42)
    return train, test, names


def _classification_sides(spark, sf):
    df = _lineitem(spark, sf, "l_returnflag")
    d = fit_label_encoder(df, "l_returnflag")
    enc = label_encode(df, d, out_col="label").drop("l_returnflag")
    data, names, _ = assemble_features(enc, "label", exclude=["row_id"])
    train, test = split.random_split(data, ["row_id"], 0.2, 42)
    return train, test, names, d.size


def _scored(pred: DataFrame) -> DataFrame:
    cols = [F.col("row_id"), F.col("label").cast("double").alias("y"), F.col("yhat")]
    if "probability" in pred.columns:
        cols.append(F.array_max("probability").alias("confidence"))
    return rounded(pred.select(*cols))


def _fit_predict_regression(name: str):
    def run(spark, sf):
        train, test, _ = _regression_sides(spark, sf)
        m = models.fit_model(train, name, _params(name), "regression")
        return _scored(models.predict(m, models.dealt(test)))
    return run


def _fit_predict_classification(name: str):
    def run(spark, sf):
        train, test, _, k = _classification_sides(spark, sf)
        m = models.fit_model(train, name, _params(name), "classification", n_classes=k)
        return _scored(models.predict(m, models.dealt(test)))
    return run


for _name in ("decision_tree_regressor", "random_forest_regressor", "gbt_regressor", "xgboost_regressor", "lightgbm_regressor"):
    query(f"model_{_name}")(_fit_predict_regression(_name))
for _name in ("decision_tree_classifier", "random_forest_classifier", "gbt_classifier", "xgboost_classifier", "lightgbm_classifier"):
    query(f"model_{_name}")(_fit_predict_classification(_name))


@query("model_mlp_classifier")
def q_mlp(spark, sf):
    train, test, _, k = _classification_sides(spark, sf)
    m = models.fit_model(train, "mlp_classifier", {}, "classification", n_classes=k)
    return _scored(models.predict(m, models.dealt(test)))


@query("model_epochs_regressor")
def q_epochs(spark, sf):
    """A network trained in epochs; a fifth of the training side decides which epoch's weights stay."""
    train, test, _ = _regression_sides(spark, sf)
    net = epochs.fit_epochs(train, ["row_id"], "regression", epochs=10, steps=2, rate=0.05)
    return _scored(net.predict(models.dealt(test)))


STUMP_FEATURES = ["l_linenumber", "l_discount", "l_tax"]  # few values each, so every threshold is tried


def _boost_stump_sql(rate: float, reg: float) -> str:
    """One round of one split: gradients of the squared error around the mean, leaves -G / (H + lambda)."""
    long = " union all ".join(f"select '{c}' as f, cast({c} as double) as v, l_extendedprice as y from lineitem" for c in STUMP_FEATURES)
    value = "case best.f " + " ".join(f"when '{c}' then {c}" for c in STUMP_FEATURES) + " end"
    return f"""
with m as (select avg(l_extendedprice) as base from lineitem),
g as (select f, v, count(*) as n, sum(m.base - y) as s from ({long}), m group by 1, 2),
c as (select f, v, sum(n) over w as nl, sum(s) over w as sl, sum(n) over (partition by f) as nt, sum(s) over (partition by f) as st
      from g window w as (partition by f order by v)),
best as (select f, v, sl / (nl + {reg}) as low, (st - sl) / (nt - nl + {reg}) as high from c where nl < nt
         order by sl * sl / (nl + {reg}) + (st - sl) * (st - sl) / (nt - nl + {reg}) desc, f limit 1)
select l_orderkey * 10 + l_linenumber as row_id, round(m.base - {rate} * case when {value} <= best.v then best.low else best.high end, 6) as yhat
from lineitem, best, m"""


def _boost_stump(name: str):
    def run(spark, sf):
        data = table(spark, sf, "lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
            F.array(*[F.col(c).cast("double") for c in STUMP_FEATURES]).alias("features"), F.col("l_extendedprice").alias("label"))
        return rounded(models.predict(models.fit_model(data, name, {"n_estimators": 1, "max_depth": 1}, "regression"), data).select("row_id", "yhat"))
    return run


query("boost_stump_levels", _boost_stump_sql(0.3, 1.0))(_boost_stump("xgboost_regressor"))
query("boost_stump_leaves", _boost_stump_sql(0.1, 0.0))(_boost_stump("lightgbm_regressor"))


@query("cross_validate_ridge", """
with r as (select l_quantity as x, l_extendedprice as y, row_number() over (order by md5(concat_ws(':', cast(l_orderkey as varchar), cast(l_linenumber as varchar), '42')),
                  l_orderkey, l_linenumber) - 1 as ri, count(*) over () as n from lineitem),
f as (select x, y, case when ri < (n % 5) * (n // 5 + 1) then ri // (n // 5 + 1) else n % 5 + (ri - (n % 5) * (n // 5 + 1)) // (n // 5) end as fold from r),
m as (select k.k as fold, avg(x) as mx, avg(y) as my, covar_pop(x, y) / var_pop(x) / 1.5 as w from range(0, 5) k(k), f where f.fold <> k.k group by 1)
select f.fold, round(1 - sum((y - my - w * (x - mx)) * (y - my - w * (x - mx))) / (var_pop(y) * count(*)), 6) as score
from f join m on m.fold = f.fold group by 1""")
def q_cross_validate_ridge(spark, sf):
    """One feature, where a ridge regression is a formula."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity").cast("double")).alias("features"),
                                             F.array(F.col("l_extendedprice").cast("double")).alias("y"))
    return rounded(models.cross_validate_ridge(li, ["l_orderkey", "l_linenumber"], 5, reg=0.5))


@query("linear_forecast")
def q_linear_forecast(spark, sf):
    return flagship_forecast(spark, sf)


@query("ridge", """
with m as (select avg(l_quantity) as mx, stddev_pop(l_quantity) as sx, avg(l_extendedprice) as my, avg(l_tax) as mt,
                  covar_pop(l_quantity, l_extendedprice) as cy, covar_pop(l_quantity, l_tax) as ct from lineitem)
select l_orderkey * 10 + l_linenumber as row_id, round(my + cy / sx / 1.5 * (l_quantity - mx) / sx, 6) as h0,
       round(mt + ct / sx / 1.5 * (l_quantity - mx) / sx, 6) as h1 from lineitem, m""")
def q_ridge(spark, sf):
    """Two targets on one feature, where the normal equations are a formula."""
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.array(F.col("l_quantity").cast("double")).alias("features"),
        F.array(F.col("l_extendedprice").cast("double"), F.col("l_tax").cast("double")).alias("y"))
    model = models.fit_ridge(li, reg=0.5)
    out = li.select("row_id", model.predict("features").alias("p"))
    return rounded(out.select("row_id", F.get("p", F.lit(0)).alias("h0"), F.get("p", F.lit(1)).alias("h1")))


# ------------------------------------------------------- trees that SQL can grow: one split, or none

def _stump_sql(select: str) -> str:
    """The split of the few-valued features that lowers the squared error of the price most."""
    long = " union all ".join(f"select '{c}' as f, cast({c} as double) as v, l_extendedprice as y from lineitem" for c in STUMP_FEATURES)
    value = "case best.f " + " ".join(f"when '{c}' then {c}" for c in STUMP_FEATURES) + " end"
    return f"""
with g as (select f, v, count(*) as n, sum(y) as s from ({long}) group by 1, 2),
c as (select f, v, sum(n) over w as nl, sum(s) over w as sl, sum(n) over (partition by f) as nt, sum(s) over (partition by f) as st
      from g window w as (partition by f order by v)),
gain as (select f, v, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) as score, sl / nl as low, (st - sl) / (nt - nl) as high from c where nl < nt),
best as (select * from gain order by score desc limit 1)
{select.format(value=value)}"""


def _stump(spark, sf) -> tuple[DataFrame, models.PipelineModel]:
    li = table(spark, sf, "lineitem")
    data = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
                     F.array(*[F.col(c).cast("double") for c in STUMP_FEATURES]).alias("features"), F.col("l_extendedprice").alias("label"))
    return data, models.fit_model(data, "decision_tree_regressor", {"max_depth": 1}, "regression")


@query("tree_stump", _stump_sql("""
select l_orderkey * 10 + l_linenumber as row_id, round(case when {value} <= best.v then best.low else best.high end, 6) as yhat
from lineitem, best"""))
def q_tree_stump(spark, sf):
    data, model = _stump(spark, sf)
    return rounded(models.predict(model, data).select("row_id", "yhat"))


@query("feature_importance", _stump_sql("select f.k as feature, case when f.k = best.f then 1.0::double else 0.0 end as importance "
                                        f"from best, unnest({STUMP_FEATURES}) f(k)"))
def q_feature_importance(spark, sf):
    _, model = _stump(spark, sf)
    return rounded(spark.createDataFrame(models.feature_importance(model, STUMP_FEATURES), "feature string, importance double"))


_FORMULA = "(c_acctbal * 0.9 + c_nationkey * 3)"
_ORDER_MD5 = "row_number() over (order by md5(concat_ws(':', cast({k} as varchar), '42')), {k}) - 1"


@query("train_test_scores", f"""
with r as (select c_acctbal as y, {_FORMULA} as yhat, {_ORDER_MD5.format(k='c_custkey')} as ri, count(*) over () as n from customer),
s as (select ri < ceil(n * 0.2::double) as test, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) as r2 from r group by 1)
select round(max(r2) filter (not test), 6) as train_r2, round(max(r2) filter (test), 6) as test_r2 from s""")
def q_train_test_scores(spark, sf):
    scored = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("label"),
                                                 (F.col("c_acctbal") * 0.9 + F.col("c_nationkey") * 3).alias("yhat"))
    train, test = split.random_split(scored, ["c_custkey"], 0.2, 42)
    s = models.train_test_scores(train, test, "regression")
    return rounded(spark.createDataFrame([(s["train_r2"], s["test_r2"])], "train_r2 double, test_r2 double"))


@query("save_load_model", "select cast(ceil(count(*) * 0.2::double) as bigint) as rows, cast(0 as bigint) as differing from lineitem")
def q_save_load_model(spark, sf):
    """Fit, save into the shared scratch folder, load back: both models must predict the same."""
    train, test, _ = _regression_sides(spark, sf)
    m = models.fit_model(train, "decision_tree_regressor", _params("decision_tree_regressor"), "regression")
    path = f"{scratch_folder(spark, 'models')}/tree"
    models.save_model(m, path)
    both = models.predict(models.load_model(path), models.predict(m, test).withColumnRenamed("yhat", "before").drop("prediction"))
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.col("yhat").eqNullSafe(F.col("before"))).alias("differing"))


@query("cross_validate", f"""
with r as (select o_totalprice as y, {_ORDER_MD5.format(k='o_orderkey')} as ri, count(*) over () as n from orders),
f as (select y, case when ri < (n % 5) * (n // 5 + 1) then ri // (n // 5 + 1) else n % 5 + (ri - (n % 5) * (n // 5 + 1)) // (n // 5) end as fold from r),
t as (select fold, sum(y) as s, count(*) as c from f group by 1),
m as (select a.fold, ((select sum(s) from t) - a.s) / ((select sum(c) from t) - a.c) as mean from t a)
select f.fold, round(1 - sum((y - mean) * (y - mean)) / (var_pop(y) * count(*)), 6) as score from f join m on m.fold = f.fold group by 1""")
def q_cross_validate(spark, sf):
    """A tree without a split predicts the training mean, so SQL can score each of the five folds."""
    data = table(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey").cast("double")).alias("features"), F.col("o_totalprice").alias("label"))
    return rounded(models.cross_validate(data, ["o_orderkey"], "decision_tree_regressor", {"max_depth": 0}, "regression", k=5))
