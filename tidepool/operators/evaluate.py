"""Evaluation (#101-#113) over a scored DataFrame ``(row_id, y, yhat[, probability])``.

Metrics are single aggregations. The ROC curve aggregates to distinct scores first, then takes
running sums with ``with_prefix_sums`` (range partitions + per-partition offsets) — no
single-partition window even with millions of distinct scores.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.profile import histogram
from tidepool.plans.order import Desc, with_prefix_sums, with_row_index


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(mse, rmse, mae, r2); R² = 1 − SSE/SST with SST = 0 → 1 if SSE = 0 else 0.

    A pair with a null on either side counts nowhere; without pairs every metric is null."""
    e = _c(y).cast("double") - _c(yhat).cast("double")
    agg = df.where(_c(y).isNotNull() & _c(yhat).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("sse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.var_pop(_c(y).cast("double")) * F.count(F.lit(1))).alias("sst"),
    )
    return agg.select(
        F.try_divide("sse", "n").alias("mse"),
        F.sqrt(F.try_divide("sse", "n")).alias("rmse"),
        "mae",
        F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.col("sse") / F.col("sst")).alias("r2"),
    )


def per_horizon_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per horizon step of array columns: (h, n, mse, mae, r2)."""
    z = df.select(F.posexplode(F.arrays_zip(_c(y).alias("a"), _c(yhat).alias("b"))).alias("h", "p"))
    z = z.where(F.col("p.a").isNotNull() & F.col("p.b").isNotNull())
    e = F.col("p.a").cast("double") - F.col("p.b").cast("double")
    g = z.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
        (F.var_pop(F.col("p.a").cast("double")) * F.count(F.lit(1))).alias("sst"))
    return g.select(
        "h", "n", (F.col("sse") / F.col("n")).alias("mse"), "mae",
        F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.col("sse") / F.col("sst")).alias("r2"))


def regression_metrics_multi(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Multi-horizon: MSE/MAE pooled (= mean over horizons), R² = unweighted mean of per-horizon R²."""
    h = per_horizon_metrics(df, y, yhat)
    return h.agg(
        F.try_divide(F.sum(F.col("mse") * F.col("n")), F.sum("n")).alias("mse"),
        F.sqrt(F.try_divide(F.sum(F.col("mse") * F.col("n")), F.sum("n"))).alias("rmse"),
        F.try_divide(F.sum(F.col("mae") * F.col("n")), F.sum("n")).alias("mae"),
        F.avg("r2").alias("r2"),
    )


def accuracy(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.agg(F.avg(F.when(_c(y) == _c(yhat), 1.0).otherwise(0.0)).alias("accuracy"))


def confusion_counts(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Sparse long form (truth, pred, count) of the non-zero cells; totals n."""
    return df.groupBy(_c(y).alias("truth"), _c(yhat).alias("pred")).agg(F.count(F.lit(1)).alias("count"))


LABEL_RUN = 1024


def confusion_matrix(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(truth, pred, count) for every pair of labels that occur as truth or as prediction, zeros
    included: a row for each cell. Labels get numbers; each label's row of the matrix is spread over runs
    of numbers, which the labels are joined to, so no row or task holds all labels."""
    counts = confusion_counts(df, y, yhat)
    labels = counts.select(F.col("truth").alias("l")).union(counts.select("pred")).distinct()
    numbered, n = with_row_index(labels, ["l"], "_tp_at")
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1) // LABEL_RUN).cast("long"))).alias("_tp_run")
    across = numbered.groupBy(F.floor(F.col("_tp_at") / LABEL_RUN).alias("_tp_r")).agg(F.collect_list(F.struct("l")).alias("_tp_labels"))
    cells = numbered.select(F.col("l").alias("truth"), runs).join(across, F.col("_tp_run") == F.col("_tp_r")).select("truth", F.explode("_tp_labels").alias("_tp_l"))
    cells = cells.select("truth", F.col("_tp_l.l").alias("pred"))
    found = counts.select(F.col("truth").alias("t"), F.col("pred").alias("p"), "count")
    return (cells.join(found, cells["truth"].eqNullSafe(found["t"]) & cells["pred"].eqNullSafe(found["p"]), "left")
            .select("truth", "pred", F.coalesce("count", F.lit(0)).alias("count")))


def precision_recall_f1(df: DataFrame, y: str = "y", yhat: str = "yhat", n_truth_classes: int | None = None,
                        positive=1) -> DataFrame:
    """Binary (class ``positive``) when the truth has exactly 2 classes, else support-weighted;
    zero division gives 0."""
    cm = confusion_counts(df, y, yhat)
    if n_truth_classes is None:
        n_truth_classes = df.select(y).distinct().count()
    per_class = cm.select(F.explode(F.array(
        F.struct(F.col("truth").alias("c"), F.lit(0).alias("tp"), F.col("count").alias("true_n"), F.lit(0).alias("pred_n")),
        F.struct(F.col("pred").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("true_n"), F.col("count").alias("pred_n")),
        F.struct(F.col("truth").alias("c"), F.when(F.col("truth") == F.col("pred"), F.col("count")).otherwise(0).alias("tp"),
                 F.lit(0).alias("true_n"), F.lit(0).alias("pred_n")),
    )).alias("s")).groupBy(F.col("s.c").alias("c")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.true_n").alias("support"), F.sum("s.pred_n").alias("pred_n"))
    p = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    scored = per_class.select("c", "support", p.alias("p"), r.alias("r"))
    scored = scored.withColumn("f1", F.when(F.col("p") + F.col("r") > 0,
                                            2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    if n_truth_classes == 2:
        pos = scored.where(F.col("c") == F.lit(positive))
        # max over at most one row; an absent positive class gives 0
        return pos.agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("precision"),
                       F.coalesce(F.max("r"), F.lit(0.0)).alias("recall"),
                       F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1"))
    return scored.agg(
        (F.sum(F.col("p") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
    )


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (descending), plus the (inf, 0, 0) start.

    A rate without rows of its class is null."""
    by_score = df.groupBy(_c(score).cast("double").alias("threshold")).agg(
        F.sum(F.when(_c(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(_c(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    cum = with_prefix_sums(by_score, [Desc("threshold")], ["pos", "neg"])
    totals = by_score.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    curve = cum.select(
        "threshold",
        F.try_divide("neg_cum", F.lit(float(totals["N"] or 0))).alias("fpr"),
        F.try_divide("pos_cum", F.lit(float(totals["P"] or 0))).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"))
    return start.unionByName(curve.select("threshold", "fpr", "tpr"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Trapezoid area under the full ROC curve (ties handled as one step); null with one class only."""
    by_score = df.groupBy(_c(score).cast("double").alias("threshold")).agg(
        F.sum(F.when(_c(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(_c(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    cum = with_prefix_sums(by_score, [Desc("threshold")], ["pos", "neg"])
    # area of each step: width neg/N, mean height (2·tps − pos)/(2P)
    g = cum.agg(F.sum(F.col("neg").cast("double") * (F.col("pos_cum") * 2.0 - F.col("pos"))).alias("num"),
                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select(F.try_divide("num", F.lit(2.0) * F.col("P") * F.col("N")).alias("auc"))


def flatten_pairs(df: DataFrame, y: str = "y", yhat: str = "yhat", key: str = "row_id") -> DataFrame:
    """(row_id, h, y, yhat) with arrays flattened; scalars give h = 0."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if types.get(y, "").startswith("array"):
        z = df.select(key, F.posexplode(F.arrays_zip(F.col(y).alias("a"), F.col(yhat).alias("b"))).alias("h", "p"))
        return z.select(key, "h", F.col("p.a").cast("double").alias("y"), F.col("p.b").cast("double").alias("yhat"))
    return df.select(key, F.lit(0).alias("h"), F.col(y).cast("double").alias("y"), F.col(yhat).cast("double").alias("yhat"))


def residual_histogram(df: DataFrame, y: str = "y", yhat: str = "yhat", key: str = "row_id", bins: int = 30) -> DataFrame:
    pairs = flatten_pairs(df, y, yhat, key)
    return histogram(pairs.select((F.col("y") - F.col("yhat")).alias("residual")), ["residual"], bins)


def pred_vs_true(df: DataFrame, y: str = "y", yhat: str = "yhat", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Flattened pairs and the common (lo, hi) range over truth and prediction."""
    pairs = flatten_pairs(df, y, yhat, key)
    rng = pairs.agg(F.least(F.min("y"), F.min("yhat")).alias("lo"), F.greatest(F.max("y"), F.max("yhat")).alias("hi"))
    return pairs, rng


def pred_vs_true_line(df: DataFrame, y: str = "y", yhat: str = "yhat", key: str = "row_id") -> DataFrame:
    """First horizon step by sample index."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    first = (lambda c: F.element_at(c, 1)) if types.get(y, "").startswith("array") else (lambda c: c)
    return df.select(key, first(F.col(y)).cast("double").alias("y"), first(F.col(yhat)).cast("double").alias("yhat"))


def compare_models(scored: dict[str, DataFrame], key: str = "row_id", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Truth and each model's prediction per row (last horizon step): one column per model, in one
    grouped pass over all of them."""
    parts = []
    for name, df in scored.items():
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        last = (lambda c: F.element_at(c, -1)) if types.get(y, "").startswith("array") else (lambda c: c)
        parts.append(df.select(key, F.lit(name).alias("model"), last(F.col(y)).cast("double").alias("y"),
                               last(F.col(yhat)).cast("double").alias("yhat")))
    u = functools.reduce(DataFrame.unionByName, parts)
    return u.groupBy(key).agg(F.first("y", ignorenulls=True).alias("truth"),
                              *(F.first(F.when(F.col("model") == name, F.col("yhat")), ignorenulls=True).alias(name) for name in scored))


def compare_saved(loaders: dict[str, Callable[[], DataFrame]], key: str = "row_id", y: str = "y",
                  yhat: str = "yhat") -> tuple[DataFrame | None, dict[str, str]]:
    """(comparison of the models that load, name and reason of those that do not). ``loaders`` gives
    each model's scored rows; a missing file or an unreadable model is reported, not raised."""
    scored, failed = {}, {}
    for name, load in loaders.items():
        try:
            scored[name] = load()
        except (OSError, ValueError, LookupError, PySparkException, Py4JJavaError) as e:
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return (compare_models(scored, key, y, yhat) if scored else None), failed


def cv_summary(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """mean and population std of fold scores (unrounded inputs), rounded to 4."""
    return scores.agg(F.round(F.avg(score_col), 4).alias("mean"), F.round(F.stddev_pop(score_col), 4).alias("std"),
                      F.count(F.lit(1)).alias("folds"))


def training_history(history: DataFrame) -> DataFrame:
    """Final metrics rounded to 6 and the average epoch time rounded to 2 from a per-epoch table
    (epoch, train_loss, val_loss, train_metric, val_metric, seconds)."""
    last = history.agg(F.max_by(F.struct("train_loss", "val_loss", "train_metric", "val_metric"), "epoch").alias("l"),
                       F.avg("seconds").alias("avg_s"), F.count(F.lit(1)).alias("epochs"))
    return last.select(
        "epochs",
        F.round("l.train_loss", 6).alias("final_train_loss"), F.round("l.val_loss", 6).alias("final_val_loss"),
        F.round("l.train_metric", 6).alias("final_train_metric"), F.round("l.val_metric", 6).alias("final_val_metric"),
        F.round("avg_s", 2).alias("avg_epoch_seconds"),
    )


def prediction_rows(df: DataFrame, key: str = "row_id", limit: int | None = 100) -> DataFrame:
    """index, prediction, truth (and probabilities if present); the first ``limit`` for display."""
    cols = [c for c in (key, "yhat", "y", "yhat_label", "y_label", "probability") if c in df.columns]
    out = df.select(*cols)
    return out.orderBy(key).limit(limit) if limit else out
