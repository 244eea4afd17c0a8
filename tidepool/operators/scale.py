"""Scaling (#39-#49). Statistics are fitted on train with one aggregation and applied as literals.

* ``minmax``: (x - min) / (max - min), a zero range becomes 1.
* ``mean``: (x - mean) / population std, a zero std becomes 1.
* windowed statistics weight each row by the number of windows covering it (no explode).
* array scaling works on ``array<array<double>>`` windows with ``transform``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import FLOAT64_EPS
from tidepool.plans.order import ROW_INDEX, join_group_stats

# Variance guard of the per-window instance normaliser.
INSTANCE_NORM_EPS = 1e-5


@dataclass(frozen=True)
class ScalerParams:
    method: str | None
    columns: tuple[str, ...] = ()
    min: tuple[float, ...] = ()
    max: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    std: tuple[float, ...] = ()
    extra: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        d = {"method": self.method, "columns": list(self.columns)}
        if self.method == "minmax":
            d.update(min=list(self.min), max=list(self.max))
        elif self.method == "mean":
            d.update(mean=list(self.mean), std=list(self.std))
        return d

    def target(self, idx: int) -> ScalerParams:
        """The scaler of one column (the target's statistics taken from the feature scaler)."""
        if self.method == "minmax":
            return ScalerParams("minmax", (self.columns[idx],), (self.min[idx],), (self.max[idx],))
        if self.method == "mean":
            std = self.std[idx] or 1.0
            return ScalerParams("mean", (self.columns[idx],), mean=(self.mean[idx],), std=(std,))
        return ScalerParams(None)

    def offsets_and_denominators(self) -> tuple[list[float], list[float]]:
        if self.method == "minmax":
            # a column without values has no statistics: whatever it holds later is left as it is
            return [lo or 0.0 for lo in self.min], [1.0 if lo is None else (hi - lo) or 1.0 for lo, hi in zip(self.min, self.max)]
        if self.method == "mean":
            return [m or 0.0 for m in self.mean], [s or 1.0 for s in self.std]
        return [0.0] * len(self.columns), [1.0] * len(self.columns)


def fit_scaler(train: DataFrame, columns: Sequence[str], method: str = "minmax") -> ScalerParams:
    """Train statistics for each column in one aggregation."""
    cols = list(columns)
    if method not in ("minmax", "mean"):
        raise ValueError(f"no scaler is called {method!r}")
    x = {c: F.col(c).cast("double") for c in cols}
    if method == "minmax":
        row = train.agg(*[F.min(x[c]).alias(f"lo{i}") for i, c in enumerate(cols)],
                        *[F.max(x[c]).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
        return ScalerParams("minmax", tuple(cols), tuple(row[f"lo{i}"] for i in range(len(cols))),
                            tuple(row[f"hi{i}"] for i in range(len(cols))))
    row = train.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return ScalerParams("mean", tuple(cols), mean=tuple(row[f"m{i}"] for i in range(len(cols))),
                        std=tuple(row[f"s{i}"] for i in range(len(cols))))


def scaled(c: str | Column, offset: float, denom: float) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (x - F.lit(float(offset))) / F.lit(float(denom) if denom != 0 else 1.0)


def unscaled(c: str | Column, offset: float, denom: float) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return x * F.lit(float(denom)) + F.lit(float(offset))


def apply_scaler(df: DataFrame, params: ScalerParams, columns: Sequence[str] | None = None) -> DataFrame:
    """Row-local scaling of the fitted columns (also valid on a streaming DataFrame)."""
    if params.method is None:
        return df
    names = list(columns) if columns is not None else list(params.columns)
    off, den = params.offsets_and_denominators()
    mapping = {n: (off[i], den[i]) for i, n in enumerate(names)}
    return df.select(*[scaled(c, *mapping[c]).alias(c) if c in mapping else F.col(c) for c in df.columns])


def inverse_scaler(df: DataFrame, params: ScalerParams, columns: Sequence[str] | None = None) -> DataFrame:
    if params.method is None:
        return df
    names = list(columns) if columns is not None else list(params.columns)
    off, den = params.offsets_and_denominators()
    mapping = {n: (off[i], den[i]) for i, n in enumerate(names)}
    return df.select(*[unscaled(c, *mapping[c]).alias(c) if c in mapping else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ windowed statistics

def coverage_weight(i: Column, n: int, seq_len: int, pred_len: int, part: str = "x") -> Column:
    """Number of sliding windows whose ``x`` (or ``y``) covers row ``i`` (0-based)."""
    W = n - seq_len - pred_len + 1
    if part == "x":
        hi = F.least(i, F.lit(W - 1))
        lo = F.greatest(F.lit(0), i - F.lit(seq_len - 1))
    else:
        hi = F.least(i - F.lit(seq_len), F.lit(W - 1))
        lo = F.greatest(F.lit(0), i - F.lit(seq_len + pred_len - 1))
    return F.greatest(F.lit(0), hi - lo + 1)


def fit_scaler_windowed(
    indexed: DataFrame,
    columns: Sequence[str],
    n: int,
    seq_len: int,
    pred_len: int,
    method: str = "minmax",
    index_col: str = ROW_INDEX,
    part: str = "x",
) -> ScalerParams:
    """Statistics of the flattened window tensor without materialising it (weights = coverage)."""
    cols = list(columns)
    w = coverage_weight(F.col(index_col), n, seq_len, pred_len, part).cast("double")
    data = indexed.select(w.alias("_w"), *[F.col(c).cast("double").alias(c) for c in cols]).where(F.col("_w") > 0)
    if method == "minmax":
        row = data.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                       *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
        return ScalerParams("minmax", tuple(cols), tuple(row[f"lo{i}"] for i in range(len(cols))),
                            tuple(row[f"hi{i}"] for i in range(len(cols))))
    if method != "mean":
        raise ValueError(f"no scaler is called {method!r}")
    m = data.agg(F.sum("_w").alias("sw"), *[F.sum(F.col("_w") * F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    sw = m["sw"]
    if not sw:
        return ScalerParams("mean", tuple(cols), mean=(None,) * len(cols), std=(None,) * len(cols))
    means = [(m[f"m{i}"] or 0.0) / sw for i in range(len(cols))]
    v = data.agg(*[F.sum(F.col("_w") * (F.col(c) - F.lit(means[i])) ** 2).alias(f"v{i}")
                   for i, c in enumerate(cols)]).first()
    stds = [((v[f"v{i}"] or 0.0) / sw) ** 0.5 for i in range(len(cols))]
    return ScalerParams("mean", tuple(cols), mean=tuple(means), std=tuple(stds))


def scale_array_column(c: str | Column, offsets: Sequence[float], denoms: Sequence[float], inverse: bool = False,
                       keep_zero_rows_from: int | None = None) -> Column:
    """Last-axis scaling of an ``array<array<double>>`` window column.

    ``keep_zero_rows_from``: rows at or after this position are left as they are (decoder
    placeholders left at 0 instead of being scaled).
    """
    x = F.col(c) if isinstance(c, str) else c
    off = F.array(*[F.lit(float(o)) for o in offsets])
    den = F.array(*[F.lit(float(d) if d != 0 else 1.0) for d in denoms])

    def row_fn(row, pos):
        def cell(v, j):
            o, d = F.element_at(off, j + 1), F.element_at(den, j + 1)
            return v * d + o if inverse else (v - o) / d
        scaled_row = F.transform(row, cell)
        if keep_zero_rows_from is None:
            return scaled_row
        return F.when(pos >= F.lit(keep_zero_rows_from), row).otherwise(scaled_row)

    return F.transform(x, row_fn)


def scale_vector_column(c: str | Column, offset: float, denom: float, inverse: bool = False) -> Column:
    """Scaling of a 1-D ``array<double>`` (e.g. the ``y`` horizon) with one offset/denominator."""
    x = F.col(c) if isinstance(c, str) else c
    d = float(denom) if denom != 0 else 1.0
    if inverse:
        return F.transform(x, lambda v: v * F.lit(d) + F.lit(float(offset)))
    return F.transform(x, lambda v: (v - F.lit(float(offset))) / F.lit(d))


# ------------------------------------------------------------------ target scaling

def fit_target_scaler(train: DataFrame, target: str, method: str | None = "mean",
                      feature_params: ScalerParams | None = None, target_idx: int | None = None) -> ScalerParams:
    """Own statistics of the target, or the feature scaler's at ``target_idx`` when given."""
    if method is None or method == "none":
        return ScalerParams(None)
    if feature_params is not None and target_idx is not None:
        if feature_params.method != method:
            return ScalerParams(None)
        return feature_params.target(target_idx)
    return fit_scaler(train, [target], method)


def target_policy(pipeline: str, normalization: str | None, task_type: str, model_scales_itself: bool = False) -> str | None:
    """Which target scaling the reference applies: regression only; the small pipeline always
    scales (z-score when features are not normalised); the large one follows the feature method."""
    if task_type != "regression" or model_scales_itself:
        return None
    norm = None if normalization in (None, "none") else normalization
    if pipeline == "large":
        return norm
    return norm or "mean"


def scale_target(df: DataFrame, params: ScalerParams, target: str) -> DataFrame:
    if params.method is None:
        return df
    off, den = params.offsets_and_denominators()
    return df.withColumn(target, scaled(target, off[0], den[0]))


def unscale_target(df: DataFrame, params: ScalerParams | None, columns: Sequence[str]) -> DataFrame:
    """Inverse target scaling of scalar or array columns; no scaler = identity."""
    if params is None or params.method is None:
        return df
    off, den = params.offsets_and_denominators()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = df
    for c in columns:
        if types[c].startswith("array"):
            out = out.withColumn(c, scale_vector_column(c, off[0], den[0], inverse=True))
        else:
            out = out.withColumn(c, unscaled(c, off[0], den[0]))
    return out


def scale_decoder_input(df: DataFrame, params: ScalerParams, column: str = "dec_inp", label_len: int | None = None,
                        scale_placeholders: bool = True) -> DataFrame:
    """Feature scaler on decoder windows; by default the zero placeholders are scaled too."""
    off, den = params.offsets_and_denominators()
    keep_from = None if scale_placeholders else label_len
    return df.withColumn(column, scale_array_column(column, off, den, keep_zero_rows_from=keep_from))


# ------------------------------------------------------------------ loader normalisers

def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> tuple[DataFrame, ScalerParams]:
    """z-score (population std) fitted on ``fit_on`` (train border rows), applied to all rows."""
    params = fit_scaler(fit_on if fit_on is not None else df, columns, "mean")
    return apply_scaler(df, params), params


def inverse_standard_scale(df: DataFrame, params: ScalerParams) -> DataFrame:
    return inverse_scaler(df, params)


def series_normalize(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "standardization",
    series: Sequence[str] = (),
    stats: dict | None = None,
) -> tuple[DataFrame, dict]:
    """The loaders' normaliser.

    ``standardization``/``minmax``: whole-table statistics (sample std; float64 epsilon added to the
    denominator), reusable through ``stats``. ``per_sample_std``/``per_sample_minmax``: statistics per
    series, computed by an aggregate joined back (a hot series is split by AQE's skew join).
    """
    cols = list(columns)
    x = {c: F.col(c).cast("double") for c in cols}
    if method in ("standardization", "minmax"):
        if stats is None:
            if method == "standardization":
                row = df.agg(*[F.avg(x[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                             *[F.stddev_samp(x[c]).alias(f"b{i}") for i, c in enumerate(cols)]).first()
            else:
                row = df.agg(*[F.min(x[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                             *[F.max(x[c]).alias(f"b{i}") for i, c in enumerate(cols)]).first()
            stats = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}
        exprs = {}
        for c in cols:
            a, b = stats[c]
            if method == "standardization":
                exprs[c] = (x[c] - F.lit(a)) / (F.lit(b) + F.lit(FLOAT64_EPS))
            else:
                exprs[c] = (x[c] - F.lit(a)) / (F.lit(b - a) + F.lit(FLOAT64_EPS))
        return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns]), stats
    if method not in ("per_sample_std", "per_sample_minmax"):
        raise ValueError(f"no normaliser is called {method!r}")
    keys = list(series)
    if method == "per_sample_std":
        aggs = [F.avg(x[c]).alias(f"_a{i}") for i, c in enumerate(cols)] + \
               [F.stddev_samp(x[c]).alias(f"_b{i}") for i, c in enumerate(cols)]
    else:
        aggs = [F.min(x[c]).alias(f"_a{i}") for i, c in enumerate(cols)] + \
               [F.max(x[c]).alias(f"_b{i}") for i, c in enumerate(cols)]
    # per-series statistics (map-side combined) attached with a salted join: skew-safe
    st = df.groupBy(*keys).agg(*aggs)
    joined = join_group_stats(df, st, keys)
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
            v = F.col(c).cast("double")
            if method == "per_sample_std":
                out.append(F.try_divide(v - a, b).alias(c))  # a constant series: null
            else:
                out.append(((v - a) / (b - a + F.lit(FLOAT64_EPS))).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out), {}


def instance_normalize(df: DataFrame, c: str, out: str = "normed", means: str = "means", stds: str = "stds") -> DataFrame:
    """Per-window, per-channel normalisation of ``array<array<double>>`` (time × channel).

    Adds ``means`` and ``stds`` (sqrt(population variance + 1e-5)) and the normalised window. The
    statistics are projected as columns before they are used inside the element lambdas, so they
    are computed once per window, not once per element.
    """
    x = F.col(c)
    n = F.size(x).cast("double")
    chans = F.sequence(F.lit(1), F.size(F.element_at(x, 1)))
    step1 = df.withColumn(means, F.transform(
        chans, lambda j: F.aggregate(x, F.lit(0.0), lambda acc, r: acc + F.element_at(r, j)) / n))
    m = F.col(means)
    step2 = step1.withColumn(stds, F.transform(
        m, lambda mu, j: F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, r: acc + (F.element_at(r, j + 1) - mu) ** 2) / n
                                + F.lit(INSTANCE_NORM_EPS))))
    s = F.col(stds)
    return step2.withColumn(out, F.transform(x, lambda r: F.transform(
        r, lambda v, j: (v - F.element_at(m, j + 1)) / F.element_at(s, j + 1))))


def instance_denormalize(c: str | Column, means: str | Column, stds: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    m = F.col(means) if isinstance(means, str) else means
    s = F.col(stds) if isinstance(stds, str) else stds
    return F.transform(x, lambda r: F.transform(r, lambda v, j: v * F.element_at(s, j + 1) + F.element_at(m, j + 1)))
