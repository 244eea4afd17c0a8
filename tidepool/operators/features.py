"""Encoding and feature assembly (#55-#59).

A label dictionary is the sorted distinct set of a column's values (null becomes the class
``nan``), coded 0..k-1 in code-point order. The dictionary is built distributed (distinct +
global index) and joined back; it is broadcast only when its bytes are below a checked bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import is_numeric_type, is_string_type
from tidepool.plans.order import join_group_stats, with_row_index

# The class name a null label takes (text of a missing value after str()).
NULL_LABEL = "nan"
# Largest dictionary we broadcast, in bytes of its labels and codes; larger ones get a salted join.
MAX_BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class LabelDictionary:
    column: str
    table: DataFrame  # (label string, code int)
    size: int
    n_bytes: int


def label_text(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.cast("string"), F.lit(NULL_LABEL))


def fit_label_encoder(df: DataFrame, column: str) -> LabelDictionary:
    labels = df.select(label_text(column).alias("label")).distinct()
    indexed, n = with_row_index(labels, ["label"], index_col="code")
    held = labels.agg(F.coalesce(F.sum(F.octet_length("label") + 16), F.lit(0))).first()[0]
    return LabelDictionary(column, indexed.select("label", F.col("code").cast("int").alias("code")), n, int(held))


def label_encode(df: DataFrame, dictionary: LabelDictionary, out_col: str | None = None) -> DataFrame:
    """Replace (or add as ``out_col``) the code of ``dictionary.column``; unseen labels → null."""
    c = dictionary.column
    out = out_col or c
    keyed = df.withColumn("_tp_label", label_text(c))
    d = dictionary.table.withColumnRenamed("label", "_tp_label").withColumnRenamed("code", "_tp_code")
    if dictionary.n_bytes <= MAX_BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(d), "_tp_label", "left")
    else:
        # large dictionary: salted left join, so a label carried by a third of the rows is split
        # over many tasks; labels unseen at fit time keep their row with a null code
        joined = join_group_stats(keyed, d, ["_tp_label"], how="left")
    cols = [F.col("_tp_code").alias(out) if x == out else F.col(x) for x in df.columns]
    if out not in df.columns:
        cols.append(F.col("_tp_code").alias(out))
    return joined.select(*cols)


def label_decode(df: DataFrame, dictionary: LabelDictionary, code_col: str, out_col: str) -> DataFrame:
    d = dictionary.table.withColumnRenamed("label", out_col).withColumnRenamed("code", "_tp_code")
    keyed = df.withColumn("_tp_code", F.col(code_col).cast("int"))
    if dictionary.n_bytes <= MAX_BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(d), "_tp_code", "left")
    else:  # salted left join: a frequent code does not land on one task
        joined = join_group_stats(keyed, d, ["_tp_code"], how="left")
    return joined.drop("_tp_code")


def infer_task(df: DataFrame, target: str) -> tuple[str, int]:
    """String target → classification with its number of classes; anything else → regression."""
    dt = df.schema[target].dataType
    if is_string_type(dt):
        n = df.select(label_text(target)).distinct().count()
        return "classification", n
    return "regression", 1


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns in table order; other types are dropped."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target or f.name in exclude:
            continue
        if is_numeric_type(f.dataType):
            num.append(f.name)
        elif is_string_type(f.dataType):
            cat.append(f.name)
    return num, cat


def assemble_features(
    df: DataFrame,
    target: str,
    exclude: Sequence[str] = (),
    out_col: str = "features",
    encoders: dict[str, LabelDictionary] | None = None,
) -> tuple[DataFrame, list[str], dict[str, LabelDictionary]]:
    """``features array<double>``: numerics in order, then label-encoded categoricals in order."""
    num, cat = feature_columns(df, target, exclude)
    encoders = dict(encoders or {})
    staged = df
    for c in cat:
        if c not in encoders:
            encoders[c] = fit_label_encoder(df, c)
        staged = label_encode(staged, encoders[c], out_col=f"_tp_enc_{c}")
    parts = [F.col(c).cast("double") for c in num] + [F.col(f"_tp_enc_{c}").cast("double") for c in cat]
    out = staged.withColumn(out_col, F.array(*parts)).drop(*[f"_tp_enc_{c}" for c in cat])
    return out, num + cat, encoders


def assemble_value_and_mark(
    df: DataFrame,
    target: str,
    mark_columns: Sequence[str],
    exclude: Sequence[str] = (),
    target_values: Column | None = None,
    encoders: dict[str, LabelDictionary] | None = None,
) -> tuple[DataFrame, list[str], int, dict[str, LabelDictionary]]:
    """Large pipeline: ``values`` (numeric non-mark columns, encoded categoricals, target last) and
    ``marks`` (the time encodings). Returns the value names and the target's index."""
    num, cat = feature_columns(df, target, exclude)
    value_num = [c for c in num if c not in mark_columns]
    marks = [c for c in num if c in mark_columns]
    encoders = dict(encoders or {})
    staged = df
    for c in cat:
        if c not in encoders:
            encoders[c] = fit_label_encoder(df, c)
        staged = label_encode(staged, encoders[c], out_col=f"_tp_enc_{c}")
    tv = target_values if target_values is not None else F.col(target).cast("double")
    values = [F.col(c).cast("double") for c in value_num] + [F.col(f"_tp_enc_{c}").cast("double") for c in cat] + [tv]
    out = staged.withColumn("values", F.array(*values)).withColumn(
        "marks", F.array(*[F.col(c).cast("double") for c in marks])
    ).drop(*[f"_tp_enc_{c}" for c in cat])
    names = value_num + cat + [target]
    return out, names, len(names) - 1, encoders
