"""Models: encoders, kWh regressor, persistence, model-or-fallback prediction
(SURVEY M1, M3-M5, K2, S11, S12, P4).

Training is MLlib (distributed): ``StringIndexer``/``OneHotEncoder`` for the
room type, ``VectorAssembler`` and ``GBTRegressor`` for daily kWh.  Boosted
trees here are not XGBoost (no second-order gain), so metrics — not
predictions — are what compares with the reference.  The split is the
deterministic hash split of M4.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cyclic, floor_of_room, room_type_from_prefix, week_of_month_factor, weekday_mon0
from . import features as feat

BASIC_FEATURES = ["year", "month", "day", "day_of_week", "is_weekend", "month_sin", "month_cos", "floor"]
BASIC_PARAMS = dict(maxIter=200, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
ENHANCED_PARAMS = dict(maxIter=300, maxDepth=7, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                       minInstancesPerNode=3, seed=42)
# The boosting state is checkpointed every 10 trees into the shared checkpoint folder: the lineage of a
# 200-300 tree fit stays short and survives executor loss.  A row's node is found by walking its tree (7 steps
# at most) instead of being kept in a cache that is written to files every few levels; the trees are the same.
RUNTIME_PARAMS = dict(cacheNodeIds=False, checkpointInterval=10)


def room_type_encoder() -> list:
    """M1 stages: categories in sorted order; an unseen category becomes all zeros
    (index k kept for unknowns, then dropped as the last slot)."""
    return [
        StringIndexer(inputCol="room_type", outputCol="room_type_idx", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["room_type_idx"], outputCols=["room_type_vec"], dropLast=True),
    ]


def room_encoder() -> list:
    """M2 as stages of a saved model: rooms in sorted order, an unseen or missing one gets the number of rooms.
    What a model was trained with is what it predicts with.  The code is a number to the trees, as in the
    reference, not a category (a category would need a bin for each room)."""
    return [
        StringIndexer(inputCol="room", outputCol="room_idx", handleInvalid="keep", stringOrderType="alphabetAsc"),
        SQLTransformer(statement="SELECT *, CAST(room_idx AS INT) AS room_encoded FROM __THIS__"),
    ]


def _split_rows(daily: DataFrame, enhanced: bool) -> tuple[DataFrame, list[str]]:
    """Training rows with features and split, and the features in the model's order."""
    if enhanced:
        return feat.enhanced_rows(daily), list(feat.ENHANCED_FEATURES)
    key = F.concat_ws("|", F.col("room"), F.date_format("date", "yyyy-MM-dd"))
    return daily.withColumn("split", feat.hash_split(key)), list(BASIC_FEATURES)


def feature_order(model: PipelineModel) -> list[str]:
    """The inputs of a fitted model in the order it was trained with."""
    return next(s.getInputCols() for s in model.stages if isinstance(s, VectorAssembler))


def check_features(model: PipelineModel, enhanced: bool) -> PipelineModel:
    """A loaded model whose features are not those that prediction builds, in that order, is an error."""
    want = list(feat.ENHANCED_FEATURES) if enhanced else [*BASIC_FEATURES, "room_type_vec"]
    if feature_order(model) != want:
        raise ValueError(f"the model was trained with the features {feature_order(model)}, not {want}")
    return model


def onehot_room_type(fit_on: DataFrame, apply_to: DataFrame) -> DataFrame:
    """M1 as a table: index and one-hot array of ``room_type``."""
    model = Pipeline(stages=room_type_encoder()).fit(fit_on.select("room_type"))
    out = model.transform(apply_to)
    return out.withColumn("room_type_onehot", vector_to_array("room_type_vec")).drop("room_type_vec")


def train_kwh(daily: DataFrame, enhanced: bool = False, params: dict | None = None):
    """M5: fit the daily-kWh regressor on the 'train' split.

    Returns (PipelineModel, metrics DataFrame, importances DataFrame, feature names).
    """
    data, cols = _split_rows(daily, enhanced)
    stages = room_encoder() if enhanced else room_type_encoder()
    p = dict(ENHANCED_PARAMS if enhanced else BASIC_PARAMS)
    p.update(RUNTIME_PARAMS)
    p.update(params or {})
    from ..session import checkpoint_dir

    checkpoint_dir(daily.sparkSession)
    data = data.fillna(0, subset=[c for c in cols if c in data.columns])
    vec_inputs = cols + ([] if enhanced else ["room_type_vec"])
    stages = stages + [
        VectorAssembler(inputCols=vec_inputs, outputCol="features", handleInvalid="keep"),
        GBTRegressor(featuresCol="features", labelCol="energy_kwh", predictionCol="prediction", **p),
    ]
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    model = Pipeline(stages=stages).fit(train)
    scored = model.transform(test)
    metrics = feat.regression_metrics(scored, "energy_kwh", "prediction").withColumn(
        "model", F.lit("enhanced" if enhanced else "basic"))
    names = cols + ([] if enhanced else _onehot_names(model))
    imps = model.stages[-1].featureImportances.toArray().tolist()
    spark = daily.sparkSession
    imp_df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imps)], "feature string, importance double")
    return model, metrics, imp_df, names


def evaluate_kwh(model: PipelineModel, daily: DataFrame, enhanced: bool = False):
    """Metrics and importances of a fitted (or loaded) kWh model on the 'test' split."""
    data, cols = _split_rows(daily, enhanced)
    data = data.fillna(0, subset=[c for c in cols if c in data.columns])
    scored = model.transform(data.where(F.col("split") == "test"))
    metrics = feat.regression_metrics(scored, "energy_kwh", "prediction").withColumn(
        "model", F.lit("enhanced" if enhanced else "basic"))
    names = cols + ([] if enhanced else _onehot_names(model))
    imps = model.stages[-1].featureImportances.toArray().tolist()
    imp_df = daily.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, imps)],
                                                "feature string, importance double")
    return metrics, imp_df, names


def load_or_train_kwh(daily: DataFrame, path: str, enhanced: bool = False):
    """S12 + M5: load the model saved at ``path``, else train and save it there.

    Returns (model, metrics, importances, feature names)."""
    model = load_model_or_fallback([path])
    if model is None:
        model, _, _, _ = train_kwh(daily, enhanced)
        model.write().overwrite().save(path)
    check_features(model, enhanced)
    metrics, imp_df, names = evaluate_kwh(model, daily, enhanced)
    return model, metrics, imp_df, names


def _onehot_names(model: PipelineModel) -> list[str]:
    labels = model.stages[0].labels
    return [f"room_type_{x}" for x in labels]  # k slots (the unknown slot is dropped)


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    """K2: the ``k`` most important features (ties by name)."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


# --- S11 / S12: persistence ------------------------------------------------------

def save_models(spark: SparkSession, base_path: str, models: dict[str, PipelineModel], features: dict[str, list[str]],
                version: str = "1.0", description: str = "Energy prediction models for rooms 1xx and 7xx",
                tables: dict[str, DataFrame] | None = None, trained_at: _dt.datetime | None = None) -> DataFrame:
    """Save each model (MLlib persistence), each table of the bundle (the rate model's
    fit, encoder, rules: Parquet) and a registry table next to them.

    ``trained_at`` is given by the caller (null if not): no hidden clock."""
    now = trained_at
    rows = []
    for name, t in (tables or {}).items():
        path = f"{base_path.rstrip('/')}/{name}"
        t.write.mode("overwrite").parquet(path)
        rows.append((name, version, now, description, json.dumps(t.columns), path))
    for name, m in models.items():
        path = f"{base_path.rstrip('/')}/{name}"
        m.write().overwrite().save(path)
        rows.append((name, version, now, description, json.dumps(features.get(name, [])), path))
    reg = spark.createDataFrame(rows, "model string, version string, trained_at timestamp, description string, "
                                      "features string, path string")
    reg.write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/registry")
    return reg


def load_model_or_fallback(paths: list[str]) -> PipelineModel | None:
    """The model at the first path that exists, else None (callers use the P3 formula).

    A path that exists but cannot be read is an error: a damaged model is not replaced silently."""
    spark = SparkSession.active()
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return PipelineModel.load(p)
    return None


# --- P4 with a model ---------------------------------------------------------------

def grid_features(grid: DataFrame) -> DataFrame:
    """Prediction-time features for (room, date) rows (weekdays), as the predictor builds them; the room's
    code and type are encoded by the model's own stages."""
    d = F.col("date")
    msin, mcos = cyclic(F.month(d), 12)
    dsin, dcos = cyclic(F.dayofmonth(d), 31)
    rt = room_type_from_prefix(F.col("room"))
    return grid.withColumns({
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "day_of_week": weekday_mon0(d),
        "is_weekend": F.lit(0), "month_sin": F.round(msin, 10), "month_cos": F.round(mcos, 10),
        "day_sin": F.round(dsin, 10), "day_cos": F.round(dcos, 10), "quarter": F.quarter(d), "is_holiday": F.lit(0),
        "floor": floor_of_room(F.col("room")), "room_type_numeric": F.when(rt == "lab", 1).otherwise(0),
        "room_type": rt,
    })


def model_kwh_e4(prediction: Column) -> Column:
    """max(0, prediction) x the model path's week-of-month factor, in 1e-4 kWh."""
    factor = week_of_month_factor(F.dayofmonth("date"))
    return F.round(F.greatest(prediction, F.lit(0.0)) * factor * 10000).cast("long")
