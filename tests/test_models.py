"""MLlib path: a small fit, persistence, and the fallback when no model loads."""


from tests.conftest import SF_SMALL
from wattline.operators import features, models
from wattline.sources import tables


def test_train_save_load(spark, tmp_path):
    daily = features.daily_features(tables.training_readings(spark, SF_SMALL))
    model, metrics, imps, names = models.train_kwh(daily, params={"maxIter": 3, "maxDepth": 3})
    m = metrics.first()
    assert m["n"] > 0 and m["rmse"] >= 0
    assert imps.count() == len(names)
    reg = models.save_models(spark, str(tmp_path), {"kwh_model": model}, {"kwh_model": names})
    assert reg.count() == 1
    loaded = models.load_model_or_fallback([str(tmp_path / "missing"), str(tmp_path / "kwh_model")])
    assert loaded is not None
    assert models.load_model_or_fallback([str(tmp_path / "missing")]) is None


def test_enhanced_features(spark):
    daily = features.daily_features(tables.training_readings(spark, SF_SMALL))
    _, metrics, imps, names = models.train_kwh(daily, enhanced=True, params={"maxIter": 2, "maxDepth": 3})
    m = metrics.first()
    assert names == features.ENHANCED_FEATURES and m["model"] == "enhanced" and m["n"] > 0 and 0 <= m["mae"] <= m["rmse"]
    top = models.top_features(imps, 10).collect()
    assert {r["feature"] for r in top} <= set(names) and abs(sum(r["importance"] for r in imps.collect()) - 1) < 1e-9


def test_damaged_model_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "kwh").mkdir()
    with pytest.raises(Exception):
        models.load_model_or_fallback([str(tmp_path / "kwh")])


def test_unseen_room_type_is_all_zero(spark):
    fit_on = spark.createDataFrame([("lab",), ("office",)], "room_type string")
    out = models.onehot_room_type(fit_on, spark.createDataFrame([("lab",), ("zzz",)], "room_type string"))
    got = {r["room_type"]: list(r["room_type_onehot"]) for r in out.collect()}
    assert got == {"lab": [1.0, 0.0], "zzz": [0.0, 0.0]}


def _planted(spark):
    """Daily rows whose energy follows room, month and weekday."""
    from pyspark.sql import functions as F

    d = features.daily_features(tables.training_readings(spark, SF_SMALL))
    return d.withColumn("energy_kwh", 5.0 + (F.col("room").cast("int") % 7) * 2 + F.col("month") * 0.5 + F.when(F.col("day_of_week") == 6, 0).otherwise(4))


def test_enhanced_model_beats_the_mean_and_travels_whole(spark, tmp_path):
    """Learned structure shows on the held-out split; a saved model predicts alike, unseen rooms included, and
    a model with other features, or in another order, is refused."""
    import pytest
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    daily = _planted(spark)
    path = str(tmp_path / "kwh")
    params = {"maxIter": 30, "maxDepth": 5, "stepSize": 0.3}
    model, metrics, imps, names = models.train_kwh(daily, enhanced=True, params=params)
    assert metrics.first()["r2"] > 0.8
    assert imps.orderBy(F.col("importance").desc()).first()["feature"] == "room_encoded"
    model.write().overwrite().save(path)
    loaded, again, _, _ = models.load_or_train_kwh(daily, path, enhanced=True)
    assert again.first() == metrics.first() and models.feature_order(loaded) == features.ENHANCED_FEATURES
    grid = spark.createDataFrame([("101", "2024-03-04"), ("999", "2024-03-05"), (None, "2024-03-06")], "room string, d string").select("room", F.to_date("d").alias("date"))
    rows = loaded.transform(models.grid_features(grid)).select("room", "room_encoded", "prediction").collect()
    code = {r["room"]: r["room_encoded"] for r in rows}
    known = len(model.stages[0].labels)
    assert code["999"] == code[None] == known and 0 <= code["101"] < known and all(r["prediction"] > 0 for r in rows)
    with pytest.raises(ValueError, match="features"):
        models.check_features(loaded, enhanced=False)
    swapped = PipelineModel(loaded.stages)
    assembler = next(s for s in swapped.stages if isinstance(s, VectorAssembler))
    assembler.setInputCols(list(reversed(features.ENHANCED_FEATURES)))
    with pytest.raises(ValueError, match="features"):
        models.check_features(swapped, enhanced=True)


def test_encoder_stage_equals_the_distributed_dictionary(spark):
    from pyspark.ml import Pipeline

    daily = features.daily_features(tables.training_readings(spark, SF_SMALL)).select("room", "date")
    a = Pipeline(stages=models.room_encoder()).fit(daily).transform(daily).select("room", "room_encoded").distinct()
    b = features.label_encode(daily.select("room").distinct(), "room", "room_encoded").select("room", "room_encoded")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_ranks_of_a_dictionary_in_many_blocks(spark):
    """Any text in binary order, common prefixes, more values than the sample; no window over the dictionary."""
    import random

    rnd = random.Random(3)
    values = {f"room-{i:05d}" for i in range(3000)} | {"".join(rnd.choice("aZé\U0001f600\uffee09") for _ in range(rnd.randint(0, 6))) for _ in range(500)}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = features.sorted_rank(df, "v", "n", blocks=16, sample=200)
    got = {r["v"]: r["n"] for r in out.collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=str.encode))}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    single = plan.split("Exchange SinglePartition")[1:]
    assert all("Aggregate" in s.splitlines()[1] + s.splitlines()[2] + s.splitlines()[3] for s in single), plan  # block totals alone
    unseen = features.label_encode(spark.createDataFrame([("b",), ("zz",), (None,)], "v string"), "v", "n", spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string"))
    assert {r["v"]: r["n"] for r in unseen.collect()} == {"b": 1, "zz": 2, None: 2}
    assert features.sorted_rank(df.limit(0), "v", "n").count() == 0


def _counted_readings(spark, monkeypatch):
    """Readings of a few rooms and months in place of the training view, with a counter of the rows read, and small models."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(3000, numPartitions=3).select(
        F.concat(F.lit("1"), F.lpad((1 + F.col("id") % 5).cast("string"), 2, "0")).alias("room"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("id") % 200, hours=F.col("id") % 24)).alias("ts"),
        ((F.col("id") % 50) / F.lit(3)).alias("energy_kwh"),
        F.when(F.col("id") % 3 == 0, F.lit("lab")).otherwise(F.lit("office")).alias("room_type"),
        F.lit(220.0).alias("voltage"), F.lit(1.5).alias("current"))

    def tap(r):
        seen.add(1)
        return r

    counted = spark.createDataFrame(rows.rdd.map(tap), T.StructType(rows.schema.fields))
    monkeypatch.setattr(tables, "training_readings", lambda s, d: counted)
    for name in ("BASIC_PARAMS", "ENHANCED_PARAMS"):
        monkeypatch.setattr(models, name, dict(getattr(models, name), maxIter=2, maxDepth=3))
    return seen, 3000


def test_a_model_query_reads_the_readings_once(spark, monkeypatch):
    """Fitting, evaluating, checking and the rooms and days to predict all start from one daily table."""
    from wattline.plans.catalog import QUERIES

    seen, n = _counted_readings(spark, monkeypatch)
    for i, name in enumerate(("kwh_model_check", "kwh_model_metrics", "top_features", "predict_range_model", "model_registry"), 1):
        out = QUERIES[name](spark, SF_SMALL).collect()
        assert seen.value == n * i, name
        if name == "kwh_model_check":
            assert out[0]["same_when_loaded"] == out[0]["top_in_order"] == 1 and out[0]["rooms"] == 5 and out[0]["n_importances"] == 14


def test_a_changed_training_table_is_another_model(spark, monkeypatch, tmp_path):
    """Rows, dates and energy alike, one room type changed: trained again, not loaded."""
    from pyspark.sql import functions as F

    from wattline.plans import catalog

    _counted_readings(spark, monkeypatch)
    monkeypatch.setattr(catalog, "_model_root", lambda s: str(tmp_path))
    daily = catalog._training_days(spark, SF_SMALL)
    for k, d in ((1, daily), (1, daily), (2, daily.withColumn("room_type", F.when(F.col("date") == "2024-02-01", F.lit("lecture")).otherwise(F.col("room_type"))))):
        catalog._kwh_model(spark, SF_SMALL, d)
        assert len(list(tmp_path.iterdir())) == k


def test_rooms_and_days_are_scored_once_for_all_series(spark, monkeypatch):
    from wattline.plans.catalog import QUERIES

    _counted_readings(spark, monkeypatch)
    out = QUERIES["predict_range_model"](spark, SF_SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    before_series = plan[plan.index("REPARTITION_BY_NUM"):]          # a plan is printed from its end
    assert "Generate explode(sequence" in before_series.split("Exchange", 1)[0]
    got = out.select("series", "room", "date", "total_daily_kwh").collect()
    series, days = {r["series"] for r in got}, {(r["room"], r["date"]) for r in got}
    assert len(series) > 1 and len(got) == len(series) * 5 * 200 and len(days) == 5 * 200
    assert len({(r["room"], r["date"], r["total_daily_kwh"]) for r in got}) == len(days)     # whatever the series


def test_trees_do_not_depend_on_the_node_cache(spark):
    """The same trees without node ids cached and checkpointed beside them."""
    from wattline.session import written

    daily = written(_planted(spark), "node-cache-test")
    fitted = [models.train_kwh(daily, enhanced=True, params={"maxIter": 12, "maxDepth": 3, **p})[0].stages[-1] for p in ({}, {"cacheNodeIds": True})]
    assert [m.getCacheNodeIds() for m in fitted] == [False, True]
    assert fitted[0].toDebugString.split("\n", 1)[1] == fitted[1].toDebugString.split("\n", 1)[1]
