from __future__ import annotations

import re

from stintflow.operators import metrics, ml
from stintflow.plans import detail_queries, ml_queries, roles, stint_queries


def test_laps_are_dealt_over_more_tasks_the_more_there_are(spark, sf, monkeypatch):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(roles, "LAPS_A_TASK", 100, raising=False)
    for query in (stint_queries.pit_flags, stint_queries.hot_lap_drops):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        shuffles = re.findall(r"Exchange hashpartitioning\(driver#\w+, season#\w+.*?, (\d+)\)", plan)
        assert shuffles == [str(-(-n // 100))]


def test_the_fit_reads_labels_that_are_computed_once(spark, sf, monkeypatch):
    seen, fit = [], ml.life_regressor
    monkeypatch.setattr(ml, "life_regressor", lambda train, *a, **k: seen.append(train.storageLevel.useMemory) or fit(train, *a, **k))
    assert ml_queries.feature_importance(spark, sf).count() == 6
    assert seen == [True]


def test_cliff_scores_are_predicted_once(spark, sf):
    plan = ml_queries.cliff_models(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "UDF" not in plan


def test_counted_scores_give_the_metrics_of_the_rows(spark):
    rows = spark.createDataFrame([(float(k % 3 == 0), (k * 7 % 11) / 11) for k in range(200)] + [(None, 0.5), (1.0, None)], "y double, p double")
    counted = metrics.scores_counted(rows, "y", "p")
    assert counted.count() < 40
    assert metrics.classification_metrics(counted, "y", "p", 0.5, "n").collect() == metrics.classification_metrics(rows, "y", "p", 0.5).collect()
    assert metrics.roc_auc(counted, "y", "p", "n").collect() == metrics.roc_auc(rows, "y", "p").collect()


def test_life_models_fits_each_model_once_and_scores_in_one_scan(spark, sf, monkeypatch):
    fits, fit = [], ml.GBTRegressor.fit
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, train: fits.append(train) or fit(self, train))
    got = ml_queries.life_models(spark, sf)
    assert len(fits) == 2
    assert sorted(r.model for r in got.collect()) == ["category", "constant", "late", "symmetric"]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scored_laps_labels_once_and_fits_each_model_once(spark, sf, monkeypatch):
    fits, fit = [], ml.GBTRegressor.fit
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, train: fits.append(train.storageLevel.useMemory) or fit(self, train))
    got = detail_queries.scored_laps(spark, sf)
    assert len(fits) == 2 and got.count() > 0
    assert "InMemoryTableScan" in got._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
