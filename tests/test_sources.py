from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from stintflow.sources import readers as R
from stintflow.sources import sinks as K


def write(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


def test_nested_files_to_rows(spark, tmp_path):
    root = str(tmp_path)
    write(root, "2024/Monza/Race/VER/3_tel.json", {"tel": {"speed": [1, "2.5", "None"], "rpm": [10, 20], "dataKey": "x", "extra": [1, 2]}})
    write(root, "2024/Monza/Race/VER/laptimes.json", {"time": [90.5, "None"], "lap": [1, 2], "compound": ["SOFT", "SOFT"]})
    write(root, "2024/Monza/Race/weather.json", {"wT": [0, 1], "wR": [False, True], "wTT": [30.5, "x"]})
    write(root, "2023/Spa/Race/session_laptimes.json", {"time": [88.0], "lap": [1], "drv": ["HAM"]})
    write(root, "2023/Spa/Race/HAM/laptimes.json", {"time": [1.0], "lap": [1]})
    write(root, "2023/Spa/Race/drivers.json", {"drivers": [{"driver": "HAM", "team": "M"}]})
    write(root, "2024/Pre-Season Testing/Day 1/weather.json", {"wT": [0]})
    write(root, "2024/Monza/Race/bad.json", "{oops")
    files = R.session_keys(R.raw_files(spark, root))
    tel = R.telemetry(files).orderBy("place").collect()
    assert [(r.lap, r.speed, r.rpm, r.gear) for r in tel] == [(3, 1.0, 10.0, None), (3, 2.5, 20.0, None)]
    laps = {(r.gp, r.driver, r.lap): r.laptime for r in R.lap_times(files).collect()}
    assert laps == {("Monza", "VER", 1): 90.5, ("Monza", "VER", 2): None, ("Spa", "HAM", 1): 88.0}
    w = R.session_events(files, "weather").orderBy("place").collect()
    assert [(r.gp, r.wR, r.wTT) for r in w] == [("Monza", False, 30.5), ("Monza", True, None)]
    assert [r.driver for r in R.drivers(files).collect()] == ["HAM"]
    assert [(r.stage, r.type, r.season, r.gp, r.session, r.message) for r in R.bad_files(files).collect()] == [("parse", "not json", "2024", "Monza", "Race", "{oops")]
    assert R.problem_summary(R.bad_files(files)).first().n == 1
    assert {r.season for r in R.session_keys(R.raw_files(spark, root), years=["2023"]).collect()} == {"2023"}
    assert R.session_keys(R.raw_files(spark, root), limit=1).select("gp").distinct().count() == 1


def test_layers(spark, tmp_path):
    path = str(tmp_path / "layer")
    df = K.synthetic_laps(spark, 3000).withColumn("gp", F.lit("g")).withColumn("session", F.lit("Race"))
    K.write_layer(df, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("season=")) == ["season=2021", "season=2022", "season=2023"]
    K.write_layer(df.filter("season = '2022'").limit(10), path)
    back = R.season_scan(spark, path)
    assert back.count() == 3000 - df.filter("season = '2022'").count() + 10
    assert "season=2021" not in str(R.season_scan(spark, path, ["2022"]).inputFiles()) or R.season_scan(spark, path, ["2022"]).select("season").distinct().count() == 1
    assert K.covers(spark, path, ["2021"]) and not K.covers(spark, path, ["1999"]) and not K.covers(spark, path + "x", ["2021"])
    assert R.footprint(spark, path).first().n_files > 0
    assert K.synthetic_laps(spark, 500).repartition(5).exceptAll(K.synthetic_laps(spark, 500)).count() == 0


def test_checked_export_and_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    K.checked_export(spark.range(5), path, ["id"], 5)
    K.checked_export(spark.range(7), path, ["id"], 7)
    assert spark.read.parquet(path).count() == 7
    try:
        K.checked_export(spark.range(1), path, ["missing"])
        raise AssertionError
    except ValueError:
        assert spark.read.parquet(path).count() == 7
    line = K.to_json_lines(spark.createDataFrame([(1, None)], "b int, a string")).first().value
    assert line == '{"a":null,"b":1}'
    merged = K.replace_sessions(spark.createDataFrame([("r", 1), ("s", 2)], "k string, v int"), spark.createDataFrame([("s", 3)], "k string, v int"), ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == [("r", 1), ("s", 3)]
