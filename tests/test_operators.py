"""Operators on small frames with values worked out by hand."""

import json
import time
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from sunstride import cli
from sunstride.functions import capacity_factor, clear_sky_index, clip, clip_low, in_range, local_time, null_if_nan, one_hot, split_by_cuts, valid_power, zscore
from sunstride.operators import baselines, chain, forecast_windows, grid, impute, loader, metrics, models, networks, quality, scale, sequence, splits, stats, stored
from sunstride.sources import config, scans, sinks

T0 = datetime(2017, 6, 1, 7)


def minutes(n, start=T0, step=1, skip=()):
    return [start + timedelta(minutes=step * k) for k in range(n) if k not in skip]


def panel(spark, values, step=15, site=1, start=datetime(2019, 9, 29)):
    return spark.createDataFrame([(site, start + timedelta(minutes=step * k), v) for k, v in enumerate(values)], "site int, ts timestamp_ntz, y double")


def one(df):
    return [tuple(r) for r in df.collect()]


def test_nulls_survive_clipping(spark):
    d = spark.createDataFrame([(None,), (-1.0,), (3.0,), (9.0,)], "x double")
    assert one(d.select(clip_low("x"), clip("x", 0, 5), in_range("x", 0, 3), valid_power("x", F.lit(5.0)), capacity_factor("x", F.lit(5.0)))) == [
        (None, None, None, None, None), (0.0, 0.0, None, 0.0, 0.0), (3.0, 3.0, 3.0, 3.0, 0.6), (9.0, 5.0, None, None, None),
    ]


def test_nan_is_missing(spark):
    d = spark.createDataFrame([(float("nan"),), (2500.0,)], "irr double")
    cleaned = grid.clean(scans.without_nan(d).withColumns({"power": F.lit(1.0), "capacity": F.lit(2.0)}), ["irr"])
    assert [(r["irr"], r["irr_missing"], r["cf"]) for r in cleaned.collect()] == [(None, 1, 0.5), (None, 1, 0.5)]
    assert one(d.select(null_if_nan("irr")))[0] == (None,)


def test_calendar_fills_gaps_and_drops_rows_off_it(spark):
    ts = [T0, T0 + timedelta(minutes=45), T0 + timedelta(minutes=20)]
    d = spark.createDataFrame([(1, t, float(k), 10.0) for k, t in enumerate(ts)], "site int, ts timestamp_ntz, power double, capacity double")
    got = grid.regularise(d, "site", "ts", 15, ["capacity"]).orderBy("ts").collect()
    assert [(r["power"], r["capacity"]) for r in got] == [(0.0, 10.0), (None, 10.0), (None, 10.0), (1.0, 10.0)]
    assert one(grid.off_grid(d, "site", "ts")) == [(1, 1)]


def test_first_row_and_blocks(spark):
    d = spark.createDataFrame([(1, "b"), (0, "a"), (2, "c")], "o int, v string").withColumn("k", F.lit(1))
    assert [r["v"] for r in grid.first_rows(d, ["k"], ["o"]).collect()] == ["a"]
    p = panel(spark, [1.0] * 10).where(~F.minute("ts").isin(45))
    assert [r["block_rows"] for r in grid.blocks(p, "site", "ts", 15, 2).select("block", "block_rows").distinct().orderBy("block").collect()] == [3, 3, 2]


def test_fills(spark):
    p = panel(spark, [None, 1.0, None, None, None, None, None, 2.0])
    assert [r[0] for r in p.orderBy("ts").select(impute.bounded_ffill("y", ["site"], "ts", 4)).collect()] == [None, 1.0, 1.0, 1.0, 1.0, 1.0, None, 2.0]
    both = panel(spark, [1.0, None, 5.0]).union(panel(spark, [None, None, 7.0], site=2))
    filled = impute.fill_from_train(both, F.col("ts") < F.lit("2019-09-29 00:30:00").cast("timestamp_ntz"), "site", ["y"])
    assert sorted(r["y"] for r in filled.collect()) == [1.0, 1.0, 1.0, 1.0, 5.0, 7.0]
    with pytest.raises(Exception, match="no value for y"):
        impute.fill_from_train(panel(spark, [None, None]), F.lit(True), "site", ["y"]).collect()


def regional(spark):
    """200 rows of 15 minutes; cf is a thousandth of the row number."""
    p = panel(spark, [k / 1000 for k in range(200)]).withColumnRenamed("y", "cf")
    return p.withColumns({"cf_input": F.col("cf"), "split": split_by_cuts("ts", "2019-10-01", "2020-01-01")})


def test_target_is_one_step_later_and_decides_the_split(spark):
    t = sequence.tabular(regional(spark), "site", "ts", "cf", "cf_input").collect()
    assert t and all(r["target_ts"] - r["ts"] == timedelta(minutes=15) and abs(r["target_y"] - r["cf_input"] - 0.001) < 1e-12 for r in t)
    edge = next(r for r in t if r["target_ts"] == datetime(2019, 10, 1))
    assert edge["ts"] == datetime(2019, 9, 30, 23, 45) and edge["split"] == "val"


def test_nothing_later_enters_a_feature(spark):
    cut = datetime(2019, 9, 30, 12)
    other = regional(spark).withColumn("cf_input", F.when(F.col("ts") > F.lit(cut), F.lit(99.0)).otherwise(F.col("cf_input")))
    keep = ["ts", "cf_input", "cf_input_lag96", "roll96_mean", "roll4_std"]
    a, b = (sorted(one(sequence.tabular(d, "site", "ts", "cf", "cf_input").where(F.col("ts") <= F.lit(cut)).select(*keep))) for d in (regional(spark), other))
    assert a == b


def test_rolling_deviation_of_one_value_is_zero(spark):
    w = sequence.over(["site"], "ts")
    assert [r[0] for r in panel(spark, [3.0, 5.0]).select(sequence.rolling_std("y", 4, w)).collect()][0] == 0.0


def test_increments_restart_with_the_forecast_day(spark):
    start = datetime(2014, 1, 1, 22)
    p = panel(spark, [5.0, 7.0, 8.0, 2.0, 1.0, None, 4.0], 60, start=start)
    got = [r[0] for r in p.withColumn("d", sequence.deaccumulate("y", ["site"], "ts")).orderBy("ts").select("d").collect()]
    assert got == [5.0, 2.0, 1.0, 2.0, 0.0, None, 4.0]


def test_windows(spark):
    p = panel(spark, [float(k) for k in range(10)], 1440).withColumn("f", F.lit(1))
    s = sequence.sliding(p.withColumn("v", F.col("y")), ["f"], "ts", ["v"], "v", 4, 2)
    got = sorted((r["x_v"], r["y"]) for r in s.collect())
    assert len(got) == 10 - 4 - 2 + 1 and got[0] == ([0.0, 1.0, 2.0, 3.0], [4.0, 5.0])
    with pytest.raises(ValueError):
        sequence.seasonal_naive("y", 2, 3, Window.orderBy("ts"))
    with pytest.raises(Exception, match="missing values"):
        sequence.sliding(panel(spark, [1.0, None, 2.0]).withColumns({"f": F.lit(1), "v": F.col("y")}), ["f"], "ts", ["v"], "v", 1, 1).collect()


def test_revin_and_patches(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    r = sequence.revin(d, "x").withColumn("back", sequence.revin_inverse("x_norm")).collect()[0]
    assert r["back"] == pytest.approx([1, 2, 3, 4]) and r["revin_std"] == pytest.approx((1.25 + 1e-5) ** 0.5)
    assert one(d.select(sequence.patchify("x", 4, 2, 1))) == [([[1.0, 2.0], [2.0, 3.0], [3.0, 4.0]],)]
    assert sequence.positions(2, 2)[0] == [0.0, 1.0]


def test_ramp_only_over_exact_steps(spark):
    p = panel(spark, [1.0, 4.0, 9.0], 1).union(panel(spark, [20.0], start=datetime(2019, 9, 29, 0, 7)))
    w = Window.partitionBy("site").orderBy("ts")
    assert [r[0] for r in p.select(sequence.ramp("y", "ts", w)).collect()] == [None, 3.0, 5.0, None]


def store(spark, skip=()):
    rows = [("trainval", t, k, float(k)) for k, t in enumerate(minutes(40, skip=skip))]
    return spark.createDataFrame(rows, "grp string, ts timestamp_ntz, row_id long, value double")


@pytest.mark.parametrize("stride, want", [(1, {"rejected_missing_history": 15, "rejected_missing_target": 15, "valid": 10}), (2, {"rejected_stride": 20, "rejected_missing_history": 8, "rejected_missing_target": 7, "valid": 5})])
def test_window_counts_of_a_contiguous_day(spark, stride, want):
    days = spark.createDataFrame([(T0.date(), "train")], "date date, split string")
    index = forecast_windows.window_index(store(spark), days, 15, 1, 15, {"train": stride})
    assert {r["reason"]: r["n"] for r in forecast_windows.report(index).where("split IS NULL").collect()} == want
    v = forecast_windows.valid_windows(index).orderBy("sample_index").collect()
    assert all(r["history_rows"] == list(range(r["issue_row"] - 15, r["issue_row"] + 1)) and r["target_row"] == r["issue_row"] + 15 and r["target_time"] - r["issue_time"] == timedelta(minutes=15) for r in v)
    assert [r["sample_index"] for r in v] == list(range(len(v)))


def test_thinning_is_the_sequential_rule(spark):
    import random

    r = random.Random(3)
    t, times = T0, []
    for _ in range(300):
        t += timedelta(seconds=r.choice((20, 60, 61, 200, 900)))
        times.append(t)
    times += [times[-1] + timedelta(days=k, minutes=30 * j) for k in (1, 2, 5) for j in range(48)]  # runs over midnight, days without a row
    rows = [(g, x, 2 * k + j) for g in "ab" for k, x in enumerate(times) for j in range(r.choice((1, 2)))]  # equal times, the same numbers in both groups
    d = spark.createDataFrame(rows, "g string, ts timestamp_ntz, row_id long").repartition(3)
    for stride in (5, 45, 3000):
        got = sorted((x["g"], x["row_id"]) for x in forecast_windows.thinned(d, ["g"], "ts", F.lit(stride), "row_id").where("accepted").collect())
        want, last = [], {}
        for g, x, k in rows:
            if g not in last or x - last[g] >= timedelta(minutes=stride):
                want.append((g, k))
                last[g] = x
        assert got == want


def test_windows_of_groups_with_the_same_row_numbers(spark, monkeypatch):
    monkeypatch.setattr(forecast_windows, "_ROWS", 7)  # several stretches of ranks
    rows = [(g, t + timedelta(days=d), k, float(k)) for d, g in enumerate(("g0", "g1")) for k, t in enumerate(minutes(40))]
    days = spark.createDataFrame([((T0 + timedelta(days=d)).date(), "train") for d in (0, 1)], "date date, split string")
    index = forecast_windows.window_index(spark.createDataFrame(rows, "grp string, ts timestamp_ntz, row_id long, value double"), days, 15, 1, 15, {"train": 1})
    assert {r["reason"]: r["n"] for r in forecast_windows.report(index).where("split IS NULL").collect()} == {"rejected_missing_history": 30, "rejected_missing_target": 30, "valid": 20}
    v = forecast_windows.valid_windows(index).orderBy("sample_index").collect()
    assert [(r["grp"], r["issue_row"]) for r in v] == [(g, k) for g in ("g0", "g1") for k in range(15, 25)] and [r["sample_index"] for r in v] == list(range(20))
    assert all(len(r["history_rows"]) == 16 for r in v)
    assert scale.touched(index.where("reason = 'valid'")).count() == 2 * 35  # rows 0 to 24 and 30 to 39


def test_windows_do_not_cross_splits_or_gaps(spark):
    days = spark.createDataFrame([(T0.date(), "train")], "date date, split string")
    index = forecast_windows.window_index(store(spark, skip=(20, 21, 22)), days, 5, 1, 5, {"train": 1})
    # every row that a window needs must be there: issues at 5..14, 18 and 19 before the gap of 20..22, and 28..34 after it
    valid = {int((r["issue_time"] - T0).total_seconds() // 60) for r in index.where("reason = 'valid'").collect()}
    assert valid == {*range(5, 15), 18, 19, *range(28, 35)}
    two = spark.createDataFrame([(T0.date(), "train"), ((T0 + timedelta(days=1)).date(), "validation")], "date date, split string")
    late = spark.createDataFrame([("g", datetime(2017, 6, 1, 23, 30) + timedelta(minutes=k), k, 0.0) for k in range(60)], "grp string, ts timestamp_ntz, row_id long, value double")
    crossing = forecast_windows.window_index(late, two, 5, 1, 5, {"train": 1, "validation": 1}).where("reason = 'rejected_split_boundary'")
    assert sorted(r["issue_row"] for r in crossing.collect()) == [*range(25, 35)]
    with pytest.raises(ValueError):
        forecast_windows.window_index(store(spark), days, 15, 4, 15, {"train": 1})


def test_cuts_in_narrowed_stretches(spark, monkeypatch):
    monkeypatch.setattr(splits, "_SORTED", 5)
    monkeypatch.setattr(splits, "_STRETCHES", 3)
    times = [T0 + timedelta(seconds=k**3) for k in range(50)]
    d = spark.createDataFrame([(t,) for t in times * 2] + [(None,)], "ts timestamp_ntz")
    assert splits.cut_points(d, "ts", (0.1, 0.3, 0.6)) == [times[5], times[20]]


def test_quantiles_are_exact(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(stats, "_STRETCHES", 4)
    r = np.random.default_rng(5)
    sets = {"a": r.normal(size=101).round(1).tolist(), "b": [3.0], None: [1.0, 1.0, 1.0, 1e300, -1e300], "c": [None, float("nan")], "d": [7.0, 7.0]}
    d = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v double").repartition(3)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {x["k"]: x["q"] for x in stats.quantiles(d, "v", ["k"], wanted).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile(sets[k], wanted).tolist())
    assert stats.quantiles(d.where("k = 'a'"), "v", [], [0.5]).first()["q"] == pytest.approx([np.median(sets["a"])])


def test_cuts_truncate_in_floating_point(spark):
    d = spark.createDataFrame([(T0 + timedelta(days=k),) for k in range(100)], "ts timestamp_ntz")
    assert splits.cut_points(d, "ts", (0.29, 0.71)) == [T0 + timedelta(days=28)]
    parts = splits.time_split(d, (0.7, 0.15, 0.15)).groupBy("part").count()
    assert {r["part"]: r["count"] for r in parts.collect()} == {"0": 70, "1": 15, "2": 15}
    with pytest.raises(ValueError):
        splits.cut_points(d.limit(0), "ts", (0.5, 0.5))


def test_folds(spark):
    step = splits.Step(1)
    assert [step.after(datetime(2020, 1, 31)), step.after(step.after(datetime(2020, 1, 31)))] == [datetime(2020, 2, 29), datetime(2020, 3, 29)]
    day = splits.Step(time=timedelta(days=1))
    plan = splits.WalkForward(horizon=day, lookback=splits.Step(time=timedelta(days=2)), gap=day)
    got = plan.folds(T0, T0 + timedelta(days=6))
    assert [f[0] for f in got] == [0, 1, 2] and got[0][1:] == (T0, T0 + timedelta(days=2), T0 + timedelta(days=3), T0 + timedelta(days=4))
    d = spark.createDataFrame([(T0 + timedelta(hours=12 * k),) for k in range(13)], "ts timestamp_ntz")
    counts = splits.fold_counts(d, splits.fold_table(d, plan)).orderBy("fold").collect()
    assert [(r["n_train"], r["n_test"]) for r in counts] == [(4, 2), (4, 2), (4, 2)]


def test_day_splits(spark):
    days = spark.createDataFrame([(date(2017, 6, k),) for k in range(1, 11)], "date date")
    got = {r["date"].day: r["split"] for r in splits.day_holdout(days, 0.25, "date", F.col("date") < F.lit("2017-06-09").cast("date")).collect()}
    assert [d for d, s in got.items() if s == "validation"] and sorted(d for d, s in got.items() if s == "validation") == [7, 8] and got[9] == got[10] == "test"
    assert splits.holdout_sizes(10, 0.25) == 2 and splits.holdout_sizes(2, 0.99) == 1
    folds = splits.day_kfold(spark, [date(2017, 6, k) for k in range(1, 11)], 3).collect()
    assert sorted(r["date"].day for r in folds) == list(range(1, 11))


def test_manifest(spark, tmp_path):
    m = splits.Manifest(("2017-06-01",), ("2017-06-02",), ("2017-07-01",), params={"fraction": 0.1})
    assert m.overlap() == {"train_validation": 0, "train_test": 0, "validation_test": 0} and m.created_at
    m.save(str(tmp_path / "m.json"))
    assert splits.Manifest.load(str(tmp_path / "m.json")) == m and m.split_of("2017-06-02") == "validation" and m.split_of("x") is None
    assert m.table(spark).count() == 3
    for bad in ((("a", "a"), (), ()), (("a",), ("a",), ())):
        with pytest.raises(ValueError):
            splits.Manifest(*bad)


def test_monthly_scores(spark):
    rows = [(1, 10.0, datetime(2020, 1, 1, 0, 0), 0.0, 0.0), (1, 10.0, datetime(2020, 1, 1, 0, 15), 0.0, 2.0), (1, 10.0, datetime(2020, 1, 1, 0, 30), None, 2.0)]
    d = spark.createDataFrame(rows, "site int, capacity double, target_ts timestamp_ntz, y_true double, y_pred double")
    m = metrics.monthly_pooled(d)
    r = m.collect()[0]
    assert (r["n"], r["mae"], r["rmse"], r["acc_mae"], r["acc_rmse"]) == (2, 1.0, pytest.approx(2**0.5), 0.9, pytest.approx(1 - 2**0.5 / 10))
    assert {x["site"]: x["mean_monthly_acc_mae"] for x in metrics.mean_monthly(m).collect()} == {1: 0.9, None: 0.9}
    assert metrics.overall(d, 10.0).collect()[0]["rmse"] is None  # a missing value is not skipped
    with pytest.raises(Exception, match="capacity must be constant"):
        metrics.monthly_pooled(d.union(spark.createDataFrame([(1, 11.0, datetime(2020, 1, 2), 0.0, 0.0)], d.schema))).collect()
    with pytest.raises(ValueError):
        metrics.monthly_pooled(d.drop("y_pred"))


def test_scalers(spark, tmp_path):
    d = spark.createDataFrame([(v,) for v in (0.0, 5.0, 15.0, 29.5)], "x double")
    for s in (scale.Scaler(), scale.fit_capacity(30.1), scale.Scaler("standard", 12.0, 11.0)):
        s.save(str(tmp_path / "s.json"))
        s = scale.Scaler.load(str(tmp_path / "s.json"))
        assert [r[0] for r in d.select(s.inverse(s.apply(F.col("x")))).collect()] == pytest.approx([0.0, 5.0, 15.0, 29.5])
    with pytest.raises(ValueError):
        scale.rebuilt({"name": "none"})
    z = d.select(zscore("x", F.lit(1.0), F.lit(0.0)), clear_sky_index("x", F.lit(0.1)), local_time(F.lit(T0), 10)).first()
    assert z[0] == -1.0 and z[1] == 0.0 and z[2] == T0 + timedelta(hours=10)
    flat = scale.standardise(spark.createDataFrame([(1.0, True), (3.0, True), (9.0, False)], "x double, t boolean"), F.col("t"), ["x"])
    assert [r["x_z"] for r in flat.collect()] == [-1.0, 1.0, 7.0]


def test_curve_goes_round_the_day(spark):
    d = spark.createDataFrame([(0, 12.0)], "minute int, clear double")
    full = baselines.minutes_table(spark, 6).join(d, "minute", "left").na.fill(0.0)
    got = {r["minute"]: r["clear"] for r in baselines.smooth_circle(full, 2, 6).collect()}
    assert got == {0: 2.4, 1: 2.4, 2: 2.4, 3: 0.0, 4: 2.4, 5: 2.4}
    assert baselines.smooth_circle(full, 1, 6) is full


def test_curve_is_kept_and_climatology_in_sample(spark, tmp_path):
    curve = spark.createDataFrame([(k, float(k % 5)) for k in range(1440)], "minute int, clear double")
    baselines.save_curve(curve, str(tmp_path / "c.json"), quantile=0.95)
    back, about = baselines.load_curve(spark, str(tmp_path / "c.json"))
    assert one(back) == one(curve) and about == {"quantile": 0.95}
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (None, 9.0)], "hour int, y double")
    assert sorted((r["hour"], r["y_true"], r["y_pred"]) for r in baselines.in_sample_climatology(d, ["hour"], "y").collect()) == [(1, 1.0, 2.0), (1, 3.0, 2.0), (2, 5.0, 5.0)]


def test_feature_steps_go_in_order(spark):
    d = spark.createDataFrame([(T0, 3.0, 4.0, 1.0)], "ts timestamp_ntz, VAR165 double, VAR166 double, VAR169_dea double")
    r = chain.chained(d, [chain.wind(), chain.cyclic_time(), chain.local_calendar()]).first()
    assert r["wind_speed"] == 5.0 and r["hour"] == (T0 + timedelta(hours=10)).hour and r["is_daytime"] and -1 <= r["doy_cos"] <= 1
    with pytest.raises(ValueError):
        chain.chained(d, [chain.cyclic_time()])


def test_frames_keep_their_contract(spark):
    p = panel(spark, [float(k) for k in range(10)], 1440).withColumn("f", F.when(F.col("y") < 7, 0).otherwise(1))
    assert sequence.contiguous_frames(p, ["f"], ["y"], 4, 2).count() == 7
    for bad, text in ((lambda: sequence.contiguous_frames(p, ["f"], ["none"], 4, 2), "missing columns"), (lambda: sequence.contiguous_frames(p, ["f"], ["y"], 9, 9), "no frame"), (lambda: sequence.contiguous_frames(p.withColumn("y", F.when(F.col("y") != 3, F.col("y"))), ["f"], ["y"], 4, 2), "missing values")):
        with pytest.raises(Exception, match=text):
            bad()


def test_network_learns_and_keeps_its_best_weights(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (1200, 2))
    d = spark.createDataFrame([(float(a), float(b), float(np.maximum(a, 0) - b), 1.0) for a, b in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, target_y double, w double").repartition(3)
    n = networks.Network(["a", "b"], (16,), weight="w", epochs=25, rate=0.02, batch=32, patience=6).fit(d.where("a < 0.6 OR a IS NULL"), d.where("a >= 0.6"))
    assert min(n.losses) < 0.02 and n._loss(n._rows(d.where("a >= 0.6")), n.layers) == pytest.approx(min(n.losses))
    n.save(str(tmp_path / "n.json")), n.save(str(tmp_path / "last.json"), "last")
    back = networks.Network.load(str(tmp_path / "n.json"))
    p = back.predict(d)
    assert p.count() == 1200 and p.agg(F.avg(F.abs(F.col("y_pred") - F.col("target_y")))).first()[0] < 0.15
    with pytest.raises(ValueError):
        n.fit(d.limit(0), d)
    # the gradient against differences
    layers = networks.start([2, 3, 1], 1)
    y, w = r.normal(size=5), r.uniform(0.5, 1, 5)
    loss = lambda: float((w * (networks.forward(layers, x[:5])[-1][:, 0] - y) ** 2).sum() / w.sum())
    g = networks.gradients(layers, x[:5], y, w)
    before = loss()
    layers[0][0][0, 1] += 1e-6
    assert (loss() - before) / 1e-6 == pytest.approx(g[0][0][0, 1], abs=1e-4)


def test_reports(spark):
    t = spark.createDataFrame([(1, 0.1, "x", T0, [1]), (3, None, "y", None, [2]), (None, 0.3, "y", T0, None)], "a int, b double, c string, d timestamp_ntz, e array<int>")
    got = {r["name"]: tuple(r) for r in quality.schema_profile(t, "b").collect()}
    assert got["a"] == ("a", "int", 2, 2, "1", "3", 2.0, "feature") and got["b"] == ("b", "double", 2, 2, "0.1", "0.3", 0.2, "target")
    assert got["c"] == ("c", "string", 3, 2, None, None, None, "feature") and got["d"][3] == 1 and got["d"][4] == str(T0) and "e" not in got
    d = spark.createDataFrame([("g", T0 + timedelta(seconds=s), -1.0, k) for k, s in enumerate((0, 60, 60, 30, 200000))], "grp string, ts timestamp_ntz, value double, o int")
    r = quality.store_report(d, "grp", "ts", "value", ["o"]).collect()[0]
    assert (r["n_rows"], r["negatives"], r["duplicates"], r["non_monotonic"], r["gaps_over_minute"], r["gaps_over_day"], r["largest_gap_s"]) == (5, 5, 1, 1, 1, 1, 199970.0)
    h = stats.histogram(spark.createDataFrame([(0.0,), (10.0,), (5.0,)], "x double"), "x", 0.0, 10.0, 2)
    assert {r["bin"]: r["n"] for r in h.collect()} == {1: 1, 2: 2}
    assert list(one_hot("x", [2, 10], "site")) == ["site_10", "site_2"]
    assert one(quality.junk_counts(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), ["v"])) == [("v", 1)]
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert quality.join_parity(a, a, ["k"], "v").first()["agrees"] and not quality.join_parity(a, a.limit(1), ["k"], "v").first()["agrees"]


def test_models_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(float(k), float(k % 7), 2.0 * k + 1) for k in range(60)] + [(None, 1.0, 1.0)], "a double, b double, target_y double")
    m = models.Forecaster("linear", ["a", "b"], alpha=1e-6).fit(d)
    m.save(str(tmp_path / "m"))
    p = models.Forecaster("linear", ["a", "b"]).load(str(tmp_path / "m")).predict(d)
    assert p.count() == 60 and p.agg(F.max(F.abs(F.col("y_pred") - F.col("target_y")))).first()[0] < 1e-3
    with pytest.raises(ValueError):
        models.Forecaster("none", [])
    with pytest.raises(RuntimeError):
        models.Forecaster("rf", ["a"]).predict(d)
    x = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert one(models.mlp_predict(x, "x", [([[1.0], [-1.0]], [0.5]), ([[2.0]], [1.0])]).select("y_pred")) == [(1.0,)]
    assert models.cosine_rate(5, 10, 100, 1.0) == 0.5 and models.cosine_rate(100, 10, 100, 1.0) == pytest.approx(0.0)


def test_ridge_matches_its_closed_form(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x, y = r.normal(size=(50, 2)), r.normal(size=50)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, target_y double")
    got = models.Forecaster("linear", ["a", "b"], alpha=3.0).fit(d).model.stages[-1].coefficients.toArray()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert got == pytest.approx(np.linalg.solve(xc.T @ xc + 3.0 * np.eye(2), xc.T @ yc), abs=1e-8)


def test_scans(spark, tmp_path):
    (tmp_path / "a site 2 capacity-50MW.csv").write_text("Time(year),Total solar irradiance,Global horicontal,Air temperature,Power (MW)\n2019-01-01 00:00:00,1,2,<junk>,3\nbad,1,2,3,4\n")
    s = scans.stations(spark, [str(p) for p in tmp_path.glob("*.csv")], sites=[2])
    r = s.collect()
    assert len(r) == 1 and (r[0]["site"], r[0]["capacity"], r[0]["ghi"], r[0]["temp"], r[0]["dni"], r[0]["power"]) == (2, 50.0, 2.0, None, None, 3.0)
    with pytest.raises(ValueError):
        scans.stations(spark, [str(p) for p in tmp_path.glob("*.csv")], sites=[9])
    (tmp_path / "b site 3 capacity-30MW.csv").write_text("Time,Power\n2019-01-01 00:15:00,7\n2019-01-01 00:30:00,8\n")
    both = scans.stations(spark, [str(p) for p in tmp_path.glob("*.csv")]).orderBy("file_order", "row_order").collect()
    assert [(r["site"], r["capacity"], r["file_order"], r["power"]) for r in both] == [(2, 50.0, 0, 3.0), (3, 30.0, 1, 7.0), (3, 30.0, 1, 8.0)]
    cell = lambda at, v: f'<c r="{at}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{at}"><v>{v}</v></c>'
    sheet = "".join(f'<row r="{n}">' + "".join(cell(f"{c}{n}", v) for c, v in row.items()) + "</row>" for n, row in enumerate(({"A": 0, "B": 1, "C": 2}, {"A": "43466.010416666664", "B": "1.5", "C": "4"}, {"A": 3, "C": "5"}, {"C": "6"}), 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c site 4 capacity-20MW.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Time</t></si><si><t>Air tem</t><t>perature</t></si><si><t>Power (MW)</t></si><si><t>2019-01-01 00:30:00</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    found = scans.workbooks(spark, [str(tmp_path / "c site 4 capacity-20MW.xlsx")]).orderBy("row_order").collect()
    assert [(r["ts"], r["temp"], r["power"], r["site"], r["ghi"]) for r in found] == [(datetime(2019, 1, 1, 0, 15), 1.5, 4.0, 4, None), (datetime(2019, 1, 1, 0, 30), None, 5.0, 4, None)]
    (tmp_path / "d.txt").write_text("ZONEID,TIMESTAMP,POWER\n1,20130101 1:00,0.5\n")
    assert scans.day_ahead(spark, str(tmp_path / "d.txt")).first()["ts"] == datetime(2013, 1, 1, 1)
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"outputs": [{"text": ["XGB RMSE=0.10 MAE=0.05\n", "other\n"]}]}]}))
    assert one(scans.metrics_from_notebooks(spark, str(tmp_path / "n.ipynb"), ["XGB"])) == [("XGB", 0.1, 0.05)]
    with pytest.raises(ValueError):
        scans.metrics_from_notebooks(spark, str(tmp_path / "n.ipynb"), ["None"])
    (tmp_path / "r.ipynb").write_text(json.dumps({"cells": [{"source": []}, {"outputs": [{"text": ["XGB RMSE=0.10 MAE=0.05\n"]}, {"data": {"text/plain": ["'PV net RMSE=0.3 MAE=0.2'"]}}, {"text": ["XGB RMSE=0.20 MAE=0.15\n"]}]}]}))
    assert one(scans.metrics_from_notebooks(spark, str(tmp_path / "r.ipynb"), ["XGB", "PV net"])) == [("PV net", 0.3, 0.2), ("XGB", 0.2, 0.15)]
    weather = spark.createDataFrame([(T0, z, 0.1 * z, 1.0) for z in (1, 2, 3)], "ts timestamp_ntz, ZONE int, POWER double, VAR78 double")
    zones, every = scans.load_zones(weather, [1, 3], ["VAR78"])
    assert sorted(zones) == [1, 3] and zones[3].count() == 1 and every.count() == 2
    wrong = spark.createDataFrame([((bytearray(b"x"), None), datetime(2020, 1, 1), "1")], "image struct<bytes: binary, path: string>, time timestamp, pv string")
    wrong.write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(ValueError, match="other types"):
        scans.shards(spark, str(tmp_path / "wrong"), "test")
    (tmp_path / "p.json").write_text('{"tiny": {"trees": 2}}')
    assert models.preset("tiny", str(tmp_path / "p.json")) == {"trees": 2} and models.preset("fast")["trees"] == 5
    with pytest.raises(KeyError):
        models.preset("none")
    d = spark.createDataFrame([((bytearray(b"x"), None), datetime(2020, 1, 1), 1.0)], scans.SHARD)
    d.write.parquet(str(tmp_path / "shard"))
    rows = scans.shards(spark, str(tmp_path / "shard"), "test")
    assert rows.columns == ["grp", "file", "row_index", "time", "pv"] and scans.gather_rows(rows, rows.select("grp", "file", "row_index")).count() == 1


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"split": {"seed": null}, "scaler": "capacity"}')
    c = config.load(str(tmp_path / "c.json"))
    assert config.merged({"a": {"b": {}}, "data": {}, "split": 3}, {"a": {"b": {"c": 1}, "d": 2}, "data": {"x": None}, "split": {"y": 1}}) == {"a": {"b": {"c": 1}, "d": 2}, "data": {"x": None}, "split": 3}
    assert config.merged(None) == config.DEFAULTS and config.merged({"model": {"new": {"k": [1]}}, "scaler": {"deep": 1}})["scaler"] == {"deep": 1}
    assert c["split"]["seed"] is None and c["split"]["strategy"] == "holdout" and c["scaler"] == "capacity" and len(config.digest(c)) == 16


def test_sinks_and_command_line(spark, tmp_path):
    rows = [("trainval", T0 + timedelta(days=d, minutes=15 * k), d * 100 + k, float(k % 9)) for d in range(4) for k in range(40)]
    sinks.table(spark.createDataFrame(rows, "grp string, ts timestamp_ntz, row_id long, value double"), str(tmp_path / "store"), ("grp",))
    base = {"data": {"path": str(tmp_path / "store")}, "output": {"path": str(tmp_path / "out")}, "split": {"validation_fraction": 0.3}, "strides": {"train": 15, "validation": 15, "test": 15}}
    for name, commands in (("persistence", ["inspect", "build-index", "run"]), ("clear_sky", ["run"]), ("linear", ["train", "evaluate"])):
        (tmp_path / "c.json").write_text(json.dumps(base | {"scaler": "standard", "model": {"name": name, "capacity": 9.0}}))
        for command in commands:
            assert cli.main([command, str(tmp_path / "c.json")], spark).count() > 0
    assert spark.read.parquet(str(tmp_path / "out/predictions.parquet")).count() > 0
    assert json.loads(spark.read.text(str(tmp_path / "out/metrics.json")).first()[0])["n"] > 0
    assert scale.Scaler.load(str(tmp_path / "out/scaler.json")).name == "standard"
    near = spark.read.parquet(str(tmp_path / "out/predictions.parquet")).agg(F.max("y_true"), F.max(F.abs("y_pred"))).first()
    assert near[0] > 1.0 and near[1] < 100  # in units of the store again
    assert cli.main(["compare", str(tmp_path / "out")], spark).count() > 0
    sinks.comparison(spark.range(3).toDF("a"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    (tmp_path / "c.json").write_text(json.dumps(base | {"model": {"name": "rf"}, "output": {"path": str(tmp_path / "none")}}))
    with pytest.raises(Exception):
        cli.main(["evaluate", str(tmp_path / "c.json")], spark)


def test_ledgers(spark):
    rows = [("d", "a", 10.0, "rmse", 1.0), ("d", "a", 10.0, "acc_rmse", 0.9), ("d", "b", 10.0, "rmse", 2.0), ("d", "b", 10.0, "acc_rmse", 0.5), ("e", "a", None, "rmse", 3.0), ("e", "c", None, "rmse", 2.0)]
    ledger = spark.createDataFrame(rows, "dataset string, model string, normalized_by double, metric string, value double")
    assert {r["model"]: r["holds"] for r in metrics.identity_check(ledger).collect()} == {"a": True, "b": False}
    best = {r["task"]: (r["best_model"], r["by"]) for r in metrics.best_by_group(metrics.tag_tasks(ledger, {("d", "a"): "t", ("d", "b"): "t"})).collect()}
    assert best == {"t": ("a", "acc_rmse"), "e / single task": ("c", "rmse")}


def test_samples_and_their_order(spark):
    days = spark.createDataFrame([(T0.date(), "train")], "date date, split string")
    windows = forecast_windows.valid_windows(forecast_windows.window_index(store(spark), days, 15, 1, 15, {"train": 1}))
    s = loader.sample(windows)
    a, b = ([r["sample_index"] for r in loader.epoch(x, 1).collect()] for x in (s, s.repartition(5)))
    assert a == b and sorted(a) == list(range(10)) and a != sorted(a)
    r = s.where("sample_index = 0").first()
    assert len(r["pv_history"]) == 16 and r["target_time"] - r["issue_time"] == 900 * 10**9 and r["target"] == [30.0]
    d = spark.createDataFrame([([[1, 2], [3, 4]], [5.0, 6.0])], "i array<array<int>>, h array<double>")
    assert one(d.select(loader.stack_channels("i"), loader.sequence_input("h"))) == [([1, 2, 3, 4], [[5.0], [6.0]])]


def test_images_become_channels(spark):
    d = spark.createDataFrame([([0, 51, 102, 255, 204, 153],)], "p array<smallint>")
    got = d.select(scans.channels_first("p"), scans.brightness("p")).first()
    assert got[0] == pytest.approx([0.0, 1.0, 0.2, 0.8, 0.4, 0.6]) and got[1] == 127.5


def test_streams(spark, tmp_path):
    from sunstride.streaming import stream_ramps, stream_readings, stream_thinned

    rows = [("a", T0 + timedelta(minutes=4 * k), float(k)) for k in range(12)]
    later = [("a", T0 + timedelta(hours=5), 99.0)]  # moves the watermark past the others
    schema = "event_type string, ts timestamp_ntz, value double"
    for k, part in enumerate((rows[6:], rows[:6], later, [("a", T0, 50.0)])):  # out of order, and one row that is too late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(stream_readings(stream), "append", "r").count() == 3
    assert run(stream_thinned(stream, "event_type", "ts", 600), "append", "t").count() == 4
    assert [r["ramp"] for r in run(stream_ramps(stream, "event_type", "ts", "value"), "append", "p").orderBy("us").collect()] == [None] + [1.0] * 11


def test_stored_networks(spark):
    import numpy as np

    r = np.random.default_rng(2)
    n, steps, width, heads = 2, 5, 6, 2
    pairs = {"query": (6, 6), "key": (6, 6), "value": (6, 6), "out": (6, 6), "net1": (6, 8), "net2": (8, 6)}
    layer = {f"{k}.w": r.normal(size=v) for k, v in pairs.items()} | {f"{k}.b": r.normal(size=v[1]) for k, v in pairs.items()}
    layer |= {f"norm{k}.{x}": r.normal(size=6) for k in (1, 2) for x in "wb"}
    x = r.normal(size=(n, steps, width))
    # attention step by step
    q, k, v = (x @ layer[f"{c}.w"] + layer[f"{c}.b"] for c in ("query", "key", "value"))
    want = np.zeros_like(x)
    for b in range(n):
        for h in range(heads):
            at = slice(3 * h, 3 * h + 3)
            for i in range(steps):
                e = np.exp([q[b, i, at] @ k[b, j, at] / 3**0.5 for j in range(steps)])
                want[b, i, at] = sum(e[j] / e.sum() * v[b, j, at] for j in range(steps))
    assert stored.attention(x, layer, heads) == pytest.approx(want @ layer["out.w"] + layer["out.b"])
    z = stored.normed(x, np.ones(6), np.zeros(6))
    assert z.mean(axis=-1) == pytest.approx(np.zeros((n, steps)), abs=1e-9) and z.std(axis=-1) == pytest.approx(np.ones((n, steps)), abs=1e-3)
    ends = {"in.w": r.normal(size=(1, 6)), "in.b": r.normal(size=6), "head.w": r.normal(size=(6, 3)), "head.b": r.normal(size=3)}
    rows = r.normal(size=(4, 7))
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(9, None)], "k int, x array<double>").repartition(2)
    got = {r["k"]: r["y_pred"] for r in stored.applied(d, [("x", (7, 1))], lambda a: stored.sequence_forecast(a, ends, [layer], heads)).collect()}
    assert got.pop(9) is None and np.array([got[k] for k in range(4)]) == pytest.approx(stored.sequence_forecast(rows[:, :, None], ends, [layer], heads))
    ends = {"in.w": r.normal(size=(3, 6)), "in.b": r.normal(size=6), "positions": r.normal(size=(3, 6)), "head.w": np.zeros((18, 2)), "head.b": np.zeros(2), "gain": 2.0, "shift": 0.0}
    assert stored.patch_forecast(rows, ends, [layer], heads, 3, 2) == pytest.approx(np.repeat(rows.mean(axis=1)[:, None], 2, axis=1))  # nothing learned gives the mean back
    images, w, b = r.normal(size=(2, 2, 4, 4)), r.normal(size=(3, 2, 3, 3)), r.normal(size=3)
    padded = np.pad(images, ((0, 0), (0, 0), (1, 1), (1, 1)))
    plain = np.array([[[[(padded[i, :, y : y + 3, c : c + 3] * w[o]).sum() + b[o] for c in range(4)] for y in range(4)] for o in range(3)] for i in range(2)])
    assert stored.convolved(images, w, b) == pytest.approx(plain)
    block = {"w": w, "b": b, "mean": np.zeros(3), "var": np.ones(3) - 1e-5, "gain": np.ones(3), "shift": np.zeros(3)}
    top = np.maximum(plain, 0).reshape(2, 3, 2, 2, 2, 2).max(axis=(3, 5)).reshape(2, -1)
    dense = [(r.normal(size=(12 + 1, 1)), np.zeros(1))]
    assert stored.image_forecast(images, np.ones((2, 1)), [block], dense) == pytest.approx(np.concatenate([top, np.ones((2, 1))], axis=1) @ dense[0][0])


def test_core_does_not_import_the_training_data_operators():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['sunstride.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')]; assert not [m for m in sys.modules if m.startswith('sunstride.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
