"""Edge cases of series, sample and scoring operators on small hand-made tables."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliograph.operators import clean, pixels, samples, scoring, views


def at(s):
    return dt.datetime.fromisoformat(s)


def series(spark, rows):
    return spark.createDataFrame([("a", at(t), float(v)) for t, v in rows], "sensor_id string, ts timestamp_ntz, kw double")


def test_grid_aligned_start_has_no_point_at_the_last_reading(spark):
    out = clean.interpolate_grid(series(spark, [("2024-01-01 00:00:00", 0), ("2024-01-01 00:00:40", 4)]), 10).orderBy("ts").collect()
    assert [(r.ts.second, r.kw) for r in out] == [(0, 0.0), (10, 1.0), (20, 2.0), (30, 3.0)]


def test_grid_off_grid_start_labels_its_bin(spark):
    out = clean.interpolate_grid(series(spark, [("2024-01-01 00:00:05", 0), ("2024-01-01 00:00:25", 2)]), 10).orderBy("ts").collect()
    assert [(r.ts.second, r.kw) for r in out] == [(0, 0.0), (10, 0.5), (20, 1.5)]


def test_gap_of_exactly_the_limit_is_kept_and_longer_ones_go_with_both_ends(spark):
    r = series(spark, [("2024-01-01 00:00:00", 1), ("2024-01-01 01:00:00", 2), ("2024-01-01 02:00:01", 3), ("2024-01-01 02:00:10", 4)])
    assert [(x.start_ts, x.end_ts) for x in clean.gaps(r, 3600).collect()] == [(at("2024-01-01 01:00:00"), at("2024-01-01 02:00:01"))]
    assert [x.ts for x in clean.drop_gaps(r, r, 3600).orderBy("ts").collect()] == [at("2024-01-01 00:00:00"), at("2024-01-01 02:00:10")]


def test_day_borders_give_the_same_neighbours_as_one_window(spark):
    rows = [(f"2024-01-0{d} {h:02d}:30:00", d * 24 + h) for d in (1, 2, 4) for h in range(0, 24, 7)]
    near = clean.gaps(series(spark, rows), 0).orderBy("start_ts").collect()
    times = sorted(at(t) for t, _ in rows)
    assert [(x.start_ts, x.end_ts) for x in near] == list(zip(times, times[1:]))


def test_a_grid_without_gaps_in_one_step_equals_two_steps(spark):
    """Readings on and off the grid, gaps of exactly the limit and beyond, over days, and a last reading after a gap."""
    rng, rows = np.random.default_rng(12), []
    for sensor in "abc":
        t = 0
        for i in range(300):
            t += int(rng.choice([5, 10, 20, 590, 600, 601, 3600, 3601, 7200, 90000]))
            rows.append((sensor, at("2024-01-01 00:00:00") + dt.timedelta(seconds=t), float(i)))
    r = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, kw double")
    for every, limit in ((10, 600), (600, 3600)):
        one = clean.interpolate_grid(r, every, limit)
        two = clean.drop_gaps(clean.interpolate_grid(r, every), r, limit)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_interval_ends_belong_to_it(spark):
    iv = spark.createDataFrame([(at("2024-01-01 23:59:00"), at("2024-01-02 00:01:00"))], "start_ts timestamp_ntz, end_ts timestamp_ntz")
    r = series(spark, [("2024-01-01 23:58:59", 1), ("2024-01-01 23:59:00", 1), ("2024-01-02 00:00:00", 1), ("2024-01-02 00:01:00", 1), ("2024-01-02 00:01:01", 1)])
    assert clean.drop_intervals(r, iv).count() == 2


def test_midnight_of_a_test_day_is_trainval(spark):
    rows = [("2024-01-03 00:00:00", 1), ("2024-01-03 00:00:10", 1), ("2024-01-03 23:59:50", 1), ("2024-01-04 00:00:00", 1)]
    out = samples.split_by_days(series(spark, rows), ["2024-01-03", "2024-01-03"]).orderBy("ts").collect()
    assert [r.split for r in out] == ["trainval", "test", "test", "trainval"]


def test_of_a_run_of_repeats_the_first_stays(spark):
    rows = [(at(f"2024-01-01 00:00:0{i}"), c) for i, c in enumerate("AAABA")]
    out = clean.drop_repeats(spark.createDataFrame(rows, "ts timestamp_ntz, content string"), "content").orderBy("ts").collect()
    assert [r.ts.second for r in out] == [0, 3, 4]


@pytest.mark.parametrize("anchor,valid,kept", [(0, [60, 119, 120, 239, 240], [120, 240]), (0, [100, 130], [130]), (0, [120, 241], [120, 241])])
def test_thinning(spark, anchor, valid, kept):
    base = at("2024-01-01 00:00:00")
    c = spark.createDataFrame([("a", base + dt.timedelta(seconds=s)) for s in valid], "camera_id string, ts timestamp_ntz")
    a = spark.createDataFrame([("a", base + dt.timedelta(seconds=anchor))], "camera_id string, ts timestamp_ntz")
    assert sorted((r.ts - base).seconds for r in samples.thin(c, a, 119).collect()) == kept


def test_lag_stack_needs_every_lag_and_begins_with_now(spark):
    base = at("2024-01-01 00:00:00")
    f = spark.createDataFrame([("a", base + dt.timedelta(minutes=i)) for i in range(5)], "camera_id string, ts timestamp_ntz")
    pv = spark.createDataFrame([("a", base + dt.timedelta(minutes=i), float(i)) for i in range(5) if i != 1], "sensor_id string, ts timestamp_ntz, kw double")
    out = samples.lag_stack(f, pv, 3, 60).collect()
    assert [r.pv_log for r in out] == [[4.0, 3.0, 2.0]]


@pytest.mark.parametrize("x,obs,want", [([1.0, 3.0], 2.0, 0.5), ([5.0], 2.0, 3.0)])
def test_crps(spark, x, obs, want):
    got = spark.createDataFrame([(x, obs)], "x array<double>, obs double").select(scoring.crps(F.col("x"), F.col("obs")).alias("c")).first().c
    assert got == pytest.approx(want)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=8), st.floats(-50, 50))
def test_crps_is_the_integral(spark, x, obs):
    got = spark.createDataFrame([(x, obs)], "x array<double>, obs double").select(scoring.crps(F.col("x"), F.col("obs")).alias("c")).first().c
    edges = np.array(sorted([*x, obs]))
    steps = [(np.mean(np.array(x) <= a) - (a >= obs)) ** 2 * (b - a) for a, b in zip(edges, edges[1:])]
    assert got == pytest.approx(sum(steps), abs=1e-9) and got >= -1e-9


def test_winkler(spark):
    df = spark.createDataFrame([(2.0,), (0.0,), (4.0,)], "obs double")
    got = [r.w for r in df.select(scoring.winkler(F.lit(1.0), F.lit(3.0), F.col("obs"), 0.1).alias("w")).collect()]
    assert got == pytest.approx([2, 22, 22])


def test_top_class_ties_go_to_the_lower_index(spark):
    got = spark.createDataFrame([([0.4, 0.4, 0.2],)], "x array<double>").select(views.top_classes(F.col("x"), 2).alias("t")).first().t
    assert got == [0, 1]


def test_views_are_deduplicated_by_both_keys(spark):
    rows = [("c", 1, 11, 0, [1.0, 0.0], 0), ("c", 11, 1, 0, [0.0, 1.0], 1), ("c", 1, 11, 0, [9.0, 9.0], 2)]
    df = spark.createDataFrame(rows, "clip string, chunk int, crop int, label int, logits array<double>, o int")
    assert views.merge_views(df, ["o"], "score").first().merged == pytest.approx([0.5, 0.5])


def test_short_clips(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 15, 16, 17, 20)], "n int")
    got = [len(r.w) for r in df.select(views.sliding_windows(F.col("n"), 16, 4).alias("w")).collect()]
    assert got == [0, 0, 0, 1, 1, 2]


def test_folds_partition_positions(spark):
    df = spark.range(23).withColumnRenamed("id", "pos")
    counts = [r["count"] for r in samples.kfold(df, 5, 23).groupBy("fold").count().orderBy("fold").collect()]
    assert sum(counts) == 23 and counts == [4, 5, 4, 5, 5]


def test_video_names(spark):
    df = spark.createDataFrame([("20170301-081500-01.avi",), ("cam_x_20170301081500_20170301083000_1.avi",), ("a.jpg",), ("junk",)], "f string")
    out = {r.name: (r.start_ts, r.end_ts) for r in samples.parse_video_names(df, "f").collect()}
    assert out == {"20170301-081500-01.avi": (at("2017-03-01 08:15:00"), None), "cam_x_20170301081500_20170301083000_1.avi": (at("2017-03-01 08:15:00"), at("2017-03-01 08:30:00"))}


def test_capture_plan_moves_an_aligned_start_on(spark):
    v = spark.createDataFrame([(i, at(f"2024-01-01 08:15:{s}"), at("2024-01-01 08:17:30")) for i, s in enumerate(("00", "03"))], "video int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    out = samples.capture_plan(v).collect()
    assert sorted({r.shot_ts.strftime("%M:%S") for r in out}) == ["15:10", "16:10", "17:10"] and len(out) == 6


@pytest.mark.parametrize("gap", [0, 119, 7199, 40000])
def test_thinning_over_days_equals_one_fold(spark, gap):
    rng = np.random.default_rng(gap)
    base, rows, want = at("2024-01-01 00:00:00"), [], set()
    for camera, n in (("a", 900), ("b", 40), ("c", 1)):
        times = sorted(rng.integers(0, 5 * 86400, n).tolist())
        rows += [(camera, base + dt.timedelta(seconds=t)) for t in times]
        last = 1000
        for t in times:
            if t - last > gap:
                want.add((camera, t))
                last = t
    c = spark.createDataFrame(rows, "camera_id string, ts timestamp_ntz")
    a = spark.createDataFrame([(x, base + dt.timedelta(seconds=1000)) for x in "abcd"], "camera_id string, ts timestamp_ntz")
    got = [(r.camera_id, int((r.ts - base).total_seconds())) for r in samples.thin(c, a, gap).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rolling_meter_crosses_its_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(run, i, None if rng.random() < 0.1 else float(rng.integers(0, 50))) for run in ("a", "b") for i in range(57)]
    df = spark.createDataFrame(rows, "run string, step int, value double")
    got = {(r.run, r.step): r for r in clean.rolling_meter(df, "run", ["step"], "value", F.floor(F.col("step") / 7), n=5, size=8).collect()}
    assert len(got) == len(rows)
    for run in ("a", "b"):
        x = [v for r, _, v in rows if r == run]
        for i in range(57):
            near, far, r = sorted(v for v in x[max(0, i - 4) : i + 1] if v is not None), [v for v in x[: i + 1] if v is not None], got[run, i]
            assert (r.min_n, r.median_n, r.max_n) == ((near[0], near[(len(near) - 1) // 2], near[-1]) if near else (None, None, None))
            assert r.mean_n == (pytest.approx(np.mean(near)) if near else None) and r.mean_all == (pytest.approx(np.mean(far)) if far else None)


def test_every_model_and_sampling_scores_every_row(spark):
    out = scoring.score(spark.createDataFrame([(1, 2.0), (2, 3.0)], "i int, x double"), [1.0, 10.0], 2, lambda m, s, b: b["x"] * m + s)
    assert sorted((r.i, r.model_id, r.sampling, r.pred) for r in out.collect()) == [(1, 0, 0, 2.0), (1, 0, 1, 3.0), (1, 1, 0, 20.0), (1, 1, 1, 21.0), (2, 0, 0, 3.0), (2, 0, 1, 4.0), (2, 1, 0, 30.0), (2, 1, 1, 31.0)]
    assert scoring.first_samplings(out, 1).count() == 4


def test_day_series_and_last_step(spark):
    r = series(spark, [("2024-01-01 23:00:00", 2), ("2024-01-01 08:00:00", 1), ("2024-01-02 00:00:00", 3)])
    got = {(x.day.day): [v.kw for v in x.series] for x in clean.day_series(r, closed=True).collect()}
    assert got == {1: [1.0, 2.0, 3.0], 2: [3.0]}
    df = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "x array<double>")
    assert [x.l for x in df.select(scoring.last_step(F.col("x")).alias("l")).collect()] == [2.0, None, None]


def test_backlog_by_days_and_outputs(spark):
    f = spark.createDataFrame([("a", at("2024-01-01 10:00:00")), ("b", at("2024-01-02 10:00:00")), ("c", at("2024-01-03 00:00:00")), (None, at("2024-01-02 11:00:00"))], "path string, ts timestamp_ntz")
    done = spark.createDataFrame([("b",), ("b",), (None,)], "path string")
    left = samples.without_output(samples.in_days(f, "2024-01-01", "2024-01-02"), done, "path").collect()
    assert sorted(r.path or "" for r in left) == ["", "a"]
    days = samples.distinct_days(samples.union_all([f, f]))
    assert [r.day.day for r in samples.complement(days, days.where("day < '2024-01-03'")).collect()] == [3]


def test_training_clips_stay_in_their_part(spark):
    df = spark.createDataFrame([(str(n), n) for n in (0, 5, 64, 130, 131, 700)], "path string, total int")
    for r in df.select("total", views.dense_train(F.col("total"), F.col("path"), 16, 4, 2, 5).alias("i")).collect():
        part = r.total // 2
        assert len(r.i) == 32
        for k in (0, 1):
            own = r.i[16 * k : 16 * (k + 1)]
            assert own == sorted(own) and own[0] >= k * part and (own[-1] < (k + 1) * part or part == 0)
            assert part <= 64 or own[-1] - own[0] == 63
    test = df.where("total = 131").select(views.sparse_test(F.col("total"), 8, 3).alias("i")).first().i
    assert test == sorted(int(s * (131 / 8) / 3 + (131 / 8) * x) for s in range(3) for x in range(8))


def test_random_masks_and_patch_targets(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "i int")
    masks = [r.m for r in df.select(pixels.random_mask(F.col("i"), 2, 8, 0.75, 1).alias("m")).collect()]
    assert [sum(m) for m in masks] == [12] * 4 and len({tuple(m) for m in masks}) == 4
    x = np.random.default_rng(1).random((4, 4, 4, 3))
    rows = spark.createDataFrame([(1, x.reshape(-1).tolist()), (2, None)], "i int, clip array<double>")
    got = {r.i: r.targets for r in pixels.with_patch_targets(rows, (4, 4, 4, 3), 2).collect()}
    one = x[:2, :2, 2:, :].reshape(8, 3)
    assert got[2] is None and np.allclose(np.array(got[1][1]).reshape(8, 3), (one - one.mean(0)) / (one.std(0, ddof=1) + 1e-6))


@pytest.mark.parametrize("q", [0.05, 0.5, 0.95])
def test_quantiles(spark, q):
    df = spark.createDataFrame([([1.0, 4.0, 10.0],), ([2.0],), ([],)], "x array<double>")
    got = [r.q for r in df.select(scoring.quantile(F.col("x"), q).alias("q")).collect()]
    assert got == [pytest.approx(np.quantile([1, 4, 10], q)), 2.0, None]


@pytest.mark.parametrize("kind,ranges", [("double", 9), ("double", 1), ("int", 40)])
def test_rolling_meter_goes_on_over_ranges_and_shuffles_each_row_once(spark, kind, ranges):
    """Ranges of some ten rows and fewer, also within a window, a series without a name, and a series of nulls only."""
    rng = np.random.default_rng(4)
    rows = [(run, i, None if run == "c" or rng.random() < 0.2 else int(rng.integers(0, 50))) for run, k in ((None, 23), ("a", 60), ("b", 1), ("c", 7), ("d", 31)) for i in range(k)]
    df = spark.createDataFrame([(run, i, v if v is None or kind == "int" else float(v)) for run, i, v in rows], f"run string, step int, value {kind}").repartition(3)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    df = df.localCheckpoint()
    before = shuffled()
    out = clean.rolling_meter(df, "run", ["step"], "value", F.floor(F.col("step") / 2), n=5, size=4, **({"ranges": ranges} if ranges > 1 else {})).collect()
    assert shuffled() - before <= len(rows) + 6 * ranges + 10
    got = {(r.run, r.step): r for r in out}
    assert len(got) == len(out) == len(rows)
    for run in (None, "a", "b", "c", "d"):
        x = [v for r, _, v in rows if r == run]
        for i in range(len(x)):
            near, far, r = sorted(v for v in x[max(0, i - 4) : i + 1] if v is not None), [v for v in x[: i + 1] if v is not None], got[run, i]
            assert (r.min_n, r.median_n, r.max_n) == ((near[0], near[(len(near) - 1) // 2], near[-1]) if near else (None, None, None))
            assert r.mean_n == (pytest.approx(np.mean(near)) if near else None) and r.mean_all == (pytest.approx(np.mean(far)) if far else None)
