"""Array forms of pixel operators, stores that are written again, heads of files, and streams that are interrupted."""

import datetime as dt
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import pixels, samples, views
from heliograph.sources import files
from heliograph.streaming import live, replay


def of(spark, x, column):
    return np.array(spark.createDataFrame([(x.ravel().tolist(),)], "x array<double>").select(column(F.col("x")).alias("y")).first().y)


@pytest.mark.parametrize("shape", [(6, 8, 3), (9, 5, 1), (7, 7, 2)])
def test_array_forms_equal_numpy(spark, shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(float)
    h, w, _ = shape
    top, left = (h - 4) // 2, (w - 3) // 2
    assert (of(spark, x, lambda c: pixels.center_crop_array(c, shape, 4, 3)) == x[top : top + 4, left : left + 3].ravel()).all()
    for i in range(3):
        a, b = pixels.square_corner(h, w, 5, i)
        assert (of(spark, x, lambda c: pixels.uniform_crop_array(c, shape, 5, i)) == x[a : a + 5, b : b + 5].ravel()).all()
    for size in ((3, 4), (11, 9), shape[:2]):
        assert (np.rint(of(spark, x, lambda c: pixels.resize_array(c, shape, *size))).astype(np.uint8) == pixels.bilinear(x, *size).ravel()).all()


def test_channels_have_their_own_mean(spark):
    x = np.random.default_rng(2).integers(0, 256, (4, 5, 3)).astype(float)
    assert np.allclose(of(spark, x, pixels.normalize_channels), ((x / 255 - pixels.MEAN) / pixels.STD).ravel())


def test_resizing_a_large_array_is_linear(spark):
    x = F.transform(F.sequence(F.lit(0), F.lit(224 * 224 * 3 - 1)), lambda v: (v % 256).cast("double"))
    began = time.time()
    assert spark.range(8).select(F.size(pixels.resize_array(x, (224, 224, 3), 112, 112)).alias("n")).agg(F.sum("n")).first()[0] == 8 * 112 * 112 * 3
    assert time.time() - began < 20


def test_merging_many_classes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 710)) * 3
    rows = [(i // 15, i % 5, i % 3, i // 15 % 710, x[i].tolist(), 0) for i in range(300)] + [(0, 0, 0, 0, x[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "clip int, chunk int, crop int, label int, logits array<double>, again int")
    began = time.time()
    got = {r.clip: np.array(r.merged) for r in views.merge_views(df, ["again"]).collect()}
    assert time.time() - began < 15
    e = np.exp(x - x.max(axis=1, keepdims=True))
    want = (e / e.sum(axis=1, keepdims=True)).reshape(20, 15, 710).mean(axis=1)
    assert set(got) == set(range(20)) and all(np.allclose(got[c], want[c]) for c in got)
    raw = {r.clip: np.array(r.merged) for r in views.merge_views(df, ["again"], "score").collect()}
    assert all(np.allclose(raw[c], x.reshape(20, 15, 710)[c].mean(axis=0)) for c in raw)
    none = spark.createDataFrame([(1, 0, 0, 3, None, 0)], df.schema)
    assert [tuple(r) for r in views.merge_views(none, ["again"]).collect()] == [(1, 3, None)]


def test_merging_deals_rows_once(spark):
    df = spark.createDataFrame([], "clip int, chunk int, crop int, label int, logits array<double>, again int")
    plan = views.merge_views(df, ["again"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize(("seconds_", "step", "gap", "fan"), [(3 * 86400, 7, 600, 64), (40 * 86400, 97, 7200, 64), (40 * 86400, 97, 7200, 3), (30 * 86400, 41, 3600, 2), (86400, 1, 59, 64)])
def test_thinning_long_series(spark, seconds_, step, gap, fan):
    """More buckets than are put together at once, and a stretch in the middle without times."""
    base = dt.datetime(2024, 1, 1)
    t = [s for s in range(5, seconds_, step) if not seconds_ // 3 < s < seconds_ // 2]
    df = spark.createDataFrame([(s,) for s in t], "s long").select(F.lit("a").alias("camera_id"), F.timestamp_seconds(F.col("s") + F.lit(int((base - dt.datetime(1970, 1, 1)).total_seconds()))).cast("timestamp_ntz").alias("ts"))
    want, last = [], 5
    for s in t:
        if s - last > gap:
            want.append(s)
            last = s
    got = sorted(int((r.ts - base).total_seconds()) for r in samples.thin(df, df.limit(0).unionByName(spark.createDataFrame([("a", base + dt.timedelta(seconds=5))], "camera_id string, ts timestamp_ntz")), gap, fan).collect())
    assert got == want


def test_drawn_frames_lie_in_their_parts(spark):
    df = spark.createDataFrame([(f"v{n}", n) for n in (0, 1, 7, 8, 9, 100)], "path string, total int")
    for r in df.select("total", views.sparse_train(F.col("total"), F.col("path"), 8, 3, 1).alias("i")).collect():
        part = r.total // 8
        if part:
            assert all(1 + k * part <= x < 1 + (k + 1) * part for k, x in enumerate(r.i))
        else:
            assert r.i == [1] * (8 - r.total) + [1 + k for k in range(r.total)]
    assert [r.i for r in df.where("total = 100").select(views.sparse_clip(F.col("total"), 4, 1).alias("i")).collect()] == [[13, 38, 63, 88]]
    assert [r.i for r in df.where("total = 100").select(views.sparse_test(F.col("total"), 2, 2, 1).alias("i")).collect()] == [[1, 26, 51, 76]]


def plain_stretches(starts, n, length, step, shifts):
    out = []
    for s in starts:
        offset = s + 1
        for i in range(length):
            out.append(offset + shifts[i] - 1 if offset + shifts[i] <= n else offset - 1)
            if offset + step < n:
                offset += step
    return out


@pytest.mark.parametrize("jitter", [False, True])
def test_pretraining_frames_by_source(spark, jitter):
    rows = [(f"{source}/v{n}", n % 3, n) for source in ("SomethingV2", "AVA2.2", "k400") for n in (1, 5, 16, 32, 33, 34, 64, 65, 66, 250)] + [("clip.mp4", 0, -1)]
    df = spark.createDataFrame(rows, "path string, start int, total int").withColumn("x", F.lit(1))
    for segments in (1, 4):
        for r in views.pretrain_frames(df, 16, 4, 7, segments, jitter).collect():
            if r.total < 0:
                assert r.files is None
                continue
            step = 2 if r.path.startswith("Something") else 4
            draw = lambda *more: int(__import__("hashlib").md5("-".join(["7", r.path, *map(str, more)]).encode()).hexdigest()[:8], 16)
            part = (r.total - 16 * step + 1) // segments
            if part > 0:
                starts = [k * part + draw(k) % part for k in range(segments)]
            elif r.total > max(segments, 16 * step):
                starts = sorted(draw(k) % (r.total - 16 * step + 1) for k in range(segments))
            else:
                starts = [0] * segments
            shifts = [draw("jitter", i) % step if jitter else 0 for i in range(16)]
            assert r.frames == plain_stretches(starts, r.total, 16, step, shifts)
            name = "image_%06d.jpg" if r.path.startswith("AVA") else "img_%05d.jpg"
            assert r.files == [f"{r.path}/{name % (i + r.start)}" for i in r.frames]


def test_heads_are_read_from_the_first_lines_only(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a b.csv").write_text('﻿"power, kW",Date,"x ""y"""\n1.5,2017-03-10T08:34:00,7\n')
    (tmp_path / "c/big.csv").write_text('Date,"power, kW",kw,kw\n' + "2017-03-11T08:34:00,2.5,1,2\n" * 200_000)
    heads = files.read_heads(spark, str(tmp_path / "c"))
    assert set(heads) == {("power, kW", "Date", 'x "y"'), ("Date", "power, kW", "kw", "kw")}
    df = files.read_pv_csv(spark, str(tmp_path / "c"), "power, kW")
    assert {(r.ts.day, r.kw, r["count"]) for r in df.groupBy("ts", "kw").count().collect()} == {(10, 1.5, 1), (11, 2.5, 200_000)}
    every = files.read_csvs(spark, str(tmp_path / "c"))
    assert set(every.columns) == {"power, kW", "Date", 'x "y"', "kw", "kw.1"} and every.count() == 200_001
    (tmp_path / "c/poor.csv").write_text("Date,other\n")
    with pytest.raises(ValueError, match=r"poor\.csv"):
        files.read_pv_csv(spark, str(tmp_path / "c"), "power, kW")


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def test_a_store_is_pruned_and_written_again_without_doubling(spark, tmp_path):
    at = str(tmp_path / "s")
    rows = [("a", day(n, h), float(n)) for n in range(1, 6) for h in range(24)]
    df = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, kw double")
    files.write_series(df, at)
    files.write_series(df.where("day(ts) = 3").withColumn("kw", F.lit(9.0)), at)
    read = files.read_series(spark, at, "2024-01-02 12:00:00", "2024-01-04 06:00:00")
    assert read.count() == 12 + 24 + 6 and {r.kw for r in read.where("day(ts) = 3").collect()} == {9.0}
    plan = read._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x)
    assert "day" in scan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(ts" in scan.split("PushedFilters: [")[1]
    assert all("day=2024-01-0" + d in "".join(read.inputFiles()) for d in "234") or len(read.inputFiles()) >= 3
    assert spark.read.parquet(at).count() == len(rows)


def test_samples_are_replaced_by_split_and_day(spark, tmp_path):
    at = str(tmp_path / "s")
    df = spark.createDataFrame([("a", day(n, h), "test" if n == 2 else "trainval") for n in range(1, 5) for h in range(3)], "camera_id string, ts timestamp_ntz, split string")
    for batch in (df.where("day(ts) < 3"), df.where("day(ts) >= 3"), df.where("day(ts) < 3")):
        counts = {r["split"]: r["count"] for r in files.write_samples(batch, at).collect()}
    assert counts == {"test": 3, "trainval": 9}
    assert {r.ts for r in files.read_samples(spark, at, "trainval", "2024-01-03 01:00:00").collect()} == {day(n, h) for n in (3, 4) for h in range(3)} - {day(3)}


def test_frames_of_days_are_listed_without_the_rest(spark, tmp_path):
    root = str(tmp_path / "frames")
    df = spark.createDataFrame([(f"2024/01/{c}/{n:02d}/202401{n:02d}08{m:02d}00.jpg", bytearray(b"x" * n)) for c in "ab" for n in range(1, 9) for m in (0, 30)], "path string, data binary")
    assert files.write_frames(df, root) == 32 and files.write_frames(df, root) == 32
    assert len(files.day_folders(spark, root, "2024-01-03 00:00:00", "2024-01-05 12:00:00")) == 6
    got = files.list_frames(spark, root, "2024-01-03 08:30:00", "2024-01-05 08:30:00", by_day=True).collect()
    assert sorted((r.ts.day, r.ts.minute) for r in got) == sorted([(3, 30), (4, 0), (4, 30), (5, 0)] * 2)
    assert files.list_frames(spark, root, "2025-01-01 00:00:00", "2025-01-02 00:00:00", by_day=True).count() == 0


def test_bad_manifest_lines_are_named(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a 10 1\nshort 3\n\nb x 2\nc 20 3\n")
    at = str(tmp_path / "m.txt")
    assert {(r.file.rsplit("/", 1)[1], r.line, r.reason) for r in files.manifest_errors(spark, at, "frames").collect()} == {("m.txt", "short 3", "short manifest line"), ("m.txt", "b x 2", "manifest line whose total isn't a number")}
    assert {(r.path, r.total, r.label) for r in files.read_manifest(spark, at, "frames", strict=False).collect()} == {("a", 10, 1), ("c", 20, 3)}
    with pytest.raises(Exception, match=r"short 3 in .*m\.txt|b x 2 in .*m\.txt"):
        files.read_manifest(spark, at, "frames").collect()


def test_shards_begin_with_their_accuracy(spark, tmp_path):
    df = spark.createDataFrame([("v1", [0.5, 1e-7, -2.0], 0, 0, 1), ("v2", [1.0, 3.0, 2.0], 2, 1, 0)], "clip_id string, logits array<double>, label int, chunk int, crop int")
    files.write_prediction_shards(df, str(tmp_path / "p"), 1)
    text = next((tmp_path / "p/shard=0").glob("part-*")).read_text().split("\n")
    assert text[0] == "50.0, 100.0" and text[1].startswith("v1 [0.5, 1.0E-7, -2.0] 0 0 1")
    assert sorted(files.read_prediction_shards(spark, str(tmp_path / "p")).collect()) == sorted(df.withColumn("label", F.col("label").cast("double")).collect())


READING = "sensor_id string, ts timestamp, kw double"


def test_a_stream_that_dies_between_writing_and_commit_goes_on_without_doubling(spark, tmp_path):
    inbox, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [("a", dt.datetime(2024, 1, 1, h, m), float(h)) for h in range(6) for m in range(0, 60, 5)]
    df = spark.createDataFrame(rows, READING)
    parts = replay.slices(df, ["2024-01-01 02:00:00", "2024-01-01 04:00:00"])
    stream = lambda: live.stream_readings(spark, inbox)

    def die(number):
        raise RuntimeError("lost")

    replay.deliver(parts[0], inbox)
    replay.run_available(stream(), sink, checkpoint)
    replay.deliver(parts[1].unionByName(parts[0].where("hour(ts) = 1")), inbox)
    with pytest.raises(Exception, match="lost"):
        replay.run_available(stream(), sink, checkpoint, die)
    left = replay.read_sink(spark, sink, READING).count()
    assert left > parts[0].count()  # the batch was written, but not committed
    replay.run_available(stream(), sink, checkpoint)
    assert replay.read_sink(spark, sink, READING).count() == left
    replay.deliver(parts[2], inbox)
    replay.run_available(stream(), sink, checkpoint)
    assert sorted(map(tuple, replay.read_sink(spark, sink, READING).collect())) == sorted(rows)
    shutil.rmtree(sink)
    replay.run_available(stream(), sink, checkpoint)  # nothing new: nothing is written
    assert not (tmp_path / "out").exists()
