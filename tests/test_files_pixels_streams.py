"""Round trips of readers and sinks, pixel helpers against NumPy, and streams against batch."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import pixels, views
from heliograph.sources import files
from heliograph.streaming import live

IMAGE = "id int, image struct<height:int,width:int,nChannels:int,data:binary>"


def image(x):
    return (1, {"height": x.shape[0], "width": x.shape[1], "nChannels": x.shape[2], "data": bytearray(x.tobytes())})


def back(row):
    return np.frombuffer(bytes(row.image["data"]), np.uint8).reshape(row.image["height"], row.image["width"], row.image["nChannels"])


def test_crops_and_resize(spark):
    x = np.arange(6 * 8 * 3, dtype=np.uint8).reshape(6, 8, 3)
    df = spark.createDataFrame([image(x)], IMAGE)
    assert (back(pixels.center_crop(df, 4, 4).first()) == x[1:5, 2:6]).all()
    assert (back(pixels.uniform_crop(df, 6, 2).first()) == x[:, 2:8]).all()
    flat = np.full((5, 7, 3), 9, np.uint8)
    assert (pixels.bilinear(flat, 3, 3) == 9).all()
    assert (pixels.bilinear(x, 6, 8) == x).all()


def test_patch_targets_have_mean_0_and_deviation_1():
    x = pixels.patch_targets(np.random.default_rng(0).random((4, 8, 8, 3)), 4)
    assert x.shape == (8, 2 * 16 * 3)
    cells = x.reshape(8, 32, 3)
    assert np.allclose(cells.mean(axis=1), 0) and np.allclose(cells.std(axis=1, ddof=1), 1, atol=1e-4)


def test_csv_of_different_headers_and_series_round_trip(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/a.csv").write_text("Date,kw\n2017-03-10T08:34:00,1.5\nbad,2\n")
    df = files.read_pv_csv(spark, str(tmp_path / "csv"), "kw")
    assert sorted((r.ts, r.kw) for r in df.where("ts is not null").collect()) == [(dt.datetime(2017, 3, 10, 8, 34), 1.5)]
    (tmp_path / "csv/b.csv").write_text("Date,other,kw\n2017-03-11T08:34:00,7,2.5\n")
    (tmp_path / "csv/c.csv").write_text("kw,Date\n3.5,2017-03-12T08:34:00\nx,2017-03-13T08:34:00\n")
    both = files.read_pv_csv(spark, str(tmp_path / "csv"), "kw")
    assert sorted((r.ts.day, r.kw) for r in both.where("ts is not null").collect() if r.kw) == [(10, 1.5), (11, 2.5), (12, 3.5)]
    (tmp_path / "csv/d.csv").write_text("1,2\n")
    with pytest.raises(ValueError):
        files.read_pv_csv(spark, str(tmp_path / "csv"), "kw")
    (tmp_path / "csv/d.csv").unlink()
    files.write_series(df.where("ts is not null"), str(tmp_path / "out"))
    assert files.read_series(spark, str(tmp_path / "out")).first().kw == 1.5


def test_frames_are_listed_by_name(spark, tmp_path):
    for n in ("2017/03/a/10/20170310083400.jpg", "2017/03/b/11/20170311083400.jpg", "2017/03/b/11/x.ini"):
        p = tmp_path / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    out = files.list_frames(spark, str(tmp_path), "2017-03-10 00:00:00", "2017-03-11 08:34:00").collect()
    assert [r.ts.day for r in out] == [10]


def test_manifest_shards_logs_and_labels(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a/b.mp4 0 -1\nc 3 40\n")
    assert [(r.path, r.start, r.total) for r in files.read_manifest(spark, str(tmp_path / "m.txt"), "pretrain", "root").collect()] == [("root/a/b.mp4", 0, -1), ("root/c", 3, 40)]
    (tmp_path / "short.txt").write_text("a 1\n")
    with pytest.raises(Exception, match="short manifest line"):
        files.read_manifest(spark, str(tmp_path / "short.txt"), "pretrain").collect()
    (tmp_path / "0.txt").write_text("12.5, 40\nv1 [0.25, 1.5] 3 0 2\n")
    r = files.read_prediction_shards(spark, str(tmp_path / "0.txt")).first()
    assert (r.clip_id, r.logits, r.label, r.chunk, r.crop) == ("v1", [0.25, 1.5], 3.0, 0, 2)
    (tmp_path / "l.json").write_text(json.dumps([5, 7]))
    assert [(x.class_id, x.target) for x in files.read_label_map(spark, str(tmp_path / "l.json")).collect()] == [(0, 5), (1, 7)]
    files.write_log(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), str(tmp_path / "log"))
    assert files.read_log(spark, str(tmp_path / "log"), "epoch int, loss double").first().loss == 0.5
    counts = files.write_samples(spark.createDataFrame([(1, "test"), (2, "test")], "i int, split string"), str(tmp_path / "s"))
    assert [(r.split, r["count"]) for r in counts.collect()] == [("test", 2)]


def test_stream_in_two_steps_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    for rows in ([("a", t(1), 1.0), ("a", t(3), 2.0), ("a", t(3), 2.0)], [("a", t(12), 3.0), ("b", t(2), 4.0)]):
        spark.createDataFrame(rows, "sensor_id string, ts timestamp, kw double").coalesce(1).write.mode("append").parquet(src)
        q = live.stream_readings(spark, src).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.sensor_id, r.ts.second, r.kw) for r in spark.read.parquet(out).collect()) == [("a", 1, 1.0), ("a", 3, 2.0), ("a", 12, 3.0), ("b", 2, 4.0)]


def test_the_offset_of_a_pretraining_clip_stops_below_the_end(spark):
    df = spark.createDataFrame([("a", 20), ("b", 1), ("c", 2), ("d", 100)], "path string, total int")
    got = {r.path: r.i for r in df.select("path", views.pretrain_clip(F.col("total"), F.col("path"), 16, 2, 7).alias("i")).collect()}
    assert got["a"] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 19, 19, 19, 19, 19, 19] and got["b"] == [1] * 16 and got["c"] == [1] * 16
    for path, n in (("a", 20), ("d", 100)):
        at, want = got[path][0], []
        for _ in range(16):
            want.append(at)
            at += 2 if at + 2 < n else 0
        assert got[path] == want


def test_streams_resample_and_pair_with_late_readings(spark, tmp_path):
    t = lambda m, s=0: dt.datetime(2024, 1, 1, 8, m, s)
    pv, frames = "sensor_id string, ts timestamp, kw double", "camera_id string, ts timestamp, path string"

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def step(df, name):
        w = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append")
        w.trigger(availableNow=True).start().awaitTermination()

    def turn():
        step(live.stream_resample(spark.readStream.schema(pv).parquet(str(tmp_path / "pv")), "1 minute", "2 minutes"), "bins")
        step(live.stream_pair(spark.readStream.schema(frames).parquet(str(tmp_path / "frames")), spark.readStream.schema(pv).parquet(str(tmp_path / "pv")), "2 minutes"), "pairs")

    put("pv", [("a", t(0, 30), 2.0), ("a", t(0, 10), 1.0), ("a", t(1), 3.0)], pv)
    put("frames", [("a", t(0, 30), "x"), ("b", t(0, 30), "y"), ("a", t(1, 1), "z")], frames)
    turn()
    put("pv", [("a", t(0, 5), 0.5), ("a", t(20), 9.0)], pv)
    put("frames", [("a", t(20), "w")], frames)
    turn()
    put("pv", [("a", t(0, 1), 7.0), ("a", t(40), 9.0)], pv)
    put("frames", [("a", t(40), "v")], frames)
    turn()
    bins = {r.ts.minute: r.kw for r in spark.read.parquet(str(tmp_path / "bins")).collect()}
    assert bins[0] == 0.5 and bins[1] == 3.0 and bins[20] == 9.0 and 40 not in bins
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "pairs")).collect()) == ["v", "w", "x"]
