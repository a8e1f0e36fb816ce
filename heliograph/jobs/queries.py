"""Registered queries of the power, sample, scoring and video operators, on stand-in views of the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.scratch import new_folder
from heliograph.functions.timekeys import from_seconds, with_neighbour, with_position
from heliograph.operators import clean, pixels, samples, scoring, views
from heliograph.sources import files
from heliograph.streaming import live, replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rounded results get a tiny summand where exact halves occur, so that both engines round them alike.
GRID = 600
MAX_GAP = 3600
DAYS = ["2024-01-03", "2024-01-08", "2024-01-13", "2024-01-18", "2024-01-23"]
SUNNY = DAYS[:2]
INTERVALS = [("2024-01-02 06:00:00", "2024-01-02 18:00:00"), ("2024-01-09 23:00:00", "2024-01-10 01:00:00"), ("2024-01-20 00:00:00", "2024-01-20 00:10:00")]
NS = [1, 3, 5, 7]
_DAYS_SQL = ", ".join(f"'{d}'" for d in DAYS)
_SUNNY_SQL = ", ".join(f"'{d}'" for d in SUNNY)
_IV_SQL = "iv(start_ts, end_ts) AS (VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in INTERVALS) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    return clean.to_readings(table(spark, d, "events"), "event_type", "ts", "value")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return clean.resample_first(readings(spark, d), 3600)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("camera_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).distinct()


def members(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") - 1).alias("sampling")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("pred"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice").cast("double") / 4).alias("obs"), F.to_date("o_orderdate").alias("day"))


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("start_ts"), F.col("b").cast("timestamp_ntz").alias("end_ts"))


def videos(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.unix_seconds(F.to_date("o_orderdate").cast("timestamp")).alias("d"), F.floor("o_totalprice").cast("long").alias("p"))
    start = F.col("d") + F.col("o_orderkey") % 86400
    return o.select(F.col("o_orderkey").alias("video"), from_seconds(start).alias("start_ts"), from_seconds(start + F.col("p") % 3600).alias("end_ts"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), (F.col("n_chars") % 300).alias("total"), (F.col("doc_id") % 10).alias("label"))


_R = "r AS (SELECT event_type AS sensor_id, date_trunc('second', ts)::TIMESTAMP AS ts, avg(value::DOUBLE) AS kw FROM events GROUP BY 1, 2)"
_H = _R + ", h AS (SELECT sensor_id, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(kw, ts) AS kw FROM r GROUP BY 1, 2)"
_F = "f AS (SELECT DISTINCT event_type AS camera_id, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events)"
_N = _R + ", n AS (SELECT *, lead(ts) OVER w AS t1, lead(kw) OVER w AS k1, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY sensor_id ORDER BY ts))"
_G = (
    _N
    + f""", s AS (SELECT *, epoch(ts)::BIGINT AS a, epoch(t1)::BIGINT AS b FROM n WHERE t1 IS NOT NULL),
e AS (SELECT *, unnest(range(((a + {GRID - 1}) // {GRID}) * {GRID}, b, {GRID})) AS g FROM s),
grid AS (SELECT sensor_id, make_timestamp(g * 1000000) AS ts, kw + (k1 - kw) * (g - a) / (b - a) AS kw FROM e
UNION ALL SELECT sensor_id, make_timestamp((a // {GRID}) * {GRID} * 1000000), kw FROM s WHERE i = 1 AND a % {GRID} <> 0)"""
)
_GAPS = _N + f", gaps AS (SELECT sensor_id, ts AS start_ts, t1 AS end_ts FROM n WHERE epoch(t1) - epoch(ts) > {MAX_GAP})"
_M = "m AS (SELECT l_orderkey AS sample_id, l_linenumber - 1 AS sampling, avg(l_extendedprice::DOUBLE) AS pred FROM lineitem GROUP BY 1, 2), t AS (SELECT o_orderkey AS sample_id, o_totalprice::DOUBLE / 4 AS obs, o_orderdate::DATE AS day FROM orders)"
_V = "v AS (SELECT o_orderkey AS video, make_timestamp((epoch(o_orderdate::DATE)::BIGINT + o_orderkey % 86400) * 1000000) AS start_ts, make_timestamp((epoch(o_orderdate::DATE)::BIGINT + o_orderkey % 86400 + floor(o_totalprice)::BIGINT % 3600) * 1000000) AS end_ts FROM orders)"
_MAN = "man AS (SELECT doc_id, concat_ws('/', source, doc_id) AS path, n_chars % 300 AS total, doc_id % 10 AS label FROM documents)"


@query(f"WITH {_G}, w AS (SELECT sensor_id, ts AS start_ts, t1 AS end_ts FROM n WHERE epoch(t1) - epoch(ts) > {MAX_GAP}), {_IV_SQL}, c AS (SELECT sensor_id, ts, kw - 5 AS kw FROM grid x WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.sensor_id = x.sensor_id AND x.ts BETWEEN start_ts AND end_ts) AND NOT EXISTS (SELECT 1 FROM iv WHERE x.ts BETWEEN start_ts AND end_ts)) SELECT sensor_id, ts::DATE AS day, round(avg(kw), 6) AS mean_kw, count(*) AS n FROM c WHERE kw > 0 GROUP BY 1, 2")
def w1_daily_power(spark: SparkSession, d: str) -> DataFrame:
    """The whole series job: grid, gaps, intervals, night, daily means."""
    r = readings(spark, d)
    grid = clean.interpolate_grid(r, GRID, MAX_GAP)
    kept = clean.drop_nonpositive(clean.drop_intervals(grid, intervals(spark)).withColumn("kw", F.col("kw") - 5))
    return kept.groupBy("sensor_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("kw"), 6).alias("mean_kw"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_R} SELECT sensor_id, ts, round(kw, 6) AS kw FROM r")
def b1_to_readings(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).withColumn("kw", F.round("kw", 6))


@query(f"WITH {_R} SELECT sensor_id, ts, round(kw, 6) AS kw FROM r WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def b2_between_times(spark: SparkSession, d: str) -> DataFrame:
    return clean.between_times(readings(spark, d), "2024-01-05 00:00:00", "2024-01-12 00:00:00", "left").withColumn("kw", F.round("kw", 6))


@query(f"WITH {_R}, {_IV_SQL} SELECT sensor_id, ts, round(kw, 6) AS kw FROM r WHERE NOT EXISTS (SELECT 1 FROM iv WHERE ts BETWEEN start_ts AND end_ts)")
def b3_drop_intervals(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_intervals(readings(spark, d), intervals(spark)).withColumn("kw", F.round("kw", 6))


@query(f"WITH {_G}, w AS (SELECT sensor_id, ts AS start_ts, t1 AS end_ts FROM n WHERE epoch(t1) - epoch(ts) > {MAX_GAP}) SELECT sensor_id, ts, round(kw + 1e-9, 6) AS kw FROM grid x WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.sensor_id = x.sensor_id AND x.ts BETWEEN start_ts AND end_ts)")
def b4_drop_gaps(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    return clean.drop_gaps(clean.interpolate_grid(r, GRID), r, MAX_GAP).withColumn("kw", F.round(F.col("kw") + 1e-9, 6))


@query(f"WITH {_R} SELECT sensor_id, ts, round(kw - 5, 6) AS kw FROM r WHERE kw - 5 > 0")
def b5_drop_nonpositive(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_nonpositive(readings(spark, d).withColumn("kw", F.col("kw") - 5)).withColumn("kw", F.round("kw", 6))


@query(f"WITH {_F} SELECT camera_id, ts, CASE WHEN ts::DATE::VARCHAR IN ({_DAYS_SQL}) AND ts <> ts::DATE THEN 'test' ELSE 'trainval' END AS split FROM f")
def b6_split_by_days(spark: SparkSession, d: str) -> DataFrame:
    return samples.split_by_days(frames(spark, d), DAYS)


@query(f"WITH {_F} SELECT camera_id, ts, CASE WHEN ts::DATE::VARCHAR IN ({_SUNNY_SQL}) THEN 'sunny' ELSE 'cloudy' END AS cond FROM f")
def b7_label_condition(spark: SparkSession, d: str) -> DataFrame:
    return samples.label_condition(frames(spark, d), SUNNY)


_POS = _F + ", days AS (SELECT ts::DATE AS day, count(*) AS c, md5('1-' || ts::DATE::VARCHAR) AS k FROM f GROUP BY 1), b AS (SELECT day, coalesce(sum(c) OVER (ORDER BY k, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM days), p AS (SELECT camera_id, ts, (before + row_number() OVER (PARTITION BY day ORDER BY ts, camera_id) - 1)::BIGINT AS pos FROM f JOIN b ON ts::DATE = day), n AS (SELECT count(*) AS n FROM f)"


def shuffled(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    f = frames(spark, d)
    return samples.day_block_shuffle(f, 1, ties=["camera_id"]), f.count()


@query(f"WITH {_POS} SELECT * FROM p")
def f1_day_block_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return shuffled(spark, d)[0]


@query(f"WITH {_POS} SELECT camera_id, ts, pos, (SELECT max(i) FROM range(10) x(i) WHERE pos >= i * n // 10)::INT AS fold FROM p, n")
def f2_kfold(spark: SparkSession, d: str) -> DataFrame:
    p, n = shuffled(spark, d)
    return samples.kfold(p, 10, n)


@query(f"WITH {_POS} SELECT camera_id, ts, pos, CASE WHEN pos < floor(0.9 * n) THEN 'train' ELSE 'val' END AS split FROM p, n")
def f3_holdout(spark: SparkSession, d: str) -> DataFrame:
    p, n = shuffled(spark, d)
    return samples.holdout(p, 0.9, n)


@query(f"WITH {_POS} SELECT p.* FROM p, n WHERE pos < floor(0.25 * n)")
def b8_take_fraction(spark: SparkSession, d: str) -> DataFrame:
    p, n = shuffled(spark, d)
    return samples.take_fraction(p, 0.25, n)


@query(f"WITH {_F} SELECT * FROM f WHERE ts > (SELECT max(ts) FROM f WHERE ts < TIMESTAMP '2024-01-20')")
def b9_pending(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return samples.pending(f, f.where("ts < timestamp_ntz'2024-01-20 00:00:00'"))


@query(f"WITH {_F} SELECT * FROM f WHERE ts::DATE BETWEEN '2024-01-05' AND '2024-01-20' AND ts NOT IN (SELECT ts FROM f WHERE camera_id = (SELECT min(camera_id) FROM f))")
def b9_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a range of days at times for which the first camera has none."""
    f = frames(spark, d)
    first = f.agg(F.min("camera_id").alias("camera_id"))
    return samples.without_output(samples.in_days(f, "2024-01-05", "2024-01-20"), f.join(F.broadcast(first), "camera_id"), "ts").select("camera_id", "ts")


_STACK = _H + ", " + _F + ", pr AS (SELECT camera_id, f.ts, kw FROM f JOIN h ON h.sensor_id = camera_id AND h.ts = f.ts), st AS (SELECT a.camera_id, a.ts, list(b.kw ORDER BY j) AS pv_log FROM pr a, range(4) x(j), pr b WHERE b.camera_id = a.camera_id AND b.ts = a.ts - to_hours(j) GROUP BY 1, 2 HAVING count(*) = 4)"


@query(f"WITH {_STACK}, s2 AS (SELECT st.*, h.kw AS pv_pred, row_number() OVER (PARTITION BY st.camera_id ORDER BY st.ts) - 1 AS pos FROM st JOIN h ON h.sensor_id = st.camera_id AND h.ts = st.ts + INTERVAL 1 HOUR) SELECT camera_id, ts, round(pv_log[4], 6) AS oldest, round(pv_pred, 6) AS pv_pred FROM s2 WHERE pos % 5 = 0 AND pv_log[4] - pv_pred > 4")
def b10_find_ramps(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    s = samples.add_horizon(samples.lag_stack(frames(spark, d), h, 4, 3600), h, [3600])
    s = with_position(s.withColumn("day", F.to_date("ts")), "day", [F.col("day")], [F.col("ts")], series=("camera_id",))
    return samples.find_ramps(s, 5, 4.0).select("camera_id", "ts", F.round(F.element_at("pv_log", -1), 6).alias("oldest"), F.round("pv_pred", 6).alias("pv_pred"))


@query("SELECT vec_id, label, round(embedding[len(embedding)]::DOUBLE, 6) AS last FROM embeddings WHERE label < 5")
def b11_last_step(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label < 5").select("vec_id", "label", F.round(scoring.last_step(F.col("embedding")).cast("double"), 6).alias("last"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: greatest(-0.5, least(0.5, v::DOUBLE)) + 0.5)), 4) AS total FROM embeddings")
def b12_clip_shift(spark: SparkSession, d: str) -> DataFrame:
    x = pixels.clip_shift(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"WITH {_V} SELECT video, strftime(start_ts, '%Y/%m/%d/%Y%m%d%H%M%S.jpg') AS path FROM v")
def b13_dest_path(spark: SparkSession, d: str) -> DataFrame:
    return videos(spark, d).select("video", samples.dest_path(F.col("start_ts")).alias("path"))


_NAMES = _V + ", names AS (SELECT CASE video % 5 WHEN 0 THEN strftime(start_ts, '%Y%m%d-%H%M%S-01.avi') WHEN 1 THEN 'x' || strftime(start_ts, '%Y%m%d%H%M%S.jpg') WHEN 2 THEN 'junk' ELSE 'cam_' || strftime(start_ts, '%Y%m%d%H%M%S') || '_' || strftime(end_ts, '%Y%m%d%H%M%S') || '_1.avi' END AS name, * FROM v)"


@query(f"WITH {_NAMES} SELECT name, start_ts, CASE WHEN video % 5 > 2 THEN end_ts END AS end_ts FROM names WHERE video % 5 NOT IN (1, 2)")
def a4_parse_video_names(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("video") % 5, lambda c: F.date_format(c, "yyyyMMddHHmmss")
    long = F.concat(F.lit("cam_"), at("start_ts"), F.lit("_"), at("end_ts"), F.lit("_1.avi"))
    name = F.when(k == 0, F.date_format("start_ts", "yyyyMMdd-HHmmss'-01.avi'")).when(k == 1, F.concat(F.lit("x"), at("start_ts"), F.lit(".jpg"))).when(k == 2, "junk").otherwise(long)
    return samples.parse_video_names(videos(spark, d).withColumn("file", name), "file")


@query(f"WITH {_H}, {_F} SELECT camera_id, f.ts, round(kw, 6) AS kw FROM f JOIN h ON h.sensor_id = camera_id AND h.ts = f.ts")
def c1_pair_frames(spark: SparkSession, d: str) -> DataFrame:
    return samples.pair_frames(frames(spark, d), hourly(spark, d)).withColumn("kw", F.round("kw", 6))


@query(f"WITH {_H}, {_F} SELECT camera_id, f.ts, horizon, round(kw, 6) AS pv_pred FROM f, (VALUES (3600), (7200)) x(horizon), h WHERE h.sensor_id = camera_id AND h.ts = f.ts + to_seconds(horizon)")
def c2_add_horizon(spark: SparkSession, d: str) -> DataFrame:
    return samples.add_horizon(frames(spark, d), hourly(spark, d), [3600, 7200]).withColumn("pv_pred", F.round("pv_pred", 6))


@query(f"WITH {_STACK} SELECT camera_id, ts, round(pv_log[1], 6) AS now_kw, round(pv_log[4], 6) AS oldest_kw, len(pv_log)::INT AS n FROM st")
def c3_lag_stack(spark: SparkSession, d: str) -> DataFrame:
    s = samples.lag_stack(frames(spark, d), hourly(spark, d), 4, 3600)
    return s.select("camera_id", "ts", F.round(F.get("pv_log", 0), 6).alias("now_kw"), F.round(F.element_at("pv_log", -1), 6).alias("oldest_kw"), F.size("pv_log").alias("n"))


@query(f"WITH {_MAN} SELECT doc_id, path, chunk::INT AS chunk, crop::INT AS crop FROM man, range(5) a(chunk), range(3) b(crop)")
def c4_expand_views(spark: SparkSession, d: str) -> DataFrame:
    return views.expand_views(manifest(spark, d).select("doc_id", "path"), 5, 3)


@query("WITH c AS (SELECT md5(text) AS id, doc_id FROM documents), a AS (SELECT id, min(doc_id) AS doc_id FROM c WHERE doc_id % 4 > 0 GROUP BY 1), b AS (SELECT id, min(doc_id) AS doc_id FROM c WHERE doc_id % 4 = 0 GROUP BY 1) SELECT *, 'train' AS split FROM a UNION ALL SELECT *, 'val' FROM b WHERE id NOT IN (SELECT id FROM a)")
def c5_merge_corpora(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select(F.md5("text").alias("id"), "doc_id")
    return views.merge_corpora(c.where("doc_id % 4 > 0"), c.where("doc_id % 4 = 0"), "id", ["doc_id"])


@query("SELECT doc_id, CASE lang WHEN 'es' THEN 'romance' WHEN 'fr' THEN 'romance' ELSE lang END AS name, CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 0 WHEN 'en' THEN 1 WHEN 'de' THEN 2 END::INT AS class_id FROM documents")
def c6_map_labels(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([("romance", 0), ("en", 1), ("de", 2)], "name string, class_id int")
    return views.map_labels(table(spark, d, "documents").select("doc_id", "lang"), "lang", {"es": "romance", "fr": "romance"}, classes).select("doc_id", "name", "class_id")


@query("SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS a, round(embedding[2]::DOUBLE, 6) AS b, round(embedding[8]::DOUBLE, 6) AS c FROM embeddings")
def c7_remap_logits(spark: SparkSession, d: str) -> DataFrame:
    x = views.remap_logits(F.col("embedding"), [3, 1, 7])
    return table(spark, d, "embeddings").select("vec_id", x.alias("x")).select("vec_id", *[F.round(F.get("x", i).cast("double"), 6).alias(n) for i, n in enumerate("abc")])


@query(f"WITH {_R} SELECT sensor_id, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, round(arg_min(kw, ts), 6) AS kw FROM r GROUP BY 1, 2")
def d1_resample_first(spark: SparkSession, d: str) -> DataFrame:
    return clean.resample_first(readings(spark, d), GRID).withColumn("kw", F.round("kw", 6))


@query(f"WITH {_M} SELECT sample_id, round(avg(pred), 6) AS pred FROM m GROUP BY 1")
def d2_ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    return scoring.ensemble_mean(members(spark, d)).withColumn("pred", F.round("pred", 6))


@query(f"WITH {_M}, e AS (SELECT sample_id, avg(pred) AS pred FROM m GROUP BY 1) SELECT round(sqrt(avg((pred - obs) ** 2)), 4) AS rmse, count(*) AS n FROM e JOIN t USING (sample_id)")
def d3_rmse(spark: SparkSession, d: str) -> DataFrame:
    pairs = scoring.ensemble_mean(members(spark, d)).join(truth(spark, d), "sample_id")
    return pairs.agg(F.round(scoring.rmse("pred", "obs"), 4).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_M}, e AS (SELECT sample_id, avg(pred) AS pred FROM m GROUP BY 1) SELECT day, round(sqrt(avg((pred - obs) ** 2)) + 1e-7, 4) AS rmse, round(avg(abs(pred - obs)) + 1e-7, 4) AS mae, count(*) AS n FROM e JOIN t USING (sample_id) GROUP BY ROLLUP (day)")
def d4_daily_errors(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.daily_errors(scoring.ensemble_mean(members(spark, d)).join(truth(spark, d), "sample_id"))
    return out.select("day", F.round(F.col("rmse") + 1e-7, 4).alias("rmse"), F.round(F.col("mae") + 1e-7, 4).alias("mae"), "n")


_SC = _M + """, q AS (SELECT sample_id, avg(pred) AS pred, quantile_cont(pred, 0.05) AS q5, quantile_cont(pred, 0.25) AS q25, quantile_cont(pred, 0.5) AS q50, quantile_cont(pred, 0.75) AS q75, quantile_cont(pred, 0.95) AS q95 FROM m GROUP BY 1),
o AS (SELECT sample_id, pred AS x, row_number() OVER (PARTITION BY sample_id ORDER BY pred) AS i, count(*) OVER (PARTITION BY sample_id) AS c FROM m),
cr AS (SELECT sample_id, avg(abs(x - obs)) - sum((2 * i - c - 1) * x) / (max(c) * max(c)) AS crps FROM o JOIN t USING (sample_id) GROUP BY sample_id),
sc AS (SELECT q.*, obs, day, crps, CASE WHEN obs < q5 THEN q95 - q5 + 2 * (q5 - obs) / 0.1 WHEN obs > q95 THEN q95 - q5 + 2 * (obs - q95) / 0.1 ELSE q95 - q5 END AS winkler FROM q JOIN t USING (sample_id) JOIN cr USING (sample_id))"""


@query(f"WITH {_SC} SELECT sample_id, round(q5 + 1e-7, 4) AS q5, round(q25 + 1e-7, 4) AS q25, round(q50 + 1e-7, 4) AS q50, round(q75 + 1e-7, 4) AS q75, round(q95 + 1e-7, 4) AS q95 FROM sc")
def d5_ensemble_bands(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_samples(members(spark, d), truth(spark, d)).select("sample_id", *[F.round(F.col(q) + 1e-7, 4).alias(q) for q in ("q5", "q25", "q50", "q75", "q95")])


@query(f"WITH {_SC} SELECT sample_id, round(crps + 1e-7, 4) AS crps FROM sc")
def d6_crps(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_samples(members(spark, d), truth(spark, d)).select("sample_id", F.round(F.col("crps") + 1e-7, 4).alias("crps"))


@query(f"WITH {_SC} SELECT sample_id, round(winkler + 1e-7, 3) AS winkler FROM sc")
def d7_winkler(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_samples(members(spark, d), truth(spark, d)).select("sample_id", F.round(F.col("winkler") + 1e-7, 3).alias("winkler"))


@query(f"""WITH {_M}, k(n_samplings) AS (VALUES (1), (3), (5), (7)), w AS (SELECT n_samplings, m.* FROM m JOIN k ON sampling < n_samplings),
q AS (SELECT n_samplings, sample_id, avg(pred) AS pred, quantile_cont(pred, 0.05) AS q5, quantile_cont(pred, 0.95) AS q95 FROM w GROUP BY 1, 2),
o AS (SELECT n_samplings, sample_id, pred AS x, row_number() OVER (PARTITION BY n_samplings, sample_id ORDER BY pred) AS i, count(*) OVER (PARTITION BY n_samplings, sample_id) AS c FROM w),
cr AS (SELECT n_samplings, sample_id, avg(abs(x - obs)) - sum((2 * i - c - 1) * x) / (max(c) * max(c)) AS crps FROM o JOIN t USING (sample_id) GROUP BY 1, 2)
SELECT n_samplings::INT AS n_samplings, round(sqrt(avg((pred - obs) ** 2)), 3) AS rmse, round(avg(crps), 3) AS crps, round(avg(CASE WHEN obs < q5 THEN q95 - q5 + 2 * (q5 - obs) / 0.1 WHEN obs > q95 THEN q95 - q5 + 2 * (obs - q95) / 0.1 ELSE q95 - q5 END), 3) AS winkler, count(*) AS n
FROM q JOIN t USING (sample_id) JOIN cr USING (n_samplings, sample_id) GROUP BY 1""")
def d8_scaling_study(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.scaling_study(members(spark, d), truth(spark, d), NS)
    return out.select("n_samplings", *[F.round(c, 3).alias(c) for c in ("rmse", "crps", "winkler")], "n")


@query(f"WITH {_SC} SELECT sample_id % 3 AS source, year(day) AS test_set, round(sqrt(avg((pred - obs) ** 2)), 3) AS rmse, round(avg(crps), 3) AS crps, round(avg(winkler), 3) AS winkler FROM sc GROUP BY GROUPING SETS ((sample_id % 3, year(day)), (sample_id % 3))")
def d9_score_report(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.score_samples(members(spark, d), truth(spark, d)).withColumn("source", F.col("sample_id") % 3).withColumn("test_set", F.year("day").cast("long"))
    return scoring.score_report(s, "source", "test_set").withColumns({c: F.round(c, 3) for c in ("rmse", "crps", "winkler")})


@query(f"WITH {_H}, p AS (SELECT a.kw AS now, b.kw AS obs, (a.kw + z.kw) / 2 AS pred FROM h a JOIN h b ON b.sensor_id = a.sensor_id AND b.ts = a.ts + INTERVAL 1 HOUR JOIN h z ON z.sensor_id = a.sensor_id AND z.ts = a.ts - INTERVAL 1 HOUR), s AS (SELECT sqrt(avg((pred - obs) ** 2)) AS rmse, sqrt(avg((now - obs) ** 2)) AS per FROM p) SELECT round(rmse, 6) AS rmse, round(per, 6) AS persistence_rmse, round((1 - rmse / per) * 100, 4) AS skill FROM s")
def d10_forecast_skill(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumnRenamed("sensor_id", "camera_id")
    pv = h.withColumnRenamed("camera_id", "sensor_id")
    p = samples.add_horizon(samples.add_horizon(h.withColumnRenamed("kw", "now"), pv, [3600]).drop("horizon").withColumnRenamed("pv_pred", "obs"), pv, [-3600])
    out = scoring.forecast_skill(p.withColumn("pred", (F.col("now") + F.col("pv_pred")) / 2))
    return out.select(F.round("rmse", 6).alias("rmse"), F.round("persistence_rmse", 6).alias("persistence_rmse"), F.round("skill", 4).alias("skill"))


@query(f"WITH {_H}, s AS (SELECT kw, CASE WHEN ts::DATE::VARCHAR IN ({_DAYS_SQL}) AND ts <> ts::DATE THEN 'test' ELSE 'trainval' END AS split FROM h), g AS (SELECT split, min(kw) AS lo, max(kw) AS hi, count(*) AS n FROM s GROUP BY 1), b AS (SELECT split, least(floor((kw - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS c FROM s JOIN g USING (split) GROUP BY 1, 2), e AS (SELECT g.*, i::INT AS bin FROM g, range(20) x(i)) SELECT split, bin, round(coalesce(c, 0) / (n * ((hi - lo) / 20)), 6) AS density FROM e LEFT JOIN b USING (split, bin)")
def d11_density_hist(spark: SparkSession, d: str) -> DataFrame:
    out = samples.density_hist(samples.split_by_days(hourly(spark, d), DAYS), "kw", "split", 20)
    return out.withColumn("density", F.round("density", 6))


@query(f"WITH {_H} SELECT sensor_id, ts, m::INT AS model_id, s::INT AS sampling, round(kw * (m + 1) + 0.5 * s, 6) AS pred FROM h, range(3) a(m), range(4) b(s)")
def c8_score(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.score(hourly(spark, d), [1.0, 2.0, 3.0], 4, lambda model, sampling, batch: batch["kw"] * model + 0.5 * sampling)
    return out.select("sensor_id", "ts", "model_id", "sampling", F.round("pred", 6).alias("pred"))


_LOG = "SELECT l_suppkey AS run, l_returnflag AS metric, l_quantity::DOUBLE AS value, l_linenumber AS n, l_orderkey, l_partkey, l_extendedprice FROM lineitem"


def metric_log(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("metric"), F.col("l_quantity").cast("double").alias("value"), F.col("l_linenumber").alias("n"), "l_orderkey", "l_partkey", "l_extendedprice")


@query(f"WITH l AS ({_LOG}) SELECT run, metric, round(sum(value * n) / sum(n), 6) AS value, sum(n)::BIGINT AS n FROM l GROUP BY 1, 2")
def d12_merge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scoring.merge_metrics(metric_log(spark, d)).withColumn("value", F.round("value", 6))


def merged(spark: SparkSession, d: str, method: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 10).alias("clip"), (F.floor(F.col("vec_id") / 2) % 5).alias("chunk"), (F.col("vec_id") % 2).alias("crop"), "label", F.col("embedding").cast("array<double>").alias("logits"), F.lit(0).alias("again"))
    repeated = rows.where(F.col("clip") % 7 == 0).withColumn("logits", F.reverse("logits")).withColumn("again", F.lit(1))
    return views.merge_views(rows.unionByName(repeated), ["again"], method)


_MV = """e AS (SELECT vec_id // 10 AS clip, (vec_id // 2) % 5 AS chunk, vec_id % 2 AS crop, label, list_transform(embedding, lambda v: v::DOUBLE) AS x, vec_id, 0 AS again FROM embeddings),
e2 AS (SELECT * FROM e UNION ALL SELECT clip, chunk, crop, label, list_reverse(x), vec_id, 1 FROM e WHERE clip % 7 = 0),
one AS (SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY clip, chunk, crop ORDER BY again) = 1),
l AS (SELECT clip, label, unnest(x) AS v, unnest(range(len(x))) AS k, vec_id FROM one),
z AS (SELECT clip, vec_id, k, exp(v - max(v) OVER w) / 1.0 AS ev FROM l WINDOW w AS (PARTITION BY vec_id)),
s AS (SELECT clip, k, ev / sum(ev) OVER (PARTITION BY vec_id) AS p FROM z),
mg AS (SELECT clip, k, avg(p) AS p FROM s GROUP BY 1, 2), lab AS (SELECT clip, min(label) AS label FROM one GROUP BY 1)"""


@query(f"WITH {_MV} SELECT clip, label, k::INT AS k, round(p, 6) AS p FROM mg JOIN lab USING (clip)")
def d13_merge_views(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d, "prob").select("clip", "label", F.posexplode("merged").alias("k", "p")).withColumn("p", F.round("p", 6))


@query(f"WITH {_MV}, r AS (SELECT clip, k, row_number() OVER (PARTITION BY clip ORDER BY p DESC, k) AS rn FROM mg), c AS (SELECT clip, min(rn) FILTER (k = label) AS rn FROM r JOIN lab USING (clip) GROUP BY 1) SELECT round(avg(CASE WHEN rn <= 1 THEN 100.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rn <= 5 THEN 100.0 ELSE 0 END), 6) AS top5, count(*) AS n FROM c")
def d14_topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = views.topk_accuracy(merged(spark, d, "prob"), [1, 5])
    return out.select(F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"), "n")


@query(f"WITH {_F} SELECT camera_id, CASE WHEN ts::DATE::VARCHAR IN ({_DAYS_SQL}) AND ts <> ts::DATE THEN 'test' ELSE 'trainval' END AS split, count(*) AS n FROM f GROUP BY 1, 2")
def d15_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return samples.split_counts(samples.split_by_days(frames(spark, d), DAYS), ["camera_id"])


@query(f"WITH {_G} SELECT sensor_id, ts, round(kw + 1e-9, 6) AS kw FROM grid")
def e1_interpolate_grid(spark: SparkSession, d: str) -> DataFrame:
    return clean.interpolate_grid(readings(spark, d), GRID).withColumn("kw", F.round(F.col("kw") + 1e-9, 6))


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def e2_gaps(spark: SparkSession, d: str) -> DataFrame:
    return clean.gaps(readings(spark, d), MAX_GAP)


@query("WITH x AS (SELECT event_id, ts, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events) SELECT event_id, event_type FROM x WHERE before IS NULL OR before <> event_type")
def e3_drop_repeats(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_repeats(table(spark, d, "events"), "event_type", ties=("event_id",)).select("event_id", "event_type")


@query(f"WITH RECURSIVE {_R}, c AS (SELECT sensor_id AS camera_id, epoch(ts)::BIGINT AS s, row_number() OVER (PARTITION BY sensor_id ORDER BY ts) AS i FROM r), w AS (SELECT camera_id, i, s, s AS last, false AS kept FROM c WHERE i = 1 UNION ALL SELECT c.camera_id, c.i, c.s, CASE WHEN c.s - w.last > 7199 THEN c.s ELSE w.last END, c.s - w.last > 7199 FROM w JOIN c ON c.camera_id = w.camera_id AND c.i = w.i + 1) SELECT camera_id, make_timestamp(s * 1000000) AS ts FROM w WHERE kept")
def e4_thin(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).select(F.col("sensor_id").alias("camera_id"), "ts")
    return samples.thin(r, r.groupBy("camera_id").agg(F.min("ts").alias("ts")), 7199)


@query(f"WITH {_H}, x AS (SELECT sensor_id, ts::DATE AS day, kw, row_number() OVER (PARTITION BY sensor_id, ts::DATE ORDER BY ts) AS i FROM h) SELECT sensor_id, day, count(*) AS n, round(sum(i * kw), 4) AS weighted FROM x GROUP BY 1, 2")
def e5_day_series(spark: SparkSession, d: str) -> DataFrame:
    s = clean.day_series(hourly(spark, d)).select("sensor_id", "day", F.posexplode("series").alias("i", "x"))
    return s.groupBy("sensor_id", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("i") + 1) * F.col("x.kw")), 4).alias("weighted"))


@query(f"WITH {_H}, x AS (SELECT sensor_id, ts, kw, ts::DATE AS day FROM h UNION ALL SELECT sensor_id, ts, kw, ts::DATE - 1 FROM h WHERE ts = ts::DATE) SELECT sensor_id, day, count(*) AS n, round(arg_min(kw, ts), 6) AS first_kw, round(arg_max(kw, ts), 6) AS last_kw FROM x GROUP BY 1, 2")
def e5_daily_profile(spark: SparkSession, d: str) -> DataFrame:
    out = clean.daily_profile(hourly(spark, d), True)
    return out.select("sensor_id", "day", "n", F.round("first_kw", 6).alias("first_kw"), F.round("last_kw", 6).alias("last_kw"))


@query(f"WITH l AS ({_LOG}), o AS (SELECT run, l_orderkey, n, l_partkey, value, list(value) OVER w AS x, avg(value) OVER w AS mean_n, avg(value) OVER (PARTITION BY run ORDER BY l_orderkey, n, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS mean_all FROM l WINDOW w AS (PARTITION BY run ORDER BY l_orderkey, n, l_partkey, l_extendedprice ROWS 19 PRECEDING)) SELECT run, l_orderkey, n, l_partkey, value, round(mean_n, 6) AS mean_n, round(mean_all, 6) AS mean_all, list_sort(x)[(len(x) + 1) // 2] AS median_n, list_min(x) AS min_n, list_max(x) AS max_n FROM o")
def e6_rolling_meter(spark: SparkSession, d: str) -> DataFrame:
    out = clean.rolling_meter(metric_log(spark, d).drop("metric"), "run", ["l_orderkey", "n", "l_partkey", "l_extendedprice"], "value", F.floor(F.col("l_orderkey") / 1024))
    return out.select("run", "l_orderkey", "n", "l_partkey", "value", F.round("mean_n", 6).alias("mean_n"), F.round("mean_all", 6).alias("mean_all"), "median_n", "min_n", "max_n")


@query(f"WITH {_MAN} SELECT doc_id, unnest(range(0, total - 15, 4))::INT AS start FROM man WHERE total >= 16")
def e7_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).select("doc_id", F.explode(views.sliding_windows(F.col("total"), 16, 4)).alias("start"))


@query("SELECT vec_id // 64 AS video, count(*) AS n, round(first(embedding[1] ORDER BY vec_id)::DOUBLE, 6) AS head, round(last(embedding[1] ORDER BY vec_id)::DOUBLE, 6) AS tail FROM embeddings GROUP BY 1")
def e8_stack_features(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("video", F.floor(F.col("vec_id") / 64))
    s = views.stack_features(e, "video", "vec_id", "embedding")
    head = lambda i: F.round(F.element_at(F.element_at("features", i), 1).cast("double"), 6)
    return s.select("video", F.size("features").cast("long").alias("n"), head(1).alias("head"), head(-1).alias("tail"))


@query(f"WITH {_R} SELECT sensor_id, ts, (epoch(ts)::BIGINT % 86400) AS clock FROM r")
def e9_clock_time(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("sensor_id", "ts", clean.clock_time(F.col("ts")).alias("clock"))


@query("WITH l AS (SELECT user_id % 10 AS fold, event_id AS epoch, value::DOUBLE AS val_loss, value::DOUBLE / 2 AS train_loss FROM events) SELECT fold, epoch, val_loss, train_loss, round(sqrt(val_loss), 6) AS rmse FROM l QUALIFY row_number() OVER (PARTITION BY fold ORDER BY val_loss, epoch) = 1")
def f4_best_epochs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("fold"), F.col("event_id").alias("epoch"), F.col("value").cast("double").alias("val_loss"), (F.col("value").cast("double") / 2).alias("train_loss"))
    return scoring.best_epochs(e).withColumn("rmse", F.round("rmse", 6))


@query("WITH l AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings) SELECT vec_id, k::INT AS k, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) - 1 AS rn FROM l) WHERE rn < 5")
def f5_topk_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(views.top_classes(F.col("embedding"), 5)).alias("rank", "k"))


@query(f"WITH {_F} SELECT DISTINCT ts::DATE AS day FROM f WHERE ts::DATE::VARCHAR NOT IN ({_DAYS_SQL})")
def f6_complement_days(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in DAYS], "day string").select(F.to_date("day").alias("day"))
    return samples.complement(samples.distinct_days(frames(spark, d)), listed)


@query(f"WITH {_F} SELECT camera_id, max(ts) AS ts FROM f GROUP BY 1")
def f7_latest_frame(spark: SparkSession, d: str) -> DataFrame:
    return samples.latest_frame(frames(spark, d))


@query(f"WITH {_V}, g AS (SELECT *, (epoch(start_ts)::BIGINT // 10 + 1) * 10 AS a, epoch(start_ts)::BIGINT AS s, epoch(end_ts)::BIGINT AS e FROM v) SELECT video, make_timestamp(t * 1000000) AS shot_ts, (t - s) * 1000 AS offset_ms FROM (SELECT *, unnest(range(a, e + 1, 60)) AS t FROM g)")
def g1_capture_plan(spark: SparkSession, d: str) -> DataFrame:
    return samples.capture_plan(videos(spark, d))


_DENSE = f"""WITH {_MAN}, x AS (SELECT doc_id, total AS n, k, total // 4 AS many, (64 + total) // 2 AS e FROM man, range(16) r(k)),
y AS (SELECT *, CASE WHEN n <= 64 THEN trunc(greatest(0, least(CASE WHEN k < many THEN CASE WHEN many > 1 THEN k * n / (many - 1) ELSE 0 END ELSE n END, n - 1)))
ELSE trunc(greatest(e - 64, least((e - 64) + k * 64 / 15, e - 1))) END::INT AS i FROM x) SELECT doc_id, sum(i)::BIGINT AS total, min(i) AS first, max(i) AS last FROM y GROUP BY 1"""


def _summed(df: DataFrame, ids) -> DataFrame:
    x = df.select("doc_id", F.explode(ids).alias("i"))
    return x.groupBy("doc_id").agg(F.sum("i").alias("total"), F.min("i").alias("first"), F.max("i").alias("last"))


@query(_DENSE)
def g2_dense_clip(spark: SparkSession, d: str) -> DataFrame:
    return _summed(manifest(spark, d), views.dense_clip(F.col("total"), 16, 4))


@query(f"""WITH {_MAN}, x AS (SELECT doc_id, total // 2 AS n, i, k, (total // 2) // 4 AS many, 64 + ('0x' || substr(md5('5-' || path || '-' || i), 1, 8))::BIGINT % greatest(total // 2 - 64, 1) AS e FROM man, range(2) s(i), range(16) r(k)),
y AS (SELECT doc_id, i * n + CASE WHEN n <= 64 THEN trunc(greatest(0, least(CASE WHEN k < many THEN CASE WHEN many > 1 THEN k * n / (many - 1) ELSE 0 END ELSE n END, n - 1))) ELSE trunc(least((e - 64) + k * 64 / 15, e - 1)) END::INT AS i FROM x)
SELECT doc_id, sum(i)::BIGINT AS total, min(i) AS first, max(i) AS last FROM y GROUP BY 1""")
def g2_dense_train(spark: SparkSession, d: str) -> DataFrame:
    return _summed(manifest(spark, d), views.dense_train(F.col("total"), F.col("path"), 16, 4, 2, 5))


@query(f"WITH {_MAN}, y AS (SELECT doc_id, floor(s * (total / 8) / 3 + (total / 8) * x)::INT AS i FROM man, range(3) a(s), range(8) b(x)) SELECT doc_id, sum(i)::BIGINT AS total, min(i) AS first, max(i) AS last FROM y GROUP BY 1")
def g4_sparse_test(spark: SparkSession, d: str) -> DataFrame:
    return _summed(manifest(spark, d), views.sparse_test(F.col("total"), 8, 3))


@query(f"WITH {_MAN}, x AS (SELECT doc_id, total AS n, range(0, total, 4) AS r FROM man WHERE total > 0), y AS (SELECT doc_id, unnest(CASE WHEN len(r) < 16 THEN list_concat(r, list_transform(range(16 - len(r)), lambda q: r[len(r)])) ELSE r END)::INT AS i FROM x) SELECT doc_id, sum(i)::BIGINT AS total, min(i) AS first, max(i) AS last FROM y GROUP BY 1")
def g3_dense_test(spark: SparkSession, d: str) -> DataFrame:
    return _summed(manifest(spark, d).where("total > 0"), views.dense_test(F.col("total"), 16, 4))


@query(f"WITH {_MAN}, y AS (SELECT doc_id, CASE WHEN total // 16 > 0 THEN k * (total // 16) + (total // 16) // 2 ELSE greatest(0, k - (16 - total)) END::INT AS i FROM man, range(16) r(k)) SELECT doc_id, sum(i)::BIGINT AS total, min(i) AS first, max(i) AS last FROM y GROUP BY 1")
def g4_sparse_clip(spark: SparkSession, d: str) -> DataFrame:
    return _summed(manifest(spark, d), views.sparse_clip(F.col("total"), 16))


@query(f"""WITH {_MAN}, y AS (SELECT doc_id, 1 + CASE WHEN total // 16 > 0 THEN k * (total // 16) + ('0x' || substr(md5('9-' || path || '-' || k), 1, 8))::BIGINT % greatest(total // 16, 1) ELSE greatest(0, k - (16 - total)) END::INT AS i FROM man, range(16) r(k))
SELECT doc_id, sum(i)::BIGINT AS total, min(i)::INT AS first, max(i)::INT AS last FROM y GROUP BY 1""")
def g4_sparse_train(spark: SparkSession, d: str) -> DataFrame:
    return _summed(manifest(spark, d), views.sparse_train(F.col("total"), F.col("path"), 16, 9, 1))


@query(f"""WITH {_MAN}, x AS (SELECT doc_id, doc_id % 5 AS start, total AS n, CASE doc_id % 3 WHEN 0 THEN 'SomethingV2/' WHEN 1 THEN 'AVA2.2/' ELSE 'other/' END || path AS path, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 4 END AS st FROM man),
y AS (SELECT *, floor((n - 16 * st + 1) / 3)::BIGINT AS part, list_transform(range(3), lambda k: ('0x' || substr(md5('7-' || path || '-' || k), 1, 8))::BIGINT) AS h FROM x),
z AS (SELECT *, CASE WHEN part > 0 THEN list_transform(range(3), lambda k: k * part + h[k + 1] % greatest(part, 1)) WHEN n > greatest(3, 16 * st) THEN list_sort(list_transform(h, lambda v: v % greatest(n - 16 * st + 1, 1))) ELSE [0, 0, 0] END AS s FROM y),
w AS (SELECT doc_id, path, start, k, i, (s[k + 1] + st * least(i, greatest(ceil((n - 1 - s[k + 1]) / st) - 1, 0)))::BIGINT AS frame FROM z, range(3) a(k), range(16) b(i)),
f AS (SELECT doc_id, k, i, frame, path || '/' || CASE doc_id % 3 WHEN 1 THEN printf('image_%06d.jpg', frame + start) ELSE printf('img_%05d.jpg', frame + start) END AS file FROM w)
SELECT doc_id, count(*) AS n, sum(frame)::BIGINT AS total, md5(string_agg(file, ' ' ORDER BY k, i)) AS files FROM f GROUP BY 1""")
def g5_pretrain_frames(spark: SparkSession, d: str) -> DataFrame:
    """File names of three stretches a clip, named and stepped by source."""
    source = F.when(F.col("doc_id") % 3 == 0, "SomethingV2").when(F.col("doc_id") % 3 == 1, "AVA2.2").otherwise("other")
    m = manifest(spark, d).withColumn("path", F.concat_ws("/", source, "path")).withColumn("start", F.col("doc_id") % 5)
    out = views.pretrain_frames(m, 16, 4, 7, segments=3)
    return out.select("doc_id", F.size("frames").cast("long").alias("n"), F.aggregate("frames", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.md5(F.array_join("files", " ")).alias("files"))


@query(f"WITH {_MAN}, z AS (SELECT doc_id, total, chunk, crop, 240 + doc_id % 100 AS height, 320 - doc_id % 100 AS width FROM man, range(5) a(chunk), range(3) b(crop)) SELECT doc_id, chunk::INT AS chunk, crop::INT AS crop, floor(chunk * greatest((total - 16) / 4, 0))::INT AS frame0, floor(crop * ((greatest(height, width) - 224) / 2))::INT AS pixel0, CASE WHEN height >= width THEN 'height' ELSE 'width' END AS axis FROM z")
def g6_view_slices(spark: SparkSession, d: str) -> DataFrame:
    m = views.expand_views(manifest(spark, d), 5, 3).withColumn("height", 240 + F.col("doc_id") % 100).withColumn("width", 320 - F.col("doc_id") % 100)
    return views.view_slices(m, 16, 5, 3, 224).select("doc_id", "chunk", "crop", "frame0", "pixel0", "axis")


@query(f"WITH {_MAN}, x AS (SELECT doc_id, total AS n, 1 + ('0x' || substr(md5('7-' || path), 1, 8))::BIGINT % greatest(total - 31, 1) AS s FROM man WHERE total > 0), y AS (SELECT doc_id, (s + 2 * least(k, greatest(floor((n - s - 1) / 2), 0)))::INT AS i FROM x, range(16) r(k)) SELECT doc_id, sum(i)::BIGINT AS total, min(i) AS first, max(i) AS last FROM y GROUP BY 1")
def g5_pretrain_clip(spark: SparkSession, d: str) -> DataFrame:
    return _summed(manifest(spark, d).where("total > 0"), views.pretrain_clip(F.col("total"), F.col("path"), 16, 2, 7))


@query(f"WITH {_MAN} SELECT doc_id, label, c::INT AS copy FROM man, range(1, 4) r(c)")
def g7_repeat_samples(spark: SparkSession, d: str) -> DataFrame:
    return views.repeat_samples(manifest(spark, d).select("doc_id", "label"), 3)


_PX = "l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings)"


@query(f"WITH {_PX} SELECT vec_id, round(sum(CASE WHEN (k // 8 - 3) ** 2 + (k % 8 - 3) ** 2 < 9 THEN v ELSE 0 END), 4) AS total FROM l GROUP BY 1")
def p3_mask_sky(spark: SparkSession, d: str) -> DataFrame:
    x = pixels.mask_sky(F.col("embedding").cast("array<double>"), 8, 3, 3, 3)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"WITH {_PX} SELECT vec_id, round(sum((v / 255 - 0.485) / 0.229), 4) AS total FROM l GROUP BY 1")
def p4_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = pixels.normalize(F.col("embedding").cast("array<double>"), pixels.MEAN[0], pixels.STD[0])
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"WITH {_PX}, n AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT n.vec_id, round(sum(abs(a.v - b.v)), 4) AS delta FROM n JOIN l a ON a.vec_id = n.vec_id JOIN l b ON b.vec_id = n.p AND b.k = a.k GROUP BY 1")
def p5_frame_delta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("ts", from_seconds(F.col("vec_id") * 60))
    e = with_neighbour(e, "label", "ts", ["embedding"], ahead=False, prefix="last_").where("last_embedding is not null")
    return e.select("vec_id", F.round(pixels.delta(F.col("embedding").cast("array<double>"), F.col("last_embedding").cast("array<double>")), 4).alias("delta"))


@query("WITH r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY md5('3-' || vec_id || '-' || k), k) AS rn FROM embeddings, range(16) x(k)) SELECT vec_id, sum(CASE WHEN rn <= 12 THEN 2 * k ELSE 0 END)::BIGINT AS weighted, 24::BIGINT AS ones FROM r GROUP BY 1")
def p7_tube_mask(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "embeddings").select("vec_id", F.posexplode(pixels.tube_mask(F.col("vec_id"), 2, 16, 0.75, 3)).alias("i", "v"))
    return m.groupBy("vec_id").agg(F.sum(F.col("v") * (F.col("i") % 16)).alias("weighted"), F.sum("v").cast("long").alias("ones"))


@query("WITH r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY md5('3-' || vec_id || '-' || k), k) AS rn FROM embeddings, range(32) x(k)) SELECT vec_id, sum(CASE WHEN rn <= 24 THEN k ELSE 0 END)::BIGINT AS weighted, 24::BIGINT AS ones FROM r GROUP BY 1")
def p7_random_mask(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "embeddings").select("vec_id", F.posexplode(pixels.random_mask(F.col("vec_id"), 2, 16, 0.75, 3)).alias("i", "v"))
    return m.groupBy("vec_id").agg(F.sum(F.col("v") * F.col("i")).cast("long").alias("weighted"), F.sum("v").cast("long").alias("ones"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), y AS (SELECT vec_id, v, ((i % 16) // 4) // 2 * 2 + (i % 4) // 2 AS patch, i // 32 AS t FROM x), s AS (SELECT vec_id, v, patch, t, avg(v) OVER w AS a, stddev_samp(v) OVER w AS sd FROM y WINDOW w AS (PARTITION BY vec_id, patch, t)) SELECT vec_id, (t * 4 + patch)::INT AS patch, round(max((v - a) / (sd + 1e-6)) + 1e-9, 5) AS most, count(*) AS n FROM s GROUP BY 1, 2")
def p9_patch_targets(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of 64 as clips of 4 frames of 4 x 4 pixels, in patches of 2 x 2 x 2."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("clip"))
    t = pixels.with_patch_targets(e, (4, 4, 4, 1), 2).select("vec_id", F.posexplode("targets").alias("patch", "x"))
    return t.select("vec_id", "patch", F.round(F.array_max("x") + 1e-9, 5).alias("most"), F.size("x").cast("long").alias("n"))


@query("SELECT vec_id, sum(CASE WHEN (2 * ((k // 4) % 4 % 2) + k % 4 % 2 + vec_id % 4 + k // 16 + 1) % 4 < 2 THEN k ELSE 0 END)::BIGINT AS weighted, count(*) FILTER ((2 * ((k // 4) % 4 % 2) + k % 4 % 2 + vec_id % 4 + k // 16 + 1) % 4 < 2) AS ones FROM embeddings, range(64) x(k) GROUP BY 1")
def p8_running_cell_mask(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "embeddings").select("vec_id", F.posexplode(pixels.running_cell_mask(F.col("vec_id") % 4, 4, 4, 4, 0.5)).alias("i", "v"))
    return m.groupBy("vec_id").agg(F.sum(F.col("v") * F.col("i")).cast("long").alias("weighted"), F.sum("v").cast("long").alias("ones"))


@query(f"WITH {_PX}, q AS (SELECT label, vec_id, k // 8 AS patch, (v - 0.1) ** 2 AS e FROM l JOIN embeddings USING (vec_id) WHERE (k // 8) % 2 = 0 AND (k // 8) <> 4), m AS (SELECT vec_id, patch, avg(e) AS e FROM q GROUP BY 1, 2) SELECT vec_id AS sample, round(avg(e), 6) AS loss, count(*) AS patches FROM m GROUP BY 1")
def p10_masked_mse(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "pred"))
    long = long.withColumn("patch", F.floor(F.col("k") / 8)).withColumn("target", F.lit(0.1)).withColumn("hidden", F.col("patch") % 2 == 0).withColumn("decoded", F.col("patch") != 4)
    return pixels.masked_mse(long).withColumn("loss", F.round("loss", 6))


def _weighted(x: Column) -> Column:
    """Values times their place from 1, added up: an array that is moved or cut elsewhere has another sum."""
    return F.round(F.aggregate(F.transform(x, lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v) + 1e-9, 4)


def pictures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(f"WITH {_PX} SELECT vec_id, round(sum(v * ((k // 8 - 2) * 4 + k % 8 - 2 + 1)) + 1e-9, 4) AS weighted FROM l WHERE k // 8 BETWEEN 2 AND 5 AND k % 8 BETWEEN 2 AND 5 GROUP BY 1")
def p1_center_crop(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("vec_id", _weighted(pixels.center_crop_array(F.col("x"), (8, 8, 1), 4, 4)).alias("weighted"))


@query("""WITH g AS (SELECT k, greatest(0, least(7, (k // 6 + 0.5) * 8 / 5 - 0.5)) AS y, greatest(0, least(7, (k % 6 + 0.5) * 8 / 6 - 0.5)) AS x FROM range(30) r(k)),
h AS (SELECT k, floor(y)::INT AS y0, least(floor(y)::INT + 1, 7) AS y1, y - floor(y) AS fy, floor(x)::INT AS x0, least(floor(x)::INT + 1, 7) AS x1, x - floor(x) AS fx FROM g),
e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS p FROM embeddings)
SELECT vec_id, round(sum((k + 1) * ((p[y0 * 8 + x0 + 1] * (1 - fy) + p[y1 * 8 + x0 + 1] * fy) * (1 - fx) + (p[y0 * 8 + x1 + 1] * (1 - fy) + p[y1 * 8 + x1 + 1] * fy) * fx)) + 1e-9, 4) AS weighted FROM e, h GROUP BY 1""")
def p2_resize(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("vec_id", _weighted(pixels.resize_array(F.col("x"), (8, 8, 1), 5, 6)).alias("weighted"))


@query("WITH l AS (SELECT vec_id, unnest(embedding[1:63])::DOUBLE AS v, unnest(range(63)) AS k FROM embeddings) SELECT vec_id, round(sum((k + 1) * (v / 255 - [0.485, 0.456, 0.406][k % 3 + 1]) / [0.229, 0.224, 0.225][k % 3 + 1]) + 1e-9, 4) AS weighted FROM l GROUP BY 1")
def p4_normalize_channels(spark: SparkSession, d: str) -> DataFrame:
    """63 values as 3 x 7 pixels of three channels."""
    return pictures(spark, d).select("vec_id", _weighted(pixels.normalize_channels(F.slice("x", 1, 63))).alias("weighted"))


_SQUARE = ", ".join([f"round(sum((k // 16 * 4 + k % 16 - {a} + 1) * v) FILTER (k % 16 BETWEEN {a} AND {a + 3}) + 1e-9, 4) AS wide{i}" for i, a in enumerate((0, 6, 12))] + [f"round(sum((k - {a * 4} + 1) * v) FILTER (k // 4 BETWEEN {a} AND {a + 3}) + 1e-9, 4) AS tall{i}" for i, a in enumerate((0, 6, 12))])


@query(f"WITH {_PX} SELECT vec_id, {_SQUARE} FROM l GROUP BY 1")
def p6_uniform_crop(spark: SparkSession, d: str) -> DataFrame:
    """The three squares of 64 values as 4 x 16 and as 16 x 4 pixels."""
    cut = lambda shape, i: _weighted(pixels.uniform_crop_array(F.col("x"), shape, 4, i))
    return pictures(spark, d).select("vec_id", *[cut((4, 16, 1), i).alias(f"wide{i}") for i in range(3)], *[cut((16, 4, 1), i).alias(f"tall{i}") for i in range(3)])


def two_layouts(spark: SparkSession, d: str) -> str:
    """A folder with events as CSV files of two layouts, in ``a`` and ``b``, with a comma in the value's name."""
    at = new_folder(spark, "csv")
    e = table(spark, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Date"), F.col("value").cast("double").alias("power, kW"))
    e.where("event_id % 2 = 0").select("Date", "power, kW", "event_type").write.option("header", True).csv(f"{at}/a")
    e.where("event_id % 2 = 1").select("event_type", F.concat_ws(", ", F.lit("no"), "event_id").alias("note"), "power, kW", "Date").write.option("header", True).csv(f"{at}/b")
    return at


@query("SELECT date_trunc('second', ts)::TIMESTAMP AS ts, round(value::DOUBLE, 6) AS kw, count(*) AS n FROM events GROUP BY 1, 2")
def a1_read_pv_csv(spark: SparkSession, d: str) -> DataFrame:
    """Times and values of CSV files of two layouts."""
    at, value = two_layouts(spark, d), "power, kW"
    read = files.read_pv_csv(spark, [f"{at}/a", f"{at}/b"], value)
    return read.groupBy("ts", F.round("kw", 6).alias("kw")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, event_type, CASE WHEN event_id % 2 = 1 THEN 'no, ' || event_id END AS note, round(value::DOUBLE, 6) AS kw FROM events")
def a1_union_csvs(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the files of both layouts, by name."""
    at = two_layouts(spark, d)
    out = files.read_csvs(spark, [f"{at}/a", f"{at}/b"])
    return out.select(F.col("Date").alias("date"), "event_type", "note", F.round(F.col("`power, kW`").cast("double"), 6).alias("kw"))


@query(f"WITH {_R} SELECT sensor_id, ts, round(kw, 6) AS kw FROM r WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'")
def a2_series_store(spark: SparkSession, d: str) -> DataFrame:
    """The series stored by day, a week of it stored again, and a stretch read back."""
    at, r = new_folder(spark, "series"), readings(spark, d)
    files.write_series(r, at)
    files.write_series(clean.between_times(r, "2024-01-08 00:00:00", "2024-01-15 00:00:00", "left"), at)
    out = files.read_series(spark, at, "2024-01-05 06:00:00", "2024-01-12 18:00:00")
    return out.select("sensor_id", "ts", F.round("kw", 6).alias("kw"))


_STORED = "d AS (SELECT source, TIMESTAMP '2024-01-01' + to_minutes(doc_id % 1000 * 43 + doc_id // 1000) AS ts FROM documents WHERE doc_id IS NOT NULL)"


@query(f"WITH {_STORED} SELECT DISTINCT strftime(ts, '%Y/%m/') || source || strftime(ts, '/%d/%Y%m%d%H%M%S.jpg') AS path, ts FROM d WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'")
def a3_list_frames(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a frame folder, and the frames of some days."""
    at = new_folder(spark, "frames")
    docs = table(spark, d, "documents").where("doc_id is not null")
    ts = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") % 1000 * 43 + F.floor(F.col("doc_id") / 1000)).cast("int"))).cast("timestamp_ntz")
    path = F.concat_ws("/", F.date_format(ts, "yyyy"), F.date_format(ts, "MM"), "source", F.date_format(ts, "dd"), F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lit(".jpg")))
    files.write_frames(docs.select(path.alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("data")), at)
    out = files.list_frames(spark, at, "2024-01-05 06:00:00", "2024-01-12 18:00:00", by_day=True)
    return out.select(F.regexp_extract("path", r"(\d{4}/\d{2}/[^/]+/\d{2}/\d{14}\.jpg)$", 1).alias("path"), "ts")


@query(f"WITH {_F} SELECT camera_id, ts FROM f WHERE ts::DATE::VARCHAR IN ({_DAYS_SQL}) AND ts <> ts::DATE AND ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-20 12:00:00'")
def a5_sample_store(spark: SparkSession, d: str) -> DataFrame:
    """Samples stored by split and day in batches, one of them twice, and the test samples of a stretch read back."""
    at, s = new_folder(spark, "samples"), samples.split_by_days(frames(spark, d), DAYS)
    early, late = (s.where(f"to_date(ts) {sign} date'2024-01-10'") for sign in ("<", ">="))
    for batch in (early, late, early):
        files.write_samples(batch, at)
    return files.read_samples(spark, at, "test", "2024-01-04 00:00:00", "2024-01-20 12:00:00").select("camera_id", "ts")


_LINES = _MAN + ", t AS (SELECT CASE WHEN doc_id % 17 = 0 THEN concat_ws(' ', path, total) WHEN doc_id % 19 = 0 THEN concat_ws(' ', path, total, 'x') ELSE concat_ws(' ', path, total, label) END AS line, * FROM man)"


@query(f"WITH {_LINES} SELECT CASE WHEN doc_id % 17 > 0 AND doc_id % 19 > 0 THEN 'root/' || path END AS path, CASE WHEN doc_id % 17 > 0 AND doc_id % 19 > 0 THEN total END::INT AS total, CASE WHEN doc_id % 17 > 0 AND doc_id % 19 > 0 THEN label END::INT AS label, CASE WHEN doc_id % 17 = 0 THEN 'short manifest line' WHEN doc_id % 19 = 0 THEN 'manifest line whose label isn''t a number' END AS reason, CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN line END AS line FROM t")
def a6_read_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with some bad lines: its entries, and the report of the others."""
    at, m = new_folder(spark, "manifest"), manifest(spark, d)
    bad = F.when(F.col("doc_id") % 17 == 0, F.concat_ws(" ", "path", "total")).when(F.col("doc_id") % 19 == 0, F.concat_ws(" ", "path", "total", F.lit("x")))
    m.select(F.coalesce(bad, F.concat_ws(" ", "path", "total", "label")).alias("value")).write.text(at)
    right = files.read_manifest(spark, at, "frames", "root", strict=False)
    return right.unionByName(files.manifest_errors(spark, at, "frames").select("reason", "line"), allowMissingColumns=True)


@query("SELECT vec_id::VARCHAR AS clip_id, label::DOUBLE AS label, (vec_id % 5)::INT AS chunk, (vec_id % 3)::INT AS crop, len(embedding)::INT AS n, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * embedding[i]::DOUBLE)) + 1e-9, 4) AS weighted FROM embeddings")
def a7_prediction_shards(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as prediction shards, read back."""
    at = new_folder(spark, "shards")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("logits"), "label", (F.col("vec_id") % 5).alias("chunk"), (F.col("vec_id") % 3).alias("crop"))
    files.write_prediction_shards(e, at, 8)
    out = files.read_prediction_shards(spark, at)
    return out.select("clip_id", "label", "chunk", "crop", F.size("logits").alias("n"), _weighted(F.col("logits")).alias("weighted"))


@query("SELECT (user_id % 10)::INT AS fold, event_id AS epoch, round(value::DOUBLE, 6) AS val_loss FROM events")
def a8_epoch_log(spark: SparkSession, d: str) -> DataFrame:
    """Losses as JSON lines in two appended parts, read back."""
    at = new_folder(spark, "log")
    e = table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("fold"), F.col("event_id").alias("epoch"), F.col("value").cast("double").alias("val_loss"))
    for part in (e.where("epoch % 2 = 0"), e.where("epoch % 2 = 1")):
        files.write_log(part, at)
    return files.read_log(spark, at, "fold int, epoch long, val_loss double").withColumn("val_loss", F.round("val_loss", 6))


@query("WITH c AS (SELECT source AS name, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), k AS (SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS class_id, (n % 7)::INT AS target FROM c) SELECT class_id, name, target FROM k")
def a9_label_maps(spark: SparkSession, d: str) -> DataFrame:
    """The sources as a list of classes and as a map to fewer ones, read back."""
    at = new_folder(spark, "labels")
    c = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg((F.count(F.lit(1)) % 7).alias("target"))
    k = with_position(c.withColumn("_all", F.lit(0)), "_all", [F.col("_all")], [F.col("name")], "class_id").drop("_all")
    files.write_label_names(k, f"{at}/names")
    files.write_label_map(k, f"{at}/map")
    return files.read_label_names(spark, f"{at}/names").join(files.read_label_map(spark, f"{at}/map"), "class_id")


CUTS = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]
_READING = "sensor_id string, ts timestamp, kw double"


def _feed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {_R} SELECT sensor_id, ts, round(kw, 6) AS kw FROM r")
def s1_stream_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings that come in three deliveries, the last day of each twice, through a stream that is stopped and goes on."""
    at, feed = new_folder(spark, "s1"), _feed(readings(spark, d))
    parts = replay.slices(feed, CUTS)
    again = [None, *[feed.where((F.col("ts") >= F.lit(c).cast("timestamp") - F.expr("interval 1 day")) & (F.col("ts") < F.lit(c).cast("timestamp"))) for c in CUTS]]
    turns = [[(p if a is None else p.unionByName(a), f"{at}/in")] for p, a in zip(parts, again, strict=True)]
    out = replay.replay(lambda: live.stream_readings(spark, f"{at}/in", _READING), turns, f"{at}/out", f"{at}/checkpoint", _READING)
    return out.select("sensor_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("kw", 6).alias("kw"))


@query(f"WITH {_R} SELECT sensor_id, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, round(arg_min(kw, ts), 6) AS kw FROM r GROUP BY 1, 2")
def s2_stream_resample(spark: SparkSession, d: str) -> DataFrame:
    """First readings of ten minutes from three deliveries; half of the last 20 minutes of each come with the next one."""
    at, feed = new_folder(spark, "s2"), _feed(readings(spark, d))
    late = F.lit(False)
    for c in CUTS:
        cut = F.lit(c).cast("timestamp")
        late = late | ((F.col("ts") >= cut - F.expr("interval 20 minutes")) & (F.col("ts") < cut) & (F.unix_seconds("ts") % 2 == 0))
    shown = feed.withColumn("_at", F.when(late, F.col("ts") + F.expr("interval 20 minutes")).otherwise(F.col("ts")))
    end = feed.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit(None).cast("string").alias("sensor_id"), "ts", F.lit(0.0).alias("kw"))
    parts = [p.drop("_at") for p in replay.slices(shown, CUTS, "_at")]
    turns = [[(p, f"{at}/in")] for p in (*parts[:-1], parts[-1].unionByName(end))]
    stream = lambda: live.stream_resample(spark.readStream.schema(_READING).parquet(f"{at}/in"), "10 minutes", "1 hour")
    out = replay.replay(stream, turns, f"{at}/out", f"{at}/checkpoint", _READING).where("sensor_id is not null")
    return out.select("sensor_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("kw", 6).alias("kw"))


@query(f"WITH {_H}, {_F} SELECT camera_id, f.ts, round(kw, 6) AS kw FROM f JOIN h ON h.sensor_id = camera_id AND h.ts = f.ts")
def s3_stream_pair(spark: SparkSession, d: str) -> DataFrame:
    """Frames and hourly power as two streams; power comes one delivery later than its frames."""
    at = new_folder(spark, "s3")
    f = [(p, f"{at}/frames") for p in replay.slices(_feed(frames(spark, d)).withColumn("path", F.lit("")), CUTS)]
    pv = [(p, f"{at}/pv") for p in replay.slices(_feed(hourly(spark, d)), CUTS)]
    turns = [[f[0], (pv[0][0].limit(0), pv[0][1])], [f[1], pv[0]], [f[2], pv[1]], [pv[2]]]
    read = lambda schema, name: spark.readStream.schema(schema).parquet(f"{at}/{name}")
    stream = lambda: live.stream_pair(read("camera_id string, ts timestamp, path string", "frames"), read(_READING, "pv"))
    out = replay.replay(stream, turns, f"{at}/out", f"{at}/checkpoint", "camera_id string, ts timestamp, path string, kw double")
    return out.select("camera_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("kw", 6).alias("kw"))
