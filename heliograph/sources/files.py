"""Readers and sinks: power tables, frames, manifests, prediction shards, logs, labels."""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = {"video": ("path string, label int", 2), "frames": ("path string, total int, label int", 3), "pretrain": ("path string, start int, total int", 3)}


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for what is planned inside."""
    names = {k: k.replace("__", ".") for k in values}
    had = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if had[k] is None else spark.conf.set(n, had[k])


def read_heads(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The column names of each CSV file, as names to files; files without a line have none.

    Each file is one task, which stops after its first batch of lines: no more than some kilobytes of a file are read.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    whole = str(2**40)
    with settings(spark, spark__sql__files__maxPartitionBytes=whole, spark__sql__files__openCostInBytes=whole, spark__sql__execution__arrow__maxRecordsPerBatch="16"):
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
        rows = lines.mapInArrow(first, "value string, file string").collect()  # a row a file
    heads: dict[tuple[str, ...], list[str]] = {}
    for r in rows:
        names = next(csv.reader([r["value"].lstrip("\ufeff")]), [])
        heads.setdefault(tuple(n.strip() for n in names), []).append(unquote(r["file"]))  # Spark tells paths in URI form
    return heads


def read_csvs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All CSV files as one table of strings with the union of their columns, by name; a column that a file lacks is null there.

    A name that a header repeats gets a number from its second time on (``kw``, ``kw.1``).
    """
    out = None
    for names, of in sorted(read_heads(spark, paths).items()):
        seen = [n if names.index(n) == i else f"{n}.{names[:i].count(n)}" for i, n in enumerate(names)]
        df = spark.read.option("header", True).schema(", ".join(f"`{n.replace('`', '``')}` string" for n in seen)).csv(of)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file has a header")
    return out


def read_pv_csv(spark: SparkSession, paths: str | list[str], value_col: str, time_col: str = "Date") -> DataFrame:
    """All files as one table ``ts, kw``; both columns are found by name in each file, whatever else it has and in any order.

    Headers are read from the files' heads alone; files of one header are read together, so the data is read once. Bad times and
    values are null; a file whose header lacks a column is an error.
    """
    heads = read_heads(spark, paths)
    poor = [f for names, of in heads.items() if not {time_col, value_col} <= set(names) for f in of]
    if poor or sum(map(len, heads.values())) < len(spark.read.text(paths).inputFiles()):
        raise ValueError(f"files without the columns {time_col} and {value_col}: {', '.join(sorted(poor)[:5])}")
    out = None
    for names, of in sorted(heads.items()):
        wanted = [n if names.index(n) == i and n in (time_col, value_col) else f"_c{i}" for i, n in enumerate(names)]
        df = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in wanted)).csv(of)
        df = df.select(F.try_to_timestamp(time_col, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("ts"), F.col(value_col).try_cast("double").alias("kw"))
        out = df if out is None else out.union(df)
    return out


def write_by_day(df: DataFrame, path: str, parts: list[str], order: list[str]) -> None:
    """``df`` by its columns ``parts`` and the ``day`` of ``ts``, sorted inside; what the store has of these parts is replaced.

    Rows are dealt by ranges, so a long day is spread over several files, and a file's rows lie close in time.
    """
    dealt = df.withColumn("day", F.to_date("ts")).repartitionByRange(*parts, "day", *order).sortWithinPartitions(*parts, "day", *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "day").parquet(path)


def _sensor(df: DataFrame) -> list[str]:
    return [c for c in ("sensor_id", "camera_id") if c in df.columns]


def write_series(df: DataFrame, path: str) -> None:
    """Store readings by day; days that are written again are replaced, others stay."""
    write_by_day(df, path, [], ["ts", *_sensor(df)])


def read_series(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored readings with ``start <= ts < end``: other days aren't listed, and inside a day the scan filters by ``ts``."""
    return _between(spark.read.parquet(path), start, end)


def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where((F.col("day") >= F.lit(start).cast("timestamp_ntz").cast("date")) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        df = df.where((F.col("day") <= F.lit(end).cast("timestamp_ntz").cast("date")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return df


def write_samples(df: DataFrame, path: str) -> DataFrame:
    """Store samples (``split``, ``ts``, others) by split and day; returns counts by split of the whole store.

    Batches of whole days are added one by one; a batch that is written again replaces its days of each split that it has. Samples
    without ``ts`` can't be told apart so and are appended.
    """
    if "ts" in df.columns:
        write_by_day(df, path, ["split"], ["ts", *_sensor(df)])
    else:
        df.write.mode("append").partitionBy("split").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("split").count()


def read_samples(spark: SparkSession, path: str, split: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored samples of a split with ``start <= ts < end``; folders of other splits and days aren't listed."""
    return _between(spark.read.parquet(path).where(F.col("split") == split), start, end)


def write_frames(df: DataFrame, root: str) -> int:
    """Write ``data`` of each row to ``path`` below ``root`` (a URI of any file system that Arrow knows); returns how many.

    A file that a retried task writes again is replaced by the same bytes.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{base}/{path}"
                to.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with to.open_output_stream(at) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select("path", F.col("data").cast("binary").alias("data")).mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def day_folders(spark: SparkSession, root: str, start: str, end: str) -> list[str]:
    """Folders ``root/year/month/x/day`` of the days from ``start`` to ``end``, by the file system's listing of these alone."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(root)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    day, last, found = dt.date.fromisoformat(start[:10]), dt.date.fromisoformat(end[:10]), []
    while day <= last:
        found += [str(x.getPath()) for x in system.globStatus(jvm.Path(f"{root}/{day:%Y/%m}/*/{day:%d}")) or []]
        day += dt.timedelta(days=1)
    return found


def list_frames(spark: SparkSession, root: str, start: str, end: str, by_day: bool = False) -> DataFrame:
    """``path, ts`` of ``yyyyMMddHHmmss.jpg`` files below ``root`` with ``start <= ts < end``; contents aren't read.

    With ``by_day``, frames lie in ``year/month/x/day`` and only folders of the days asked for are listed.
    """
    at = day_folders(spark, root, start, end) if by_day else [root]
    if not at:
        return spark.createDataFrame([], "path string, ts timestamp_ntz")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(at).select("path")
    ts = F.try_to_timestamp(F.regexp_extract("path", r"(\d{14})\.jpg$", 1), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return files.select("path", ts.alias("ts")).where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def write_manifest(df: DataFrame, path: str, kind: str) -> None:
    """Lines of the ``kind``'s fields, parted by blanks."""
    names = [f.split()[0] for f in MANIFESTS[kind][0].split(", ")]
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in names]).alias("value")).write.mode("overwrite").text(path)


def _manifest_lines(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Lines that aren't blank with their ``file`` and ``reason`` (null if they are right), and the fields of a right line."""
    schema, n = MANIFESTS[kind]
    fields = [tuple(f.split()) for f in schema.split(", ")]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.length(F.trim("line")) > 0)
    part = lambda i: F.get(F.split(F.trim("line"), " "), i)
    values = [(name, part(i) if type_ == "string" else part(i).try_cast(type_)) for i, (name, type_) in enumerate(fields)]
    reason = F.when(F.size(F.split(F.trim("line"), " ")) < n, F.lit("short manifest line"))
    for (name, value), (_, type_) in reversed(list(zip(values, fields, strict=True))):
        reason = reason.when(value.isNull(), F.lit(f"manifest line whose {name} isn't a number")) if type_ != "string" else reason
    return lines.withColumn("reason", reason), values


def manifest_errors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``file, line, reason`` of the lines that ``read_manifest`` would refuse."""
    return _manifest_lines(spark, path, kind)[0].where("reason is not null").select("file", "line", "reason")


def read_manifest(spark: SparkSession, path: str, kind: str, root: str = "", strict: bool = True) -> DataFrame:
    """A manifest of ``kind``; a line with too few fields or a field that isn't a number is an error that names line and file, or is
    left to ``manifest_errors`` unless ``strict``."""
    lines, values = _manifest_lines(spark, path, kind)
    if strict:
        told = F.concat("reason", F.lit(": "), "line", F.lit(" in "), "file")
        lines = lines.withColumn("line", F.when(F.col("reason").isNull(), F.col("line")).otherwise(F.raise_error(told)))
    else:
        lines = lines.where("reason is null")
    return lines.select(*[(F.concat_ws("/", *([F.lit(root)] if root else []), value) if name == "path" else value).alias(name) for name, value in values])


def write_prediction_shards(df: DataFrame, path: str, shards: int) -> None:
    """``clip_id, logits, label, chunk, crop`` as lines ``id [v, …] label chunk crop`` in ``shards`` folders of one text file each; a
    shard's first line has its top-1 and top-5 percentages."""
    best = F.array_sort(F.transform("logits", lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    hit = lambda k: F.round(F.avg(F.when(F.exists(F.slice(best, 1, k), lambda s: s["i"] == F.col("label").cast("int")), 100.0).otherwise(0.0)), 4)
    dealt = df.withColumn("shard", F.pmod(F.xxhash64("clip_id", "chunk", "crop"), F.lit(shards)).cast("int"))
    heads = dealt.groupBy("shard").agg(hit(1).alias("a"), hit(5).alias("b")).select("shard", F.lit(0).alias("at"), F.concat_ws(", ", F.col("a").cast("string"), F.col("b").cast("string")).alias("value"))
    vector = F.concat(F.lit("["), F.array_join(F.transform("logits", lambda v: v.cast("string")), ", "), F.lit("]"))
    lines = dealt.select("shard", F.lit(1).alias("at"), F.concat_ws(" ", F.col("clip_id").cast("string"), vector, F.col("label").cast("string"), F.col("chunk").cast("string"), F.col("crop").cast("string")).alias("value"))
    heads.unionByName(lines).repartition(shards, "shard").sortWithinPartitions("shard", "at", "value").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)


def read_prediction_shards(spark: SparkSession, paths: str) -> DataFrame:
    """``clip_id, logits, label, chunk, crop`` of lines ``id [v, …] label chunk crop``; first lines (without a bracket) are skipped."""
    rx = r"^(\S+)\s+(\[[^\]]*\])\s+(\S+)\s+(\d+)\s+(\d+)\s*$"
    got = lambda i: F.regexp_extract("value", rx, i)
    rows = spark.read.text(paths).where(F.col("value").rlike(rx))
    return rows.select(got(1).alias("clip_id"), F.from_json(got(2), "array<double>").alias("logits"), got(3).cast("double").alias("label"), got(4).cast("int").alias("chunk"), got(5).cast("int").alias("crop"))


def write_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_label_map(df: DataFrame, path: str) -> None:
    """``class_id, target`` as one JSON array of targets by class; a label map is small."""
    targets = F.transform(F.sort_array(F.collect_list(F.struct("class_id", F.col("target").cast("int").alias("target")))), lambda s: s["target"])
    df.agg(F.to_json(targets).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``class_id, target`` of a JSON array of integers."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<int>")).alias("class_id", "target"))


def write_label_names(df: DataFrame, path: str) -> None:
    """``class_id, name`` as a text with one class a line, in order; a list of classes is small."""
    df.coalesce(1).sortWithinPartitions("class_id").select("name").write.mode("overwrite").text(path)


def read_label_names(spark: SparkSession, path: str) -> DataFrame:
    """``class_id, name`` of a text with one class a line."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("class_id", "name"))
