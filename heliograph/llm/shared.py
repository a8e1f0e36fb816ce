"""What several corpus operators use: word rules, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go when it has ended; a table that is written needs them no more.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one key from which on joins treat it by itself.
HOT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on a local master without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="heliograph-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later reads neither recompute it nor depend on an executor's disk.

    With ``by`` it is a table in buckets of that column, as many as shuffles have partitions: joins on it shuffle the other side only.
    """
    spark = df.sparkSession
    at = uuid.uuid4().hex
    path = f"{shared_root(spark)}/{name}-{at}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        if by:
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.repartition(parts, by).write.bucketBy(parts, by).sortBy(by).format("parquet").option("path", path).saveAsTable(f"{name}_{at}")
        else:
            df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.table(f"{name}_{at}") if by else spark.read.schema(df.schema).parquet(path)
    out._written_at, out._table = path, f"{name}_{at}" if by else None
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        if df._table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        delete(df.sparkSession, df._written_at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str = "n", limit: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a ``key`` with ``n``, how often the key occurs in ``rows``.

    Keys above ``limit`` are broadcast (at most one for every ``limit`` of ``rows``), so no task gets all rows of a hot key.
    """
    limit = limit or HOT
    hot = F.broadcast(table.where(F.col(n) > limit))
    if hot.limit(1).count() == 0:
        return rows.join(table, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) <= limit), key)
    return rows.join(hot, key).unionByName(rest)


def frequent(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than HOT of the rows have, with ``n``, their number, written once: for the others a number need not be known."""
    return written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "frequent")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def shifted(array: Column, by: int) -> Column:
    """``array`` without its first ``by`` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def window_hashes(hashes: Column, width: int) -> Column:
    """A 64-bit hash for each run of ``width`` neighbours in an array of longs, in order; empty if there are fewer.

    Runs are put together from halves, so that each element costs a logarithmic number of hash calls.
    """

    def grow(have: Column, size: int, want: int) -> Column:
        if size == want:
            return F.slice(have, 1, F.greatest(F.size(have) - (want - 1), F.lit(0)))
        step = min(size, want - size)
        return let(F.zip_with(have, shifted(have, step), lambda a, b: F.xxhash64(a, b)), lambda x: grow(x, size + step, want))

    return let(hashes, lambda x: grow(x, 1, width))


def min_labels(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: ``(node, label)`` with the least node reachable, for nodes that have an edge.

    ``edges`` has two columns of one ordered type, ``a`` and ``b``. Each round takes the least label among neighbours and then
    the label of that label (pointer jumping), so rounds grow with the logarithm of a component's diameter. Each round's labels
    are written to the shared folder; only whether one changed reaches the driver. A label never grows, and stays only where all
    neighbours share it, so the rounds end. Null ends and loops are ignored; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("n")), "labels")
    hub, crowd = (labels.agg(F.max("n")).first()[0] or 0) > HOT, False
    while True:
        near = labels.select(F.col("node").alias("b"), "label", "n")
        near = (join_counted(both, near, "b") if hub else both.join(near, "b")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "n", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        if crowd:  # a label that very many nodes have
            low = written(low, "low")
            jump = written(jump.join(low.groupBy("mid").agg(F.count(F.lit(1)).alias("times")), "mid"), "jump")
        jumped = join_counted(low, jump, "mid", "times") if crowd else low.join(jump, "mid")
        label = F.least("mid", "far")
        step = written(jumped.select("node", label.alias("label"), "n", (label != F.col("old")).alias("moved")), "labels")
        discard(labels, *([low, jump] if crowd else []))
        labels = step
        most, moved = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.max("moved").alias("moved")).agg(F.max("k"), F.max("moved")).first()
        crowd = (most or 0) > HOT
        if not moved:
            discard(both)
            return labels.select("node", "label")


class WordHashes(dict):
    """Hashes of words met so far, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def map_texts(df: DataFrame, carry: tuple[str, ...], text: str, make: Callable[[], Callable[[list], list[tuple]]], fields: dict[str, pa.DataType], schema: str, binary: bool = False) -> DataFrame:
    """``carry`` as it is, and new columns worked out from ``text`` in Arrow batches.

    ``make`` is called once a task and returns a function from a batch's texts (UTF-8 bytes if ``binary``) to a tuple of
    ``fields`` for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(len(carry))
            rows = work((column.cast(pa.binary()) if binary else column).to_pylist())
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *new], [*carry, *fields])

    picked = df.select(*carry, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def grouped_stream(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[list]], list[tuple]], fields: dict[str, pa.DataType], schema: str, parts: int | None = None) -> DataFrame:
    """Fold each group of ``keys`` (its other columns as lists, rows in ``order``) to result tuples, many small groups a task.

    Rows are dealt by the keys and sorted; groups are cut from the sorted stream, so a group costs no more than its rows.
    """
    names = df.columns
    rest = [i for i, c in enumerate(names) if c not in keys]
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, [[] for _ in rest]
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(fields.values())], list(fields))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            ids = list(zip(*[columns[i] for i in at], strict=True))
            begin = 0
            for i in range(len(ids) + 1):
                if i < len(ids) and i > begin and ids[i] == ids[i - 1]:
                    continue
                if i == begin:
                    continue
                key = ids[i - 1]
                if key != held_key:
                    if held_key is not None:
                        out.extend(fold(held_key, held))
                    held_key, held = key, [[] for _ in rest]
                for to, c in zip(held, rest, strict=True):
                    to.extend(columns[c][begin:i])
                begin = i
            if len(out) > 5000:
                yield packed()
        if held_key is not None:
            out.extend(fold(held_key, held))
        yield packed()

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
