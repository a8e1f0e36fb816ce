"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

A vector gets one more component that brings all norms to the largest one, so the greatest inner product is the least distance. Rows
and anchors are placed by their distances to a few pivots; anchors of neighbouring cells form groups of bounded size. By the
triangle inequality the distances of a cell's anchors and rows to its pivot bound how far what an anchor needs can lie, and a row is
sent only to groups that it might serve. There a block of rows is joined exactly with the group's anchors, and the short lists of
blocks are merged. This runs twice: for the positives of each anchor (a ball), and for rows whose score lies between two shares of a
positive's score (a ring). Bounds only save work: a row that can't be ruled out is compared.

Defined results: rows without id, label or vector, or with a component that is null or not finite, take no part. Of rows with one id
the one of the least label, then of the least vector counts. Vectors of different lengths are filled with zeros. Equal scores rank by
id. A positive with a negative score has no negatives. Scores are longs; vectors so large that one might not fit are an error, as in
Spark's own arithmetic. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.shared import discard, written

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Pivots: rows of the least id hashes. They steer the work only.
PIVOTS = 64
#: Most anchors of a group, most rows of a block, most scores held at once.
ANCHORS, ROWS, SCORES = 65_536, 65_536, 4_000_000
_NONE = -(2**63)


def usable(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``id, label, x`` of the rows that take part."""
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    return out.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")


def whole_vectors(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """A column of lists as rows of scaled whole numbers (as doubles), filled with zeros up to ``dim``."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class Space:
    """Distances to the pivots of vectors that are brought to one norm; small enough to go with every task."""

    def __init__(self, pivots: pa.Array, dim: int, norm2: float, scale: int) -> None:
        self.dim, self.norm2, self.scale = dim, norm2, scale
        self.pivots = self.raised(whole_vectors(pivots, dim, scale))
        self.apart = self._distances(self.pivots)

    def raised(self, y: np.ndarray) -> np.ndarray:
        return np.c_[y, np.sqrt(np.maximum(self.norm2 - (y * y).sum(axis=1), 0))]

    def _distances(self, z: np.ndarray) -> np.ndarray:
        squares = (z * z).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * z @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def rows(self, column: pa.Array) -> np.ndarray:
        return self._distances(self.raised(whole_vectors(column, self.dim, self.scale)))

    def anchors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distances, and squared norms; an anchor's further component is 0."""
        y = whole_vectors(column, self.dim, self.scale)
        return self._distances(np.c_[y, np.zeros(len(y))]), (y * y).sum(axis=1)


def nearest_by_label(rows: DataFrame, space: Space, k: int) -> DataFrame:
    """``label, cell, reach``: in how far from the pivot of ``cell`` at least ``k`` rows of ``label`` are sure to lie (infinite if there are fewer),
    besides the distance of the point in question from that pivot."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def cut() -> pd.DataFrame:
            every = pd.concat(held).sort_values("d")
            return every[every.groupby(["label", "cell"]).cumcount() < k]

        for batch in batches:
            if batch.num_rows:
                d = space.rows(batch.column(1))
                cell = d.argmin(axis=1)
                held.append(pd.DataFrame({"label": batch.column(0).to_numpy(zero_copy_only=False), "cell": cell, "d": d[np.arange(len(d)), cell]}))
                held[:] = [cut()]
        if held:
            yield pa.RecordBatch.from_pandas(held[0][["label", "cell", "d"]], preserve_index=False)

    def reach(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, d = np.array(pdf["cell"].tolist(), int), pdf["d"].tolist()
        every = np.concatenate([space.apart[:, c, None] + np.array(x)[None, :] for c, x in zip(at, d, strict=True)], axis=1)
        far = np.sort(every, axis=1)[:, k - 1] if every.shape[1] >= k else np.full(len(every), np.inf)
        return pd.DataFrame({"label": key[0], "cell": np.arange(len(far)), "reach": far})

    least = rows.select("label", "x").mapInArrow(near, "label long, cell long, d double")
    least = least.groupBy("label", "cell").agg(F.slice(F.sort_array(F.collect_list("d")), 1, k).alias("d"))
    return least.groupBy("label").applyInPandas(reach, "label long, cell long, reach double")


def plan_groups(sizes: np.ndarray, apart: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and its number of groups, at most ``most`` anchors a group: cells are taken from neighbour to
    neighbour, small ones share a group, a large one is split. Cells without anchors have no group."""
    first, parts = np.zeros(len(sizes), int), np.zeros(len(sizes), int)
    left, at, group, filled = set(np.flatnonzero(sizes).tolist()), None, -1, most
    while left:
        at = min(left, key=lambda c: (apart[at, c] if at is not None else 0, c))
        left.remove(at)
        if filled + sizes[at] > most:
            group, filled = group + 1, 0
        first[at], parts[at] = group, -(-int(sizes[at]) // most)
        group, filled = group + parts[at] - 1, (most if parts[at] > 1 else filled + int(sizes[at]))
    return first, parts


def route(rows: DataFrame, space: Space, first: np.ndarray, parts: np.ndarray, radius: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> DataFrame:
    """``group, id, label, x``: each row for each group with a cell whose anchors, at most ``radius`` from its pivot, may need a row
    between ``inner`` and ``outer`` away."""
    slack = 1e-6 * (1 + space.norm2**0.5)
    serves: dict[int, list[int]] = {}
    for cell in np.flatnonzero(parts):
        for g in range(first[cell], first[cell] + parts[cell]):
            serves.setdefault(int(g), []).append(int(cell))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.rows(batch.column(2)) if batch.num_rows else np.zeros((0, len(parts)))
            out = (d - radius - outer > slack) | (inner - d - radius > slack)
            for g, cells in serves.items():
                sent = batch.filter(pa.array(~out[:, cells].all(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sent.num_rows, g, np.int64)), *sent.columns], ["group", *sent.schema.names])

    kind = rows.schema["x"].dataType.simpleString()
    return rows.select("id", "label", "x").mapInArrow(send, f"group long, id long, label long, x {kind}")


class Best:
    """The ``k`` best rows for each anchor and each of its windows of scores, over rows that come piece by piece."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.y, self.lo, self.hi, self.k, self.same = ids, labels, y, lo, hi, k, same
        self.scores = np.full((*lo.shape, k), _NONE, np.int64)
        self.found = np.zeros((*lo.shape, k), np.int64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(ids)
        ids, labels = ids[order], labels[order]
        scores = (self.y @ y[order].T).astype(np.int64)
        fit = ((self.labels[:, None] == labels) == self.same) & (self.ids[:, None] != ids)
        for w in range(self.lo.shape[1]):
            may = fit & (scores >= np.maximum(self.lo[:, w], self.scores[:, w, -1])[:, None]) & (scores <= self.hi[:, w, None])
            at = np.flatnonzero(may.any(axis=1))
            if not len(at):
                continue
            left = np.where(may[at], scores[at], _NONE)
            got_s, got_i = [self.scores[at, w]], [self.found[at, w]]
            for _ in range(min(self.k, left.shape[1])):  # the first of equal scores has the least id
                j = left.argmax(axis=1)
                got_s.append(left[np.arange(len(at)), j][:, None])
                got_i.append(ids[j][:, None])
                left[np.arange(len(at)), j] = _NONE
            s, i = np.concatenate(got_s, axis=1), np.concatenate(got_i, axis=1)
            o = np.lexsort((i, -np.maximum(s, _NONE + 1)), axis=1)[:, : self.k]
            self.scores[at, w], self.found[at, w] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)

    def result(self) -> pa.RecordBatch:
        a, w, r = np.nonzero(self.scores > _NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(w), pa.array(self.scores[a, w, r]), pa.array(self.found[a, w, r])], ["anchor", "window", "score", "id"])


def join_blocks(sent: DataFrame, anchors: DataFrame, space: Space, blocks: int, k: int, same: bool) -> DataFrame:
    """``anchor, window, score, id``: the ``k`` best rows by anchor and window, from routed rows and anchors (``group, id, label, x,
    lo, hi``). A group's rows are dealt to ``blocks``, each of which gets all its anchors; a task holds these and reads rows in pieces.
    """
    exact = space.norm2 < 2**50

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, best = None, [], None

        def vectors(c: pa.Array) -> np.ndarray:
            y = whole_vectors(c, space.dim, space.scale)
            return y if exact else y.astype(np.int64)

        def ready() -> Best:
            whole = pa.Table.from_batches(first).combine_chunks()
            lo, hi = (np.array(whole.column(c).to_pylist(), np.int64).reshape(whole.num_rows, -1) for c in ("lo", "hi"))
            return Best(whole.column("id").to_numpy(), whole.column("label").to_numpy(), vectors(whole.column("x").combine_chunks()), lo, hi, k, same)

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)] if len(marks) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if tuple(marks[a, :2]) != key:
                    if best:
                        yield best.result()
                    key, first, best = tuple(marks[a, :2]), [], None
                if marks[a, 2] == 0:
                    first.append(part)
                    continue
                if not first:
                    continue
                best = best or ready()
                step = max(1, SCORES // len(best.ids))
                for i in range(0, part.num_rows, step):
                    piece = part.slice(i, step)
                    best.meet(piece.column("id").to_numpy(zero_copy_only=False), piece.column("label").to_numpy(zero_copy_only=False), vectors(piece.column("x")))
        if best:
            yield best.result()

    none = F.lit(None).cast("array<long>")
    here = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = sent.select("group", here.alias("block"), F.lit(1).alias("kind"), "id", "label", "x", none.alias("lo"), none.alias("hi"))
    every = anchors.select("group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "id", "label", "x", "lo", "hi")
    dealt = every.unionByName(rows).repartition("group", "block").sortWithinPartitions("group", "block", "kind")
    found = dealt.mapInArrow(run, "anchor long, window long, score long, id long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _percent(score: str, p: int, up: bool) -> Column:
    """``p`` percent of a score of 0 or more, rounded up or down, without leaving long."""
    return p * F.expr(f"{score} div 100") + F.floor((p * (F.col(score) % 100) + (99 if up else 0)) / 100)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, pivots: int = PIVOTS, most_anchors: int = ANCHORS, most_rows: int = ROWS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component counts as ``floor(scale * x)``, a score is the inner product. For each anchor (rows where ``is_anchor`` holds, a
    condition on the column ``id``) the best ``positives`` rows of its label, and for each of these the best ``negatives`` rows of
    other labels whose score is from ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    all_rows = written(usable(rows, vec_id, vector, label), "vectors")
    squares = F.aggregate(F.transform("x", lambda v: F.floor(v.cast("double") * scale).cast("double")), F.lit(0.0), lambda s, y: s + y * y)
    n, n_anchors, dim, norm2 = all_rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("x")), F.max(squares)).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    if norm2 >= 2**62:
        raise ArithmeticError("vectors are too large: a score might not fit a long")
    chosen = all_rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("x").toArrow()  # at most ``pivots`` rows
    space = Space(chosen.column("x").combine_chunks(), dim, norm2, scale)
    blocks = -(-n // int(np.clip(-(-n // 64), 4096, most_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, norms = space.anchors(batch.column(2)) if batch.num_rows else (np.zeros((0, 1)), np.zeros(0))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell]), pa.array(norms)], [*batch.schema.names, "cell", "far", "norm"])

    kind = all_rows.schema["x"].dataType.simpleString()
    anchors = written(all_rows.where(is_anchor).mapInArrow(place, f"id long, label long, x {kind}, cell long, far double, norm double"), "anchors")
    cells = {r["cell"]: r for r in anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # a row a pivot at most
    size, radius = (np.array([cells[c][what] if c in cells else 0 for c in range(len(space.pivots))]) for what in ("n", "far"))
    first, parts = plan_groups(size, space.apart, min(most_anchors, max(256, -(-n_anchors // 8))))
    base, split = (F.array(*[F.lit(int(v)) for v in x]) for x in (first, np.maximum(parts, 1)))
    of = F.col("cell").cast("int")
    anchors = anchors.withColumn("group", (F.get(base, of) + F.pmod(F.xxhash64("id"), F.get(split, of))).cast("long"))

    def limits(df: DataFrame, inner: Column, outer: Column) -> tuple[np.ndarray, np.ndarray]:
        got = {r["cell"]: r for r in df.groupBy("cell").agg(F.min(inner).alias("inner"), F.max(outer).alias("outer")).collect()}  # a row a pivot at most
        return tuple(np.array([got[c][what] if c in got else empty for c in range(len(space.pivots))], float) for what, empty in (("inner", np.inf), ("outer", -np.inf)))

    ball = anchors.select("cell", "label").distinct().join(nearest_by_label(all_rows, space, positives + 1), ["cell", "label"])
    inner, outer = limits(ball, F.lit(0.0), F.col("reach"))
    sent = route(all_rows, space, first, parts, radius, inner, outer + radius)
    whole = anchors.withColumns({"lo": F.array(F.lit(_NONE + 1)), "hi": F.array(F.lit(2**63 - 1))})
    best = join_blocks(sent, whole, space, blocks, positives, True)
    best = written(best.select("anchor", "score", F.col("id").alias("positive")), "positives")

    ringed = best.where("score >= 0").withColumns({"lo": _percent("score", low, True), "hi": _percent("score", high, False)}).where("lo <= hi")
    wanted = ringed.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("positive"), F.col("score"), F.col("lo"), F.col("hi")))).alias("p"))
    pad = lambda c, v: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col(f"p.{c}"), i), F.lit(v)))
    wanted = anchors.join(wanted, F.col("id") == F.col("anchor")).withColumns({"lo": pad("lo", 0), "hi": pad("hi", _NONE + 1)})
    wanted = written(wanted.select("group", "cell", "id", "label", "x", "norm", "p", "lo", "hi"), "rings")
    away = lambda s: F.sqrt(F.greatest(F.col("norm") + norm2 - 2.0 * s, F.lit(0.0)))
    inner, outer = limits(wanted, away(F.array_max("p.hi")), away(F.array_min("p.lo")))
    sent = route(all_rows, space, first, parts, radius, inner, outer)
    found = join_blocks(sent, wanted, space, blocks, negatives, False)
    named = wanted.select(F.col("id").alias("anchor"), F.posexplode("p").alias("window", "p")).select("anchor", F.col("window").cast("long").alias("window"), F.col("p.positive").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = found.join(named, ["anchor", "window"])
    discard(best)
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
