"""Near-duplicates by SimHash fingerprints and BK-trees.

A text's fingerprint is the bitwise majority over the hashes of its word shingles. Fingerprints within a radius are linked:
each goes to a shard for every way in which enough of its blocks of bits can be equal (so two within the radius meet in a
shard at least once), a BK-tree is built in each shard - children keyed by the integer Hamming distance to their parent - and a
search follows only edges within the radius. Links of a shard leave it as a spanning forest; connected components give classes.

The method's plain form sends every shard's tree to every task. That is a comparison of all shards with all rows, and trees of
all documents have no size bound, so shards travel by key here. A shard above MAX_TREE is dealt again by more blocks. What is
still larger lies within a few bits, and there a tree prunes nothing: its members name all fingerprints within half the radius,
and members that name the same one are linked, which is exact and linear in the members.

Deduplication proper (``near_duplicate_ids``) asks for texts whose five-word shingles are similar. Shards are dealt there by
pairs of min-hashes of the shingles, a BK-tree in each cell of a shard proposes pairs within a radius, and the shingle sets that
travel with the members verify them; see there.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; repeated rows have one class; null ids take no part in the least id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.shared import WordHashes, discard, grouped_stream, join_counted, map_texts, min_labels, written

SHINGLE = 3
RADIUS = 2
BLOCKS = 4
SEED = 42
MAX_TREE = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE, distinct: bool = False) -> int:
    """Bits set in over half of the shingles' hashes, repeats included unless ``distinct``. ASCII letters are lower-cased; words
    are cut at ASCII white space."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= shingle:
        parts = [b" ".join(tokens)]
    else:
        parts = map(b" ".join, zip(*[tokens[i:] for i in range(shingle)], strict=False))
    if distinct:
        parts = set(parts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, carry: tuple[str, ...], text: str = "text", shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """``carry`` and ``fp``, the fingerprint as a long."""

    def make():
        return lambda texts: [(signed(fingerprint(t, shingle, distinct)),) for t in texts]

    return map_texts(docs, carry, text, make, {"fp": pa.int64()}, "fp long", binary=True)


class BKTree:
    """A BK-tree over 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            if not d:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def near(self, x: int, radius: int) -> list[int]:
        """All members within the radius; a child at edge ``e`` can hold one only if ``|e - d| <= radius``."""
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ x).bit_count()
            if d <= radius:
                out.append(node[0])
            if children := node[1]:
                for e in range(max(1, d - radius), d + radius + 1):
                    if e in children:
                        stack.append(children[e])
        return out


class Forest:
    """Disjoint sets with the least member of each."""

    def __init__(self, members: Iterable[int]) -> None:
        self.parent = {x: x for x in members}

    def top(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """Each member that isn't the least of its set, with the least."""
        return [(x, y) for x in self.parent if (y := self.top(x)) != x]


def shard_links(columns: list[list], radius: int) -> list[tuple[int, int]]:
    """Stars that connect what the links among distinct fingerprints connect."""
    members = [x & (2**64 - 1) for x in columns[0]]
    tree, forest = BKTree(), Forest(members)
    for x in members:
        for y in tree.near(x, radius):
            forest.join(x, y)
        tree.add(x)
    return [(signed(x), signed(y)) for x, y in forest.stars()]


def bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def block_keys(fp: Column, spans: list[tuple[int, int]], equal: int) -> Column:
    """For each choice of ``equal`` blocks ``(low, width)``, a key of the choice and the blocks' bits."""
    out = []
    for i, choice in enumerate(combinations(spans, equal)):
        key, used = F.lit(i).cast("long"), 6
        for low, width in choice:
            key = F.shiftleft(key, width).bitwiseOR(bits(fp, low, width))
            used += width
        assert used <= 64, "too many bits in a key"
        out.append(key)
    return F.array(*out)


def even_blocks(n: int) -> list[tuple[int, int]]:
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def flips(bits: int) -> list[int]:
    """Masks of up to ``bits`` bits, as longs."""
    return [signed(sum(1 << i for i in at)) for n in range(bits + 1) for at in combinations(range(64), n)]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, max_tree: int = MAX_TREE) -> DataFrame:
    """``a, b``: links of ``fp`` that connect all pairs of ``distinct`` that differ in ``radius`` bits or fewer.

    ``blocks - radius`` blocks of such a pair are equal at least. A shard with more than ``max_tree`` members is keyed again by
    ``blocks + 2`` blocks, with ``blocks + 2 - radius`` of them equal: a finer key that the pair also shares. In a shard that is
    still larger each member names the fingerprints around it: two within the radius name one in between, one
    of them from within half the radius. All that name it are linked with the least that names it from there.
    """

    def keyed_by(df: DataFrame, n: int) -> DataFrame:
        return df.select("fp", F.explode(block_keys(F.col("fp"), even_blocks(n), n - radius)).alias("key"))

    def sizes_of(df: DataFrame) -> DataFrame:
        return written(df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")

    def searched(df: DataFrame) -> DataFrame:
        return grouped_stream(df.select("key", "fp"), ["key"], ["fp"], lambda _, columns: shard_links(columns, radius), {"a": pa.int64(), "b": pa.int64()}, "a long, b long")

    keyed = keyed_by(distinct, blocks)
    counts = sizes_of(keyed)
    out = searched(keyed.join(counts.where(F.col("n") <= max_tree), "key"))
    if counts.where(F.col("n") > max_tree).limit(1).count() == 0:
        return out

    dense = written(join_counted(keyed, counts.where(F.col("n") > max_tree), "key").select("fp").distinct(), "dense")
    finer = keyed_by(dense, blocks + 2)
    counts = sizes_of(finer)
    out = out.union(searched(finer.join(counts.where(F.col("n") <= max_tree), "key")))
    dense = join_counted(finer, counts.where(F.col("n") > max_tree), "key").select("fp").distinct()
    short, long = radius // 2, radius - radius // 2
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count() <= short if m >= 0 else (m & (2**64 - 1)).bit_count() <= short).alias("near")) for m in flips(long)])
    named = dense.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m.mask")).alias("named"), "m.near")
    hubs = named.groupBy("named").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1 and hub is not null")
    around = join_counted(named, written(hubs, "hubs"), "named").where("fp <> hub")
    return out.union(around.select(F.col("hub").alias("a"), F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each document: 16 hex digits, and the least id reachable over links."""
    marked = written(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ("doc_id",), "text", shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    joined = classes(nodes, links(nodes.select("fp"), radius, blocks))
    out = join_counted(marked, joined, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, n, component`` for every node, ``component`` the least ``least`` of all nodes that are connected."""
    labels = min_labels(edges)
    rooted = nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("label").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members")), "components")
    out = written(join_counted(rooted, least, "label", "members").select("fp", "n", "component"), "classes")
    discard(rooted, least)
    return out


#: Deduplication proper: similarity of the sets of five-word shingles.
VERIFY_SHINGLE = 5
SIMILARITY = 0.8
#: Bits of fingerprints of shingle sets within which a pair is verified: sets at 0.8 differ in 9.7 bits in the mean, in more than
#: this once in ten thousand pairs.
DEDUP_RADIUS = 20
#: Shards: so many pairs of min-hashes; two sets at 0.8 share none once in a thousand pairs.
BANDS = 7
#: Members of a shard that are compared with one another; a larger shard is cut and its rest dealt again, by so many min-hashes.
CELL = 1024
DEALT = 12

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xBF58476D1CE4E5B9)
_FACTORS = (np.random.default_rng(SEED).integers(1, 2**63, 32, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MORE
        return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order; of the whole text if it is shorter."""
    tokens = (text or b"").lower().split()
    w = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(VERIFY_SHINGLE, len(w))
    out = np.zeros(max(1, len(w) - width + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * _MIX + w[j : j + len(out)]
    return np.unique(mixed(out))


def min_hashes(hashes: np.ndarray, n: int) -> list[np.uint64]:
    with np.errstate(over="ignore"):
        return [(hashes * f).min() for f in _FACTORS[:n]]


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: the mix of its two min-hashes and its number."""
    low = np.array(min_hashes(hashes, 2 * BANDS), dtype=np.uint64).reshape(BANDS, 2)
    with np.errstate(over="ignore"):
        return mixed((low[:, 0] * _MIX + low[:, 1]) * _MIX + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def set_fingerprint(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def cell_links(key: int, cut: bool, columns: list[list], similarity: float, radius: int = DEDUP_RADIUS) -> list[tuple[int, int, int]]:
    """Links of one cell and what is dealt again.

    ``columns``: node, its label (nodes of one label are connected already), fingerprint and the bytes of its set. A tree search
    proposes pairs; those of different labels that are similar are connected, and each label gives a row ``(0, label, least
    label)``. In a cell of a cut shard, nodes outside the largest set of connected nodes, or not similar to the core - the
    shingles that over half of the cell's nodes have - give rows ``(1, key, node)``, the keys being min-hashes of how their
    sets differ from the core.
    """
    ids, labels, fps, packed = columns
    sets = [np.frombuffer(s, dtype="<u4") for s in packed]
    quick = [set(s.tolist()) if len(s) <= 1000 else None for s in sets]
    tree, at, forest = BKTree(), defaultdict(list), Forest(labels)

    def close(a: np.ndarray, b: np.ndarray, both: int) -> bool:
        return both >= similarity * (len(a) + len(b) - both)

    def similar(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        return close(a, b, len(quick[i] & quick[j]) if quick[i] is not None and quick[j] is not None else len(np.intersect1d(a, b, assume_unique=True)))

    for i, fp in enumerate(fps):
        x = fp & (2**64 - 1)
        mine = forest.top(labels[i])
        for y in sorted(tree.near(x, radius), key=lambda y: (x ^ y).bit_count()):
            for j in at[y]:
                if forest.top(labels[j]) != mine and similar(i, j):
                    forest.join(labels[i], labels[j])
                    mine = forest.top(mine)
        tree.add(x)
        at[x].append(i)
    out = [(0, a, b) for a, b in forest.stars()]
    if cut:
        tops = [forest.top(x) for x in labels]
        largest = Counter(tops).most_common(1)[0][0]
        held, counts = np.unique(np.concatenate(sets), return_counts=True)
        core = held[2 * counts > len(sets)]
        for i, s in enumerate(sets):
            if tops[i] == largest and close(s, core, len(np.intersect1d(s, core, assume_unique=True))):
                continue
            apart = np.setxor1d(s, core, assume_unique=True).astype(np.uint64)
            if len(apart):
                low = np.array(min_hashes(mixed(apart * _MIX), DEALT), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    keys = mixed((low + np.uint64(key & (2**64 - 1))) * _MIX + np.arange(DEALT, dtype=np.uint64)).view(np.int64)
                out += [(1, k, ids[i]) for k in keys.tolist()]
    return out


def near_duplicate_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Distinct ``doc_id`` (integers) of the documents that aren't the first of their group.

    Copies (equal words) are one node, named by its least id. A link is a pair of nodes whose sets of five-word shingles have
    Jaccard similarity ``similarity`` (sets hold 32 bits of a shingle's hash); groups are connected components.

    Shards hold the nodes of one pair of min-hashes. In a shard of up to ``cell`` nodes a BK-tree over the fingerprints of the
    sets proposes every pair within the radius, and each is verified unless its ends are connected already: a shard gives a
    forest, never all pairs. A larger shard is cut in cells by a hash; what a cell doesn't settle is dealt again by how it
    differs from what most nodes of the cell have in common (similar sets differ from it alike), until no shard is larger than
    a cell. Shards whose nodes are all connected aren't looked at any more. A link can be missed where fingerprints are beyond
    the radius, where no min-hashes agree, or where both ends are in a cut shard and meet in no cell; README gives the recall.

    Null and empty texts are copies of one another; rows of one id are one document; rows without an id name no node.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sketches():
        known = WordHashes()

        def sketch(t: bytes | None) -> tuple:
            s = shingles(t, known)
            return xxhash.xxh128_digest(b" ".join((t or b"").lower().split())), band_keys(s)

        return lambda texts: [sketch(t) for t in texts]

    marked = map_texts(base, ("doc_id",), "text", sketches, {"digest": pa.binary(), "bands": pa.list_(pa.int64())}, "digest binary, bands array<bigint>", binary=True)
    marked = written(marked, "sketches")
    nodes = written(marked.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")).where("id is not null"), "nodes")

    def sizes_of(rows: DataFrame, *more) -> DataFrame:
        return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *more).where("n > 1")

    # sets of the nodes that share a key with another
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    shared = written(sizes_of(keyed), "shards")
    dealt = written(join_counted(keyed, shared, "key").select("key", "id"), "dealt")

    def packs():
        known = WordHashes()

        def pack(t: bytes | None) -> tuple:
            s = shingles(t, known)
            return set_fingerprint(s), np.unique(s.astype("<u4")).tobytes()

        return lambda texts: [pack(t) for t in texts]

    wanted = base.join(dealt.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    sets = map_texts(wanted, ("doc_id",), "text", packs, {"fp": pa.int64(), "s": pa.binary()}, "fp long, s binary", binary=True)
    sets = written(sets.withColumnRenamed("doc_id", "id").dropDuplicates(["id"]), "sets")

    todo, edges, labels = dealt, None, None
    while True:
        rows = todo.withColumn("label", F.col("id")) if labels is None else todo.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        groups = sizes_of(rows, (F.min("label") < F.max("label")).alias("open")).where("open")
        groups = written(groups.withColumn("cells", F.ceil(F.col("n") / cell)), "groups")
        members = join_counted(rows, groups, "key").select("key", F.pmod(F.xxhash64("id", "key"), "cells").alias("cell"), F.expr("cells > 1").alias("cut"), "id", "label")
        held = members.join(sets, "id").select("key", "cell", "cut", "id", "label", "fp", "s")
        found = grouped_stream(held, ["key", "cell", "cut"], ["id"], lambda k, c: cell_links(k[0], k[2], c, similarity), {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64()}, "kind int, a long, b long")
        found = written(found, "found")
        discard(groups)
        todo = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
        more = found.where("kind = 0").select("a", "b")
        edges = more if edges is None else edges.union(more)
        if more.limit(1).count():
            labels = min_labels(edges).withColumnRenamed("node", "id")
        if todo.limit(1).count() == 0:
            break
    least = nodes.select("digest", "n", F.col("id").alias("least")) if labels is None else nodes.join(labels, "id", "left").select("digest", "n", F.coalesce("label", "id").alias("least"))
    return join_counted(marked, written(least, "least"), "digest").where("doc_id > least").select("doc_id").distinct()
