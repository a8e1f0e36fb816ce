"""Fuzzy passages that documents share, by seeding, collinear chaining and alignment.

Each document gives seeds: a fixed share of the hashes of its k-mers of words, the first of equal ones. Every seed that several
documents hold belongs to the one with the least id, its owner; all other holders are matched with the owner only, so a passage
that a third of all documents share costs one match a document, not one a pair. A document and an owner with two neighbouring seeds
that lie about as far apart in both are compared whole (with few such seeds only if one byte a word shows a passage too): the equal runs of FINE words are chained in order by a Fenwick tree of prefix maxima, with costs for gaps; a
chain's two stretches of words are aligned (bit-parallel longest common subsequence), grown at both ends while words are equal,
cut at the widest gap and aligned again while they aren't similar, and kept from MIN_WORDS on at SIMILARITY.

A seed's owner may hold that seed only, in a short quotation, while others share the whole passage. So the shared seeds that lie
in no passage of their document are matched again, by runs: two seeds, up to twelve apart in order, are one key, owned by the
least of the documents that hold it outside their passages. This is repeated until no new passage appears.

Words are compared by 32 bits of their hashes. Seeds and runs are dealt once, by ranges of their hashes, where owners are found;
rows of keys that very many documents hold are dealt by document instead and joined with their owner.

Documents that share a passage are linked through the owners of its seeds. Defined results: null and empty texts and null ids
share nothing; repeated rows of an id are one document; a passage repeated inside one document counts at its first place; case
of ASCII letters and ASCII punctuation don't count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.shared import WordHashes, discard, frequent, join_counted, map_texts, written

#: Words in a k-mer, and the share of all k-mers' hashes that are seeds, one in so many: a passage with every fifth word changed has
#: k-mers of four words only.
K = 4
ONE_IN = 3
MIN_SEEDS = 2
#: Two seeds of a pair speak for a passage if they are at most so many words apart and keep their distance but for this share.
NEAR = 160
SHIFT = 0.25
#: Runs of seeds that get an owner of their own: from one seed to so many further on.
RUNS = (1, 2, 3, 5, 8, 12)
MIN_WORDS = 50
SIMILARITY = 0.8
#: Score of a seed, and cost of a word skipped on either side between two seeds.
SEED_SCORE = 8.0
GAP_COST = 0.08
#: Words of an equal run that anchors a chain of two documents, and words between anchors of a longer one.
FINE = 4
#: Leading bits of a run's hash by which most runs that a document lacks are told at once.
LEADING = 16
STEP = 24
#: Bytes of words of one owner's documents that are compared together, about.
AT_ONCE = 100_000
#: Pairs of one owner that one copy of its words serves.
OWNER_PAIRS = 2000
#: Seeds or runs that one task has at hand at a time, about, and rows of a key in one batch beyond which the rest take another way.
GROUP = 400_000
CROWD = 100
#: Words by which a passage of one byte a word may be shorter, and neighbouring seeds from which on a pair isn't screened so.
SLACK = 5
STRONG = 8
#: Pairs are compared in up to so many turns, by a hash of their document, so that the words sent to owners are on disk for one
#: turn only; fewer turns serve for fewer pairs than this a turn.
TURNS = 4
TURN_PAIRS = 20_000

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_hashes(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    tokens = (text or b"").lower().translate(None, _PUNCTUATION).split()
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of a text's seeds, each hash once at its first place."""
    n = len(hashes) - K + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        kmers = np.zeros(n, dtype=np.uint64)
        for j in range(K):
            kmers = kmers * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        kmers = (kmers ^ (kmers >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        kmers ^= kmers >> np.uint64(29)
    ordered = np.sort(kmers)
    if not (ordered[1:] == ordered[:-1]).any():
        first = np.flatnonzero(kmers % np.uint64(ONE_IN) == 0)
        return kmers[first].view(np.int64), first
    picked, first, counts = np.unique(kmers, return_index=True, return_counts=True)
    kept = (picked % np.uint64(ONE_IN) == 0) | (counts > 1)  # a repeated line has few k-mers: all of them
    return picked[kept].view(np.int64), first[kept]


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint chains of matches ``(position, owner's position)`` that ascend strictly on both sides, best first.

    A match extends the chain that ends before it on both sides with the highest score less gap costs, found as a prefix
    maximum over the owner's positions in a Fenwick tree; if that gains nothing it begins a chain.
    """
    matches = sorted(set(matches))
    ranks = {o: i + 1 for i, o in enumerate(sorted({o for _, o in matches}))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, before = [0.0] * len(matches), [-1] * len(matches)
    i = 0
    while i < len(matches):
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:  # equal positions don't follow each other
            p, o = matches[j]
            best, r = (-np.inf, -1), ranks[o] - 1
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            gain = best[0] - GAP_COST * (p + o)
            score[j] = SEED_SCORE + max(0.0, gain)
            before[j] = best[1] if gain > 0 else -1
            j += 1
        for x in range(i, j):
            p, o = matches[x]
            entry, r = (score[x] + GAP_COST * (p + o), x), ranks[o]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    used, out = [False] * len(matches), []
    for x in sorted(range(len(matches)), key=lambda x: (-score[x], x)):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(matches[x])
            x = before[x]
        if chain:
            out.append(chain[::-1])
    return out


def common(a: np.ndarray, b: np.ndarray, least: float = 0) -> int:
    """Length of the longest common subsequence, or some number below ``least`` if that isn't reached; equal ends are cut off first."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    met = list(filter(None, map(where.get, b.tolist())))
    if head + tail + len(met) < least:
        return head + tail + len(met)
    full = (1 << len(a)) - 1
    row = full
    for places in met:
        hit = row & places
        row = (row + hit | row - hit) & full
    return head + tail + len(a) - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, core_a: tuple[int, int], core_b: tuple[int, int]) -> tuple[int, int, int, int, float]:
    """The stretches grown while words are equal, and the share of the longer one that is in order in the other (less than SIMILARITY
    may be too much, but stays less)."""
    (a0, a1), (b0, b1) = core_a, core_b
    equal = a1 - a0 == b1 - b0 and (a[a0:a1] == b[b0:b1]).all()
    while a0 > 0 and b0 > 0 and a[a0 - 1] == b[b0 - 1]:
        a0, b0 = a0 - 1, b0 - 1
    while a1 < len(a) and b1 < len(b) and a[a1] == b[b1]:
        a1, b1 = a1 + 1, b1 + 1
    longer = max(a1 - a0, b1 - b0, 1)
    return a0, a1, b0, b1, 1.0 if equal else common(a[a0:a1], b[b0:b1], SIMILARITY * longer - 0.5) / longer


def fine_runs(x: np.ndarray) -> np.ndarray:
    """A hash for each run of FINE words, in order; of words of one byte the run itself, mixed."""
    if len(x) < FINE:
        return np.empty(0, np.uint64)
    if x.dtype == np.uint8:
        runs = x.astype(np.uint32)
        for width in (1, 2):  # FINE is four: two words, two pairs
            runs = (runs[:-width] << np.uint32(8 * width)) | runs[width:]
        return runs * np.uint32(0x9E3779B1)
    runs = x.astype(np.uint64)
    for width, by in ((1, 0x9E3779B97F4A7C15), (2, 0x9E3779B97F4A7C15**2 % 2**64)):  # it wraps
        runs = runs[:-width] * np.uint64(by) + runs[width:]
    return runs


def leading_bits(runs: np.ndarray) -> np.ndarray:
    return runs >> runs.dtype.type(8 * runs.itemsize - LEADING)


def first_places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of FINE words, sorted, the first place of each, and which leading bits occur."""
    known, at = np.unique(fine_runs(b), return_index=True)
    leading = np.zeros(1 << LEADING, dtype=bool)
    leading[leading_bits(known)] = True
    return known, at, leading


def anchors(texts: list[np.ndarray], places: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each of the texts places ``(its, owner's)`` of runs of FINE words that the owner, known by its ``first_places``, has too,
    each run at its first place; of a longer equal stretch its ends and every STEP-th place."""
    runs, (known, at, leading) = fine_runs(np.concatenate(texts)), places
    p = np.flatnonzero(leading[leading_bits(runs)])
    if not len(p):
        return [[] for _ in texts]
    near = np.minimum(np.searchsorted(known, runs[p]), len(known) - 1)
    equal = known[near] == runs[p]
    p, near = p[equal], near[equal]
    sizes = np.array([len(a) for a in texts])
    ends = np.cumsum(sizes)
    text = np.searchsorted(ends, p, "right")
    inside = p + FINE <= ends[text]  # not from one text into the next
    p, near, text = p[inside], near[inside], text[inside]
    _, first = np.unique(text * len(known) + near, return_index=True)
    text = text[first]
    p, o = p[first] - (ends - sizes)[text], at[near[first]]
    order = np.lexsort((p, o - p, text))
    p, o, text = p[order], o[order], text[order]
    begins = np.ones(len(p) + 1, dtype=bool)  # and one past the end
    begins[1:-1] = (p[1:] - p[:-1] != 1) | (o[1:] - o[:-1] != 1) | (text[1:] != text[:-1])
    since = np.arange(len(p)) - np.flatnonzero(begins)[np.cumsum(begins[:-1]) - 1]
    kept = (since % STEP == 0) | begins[1:]
    pairs, cuts = list(zip(p[kept].tolist(), o[kept].tolist(), strict=True)), np.searchsorted(text[kept], np.arange(len(texts) + 1)).tolist()
    return [pairs[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def passages_between(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int]] | None = None, least: int = MIN_WORDS) -> list[tuple[int, int, int, int, float]]:
    """The passages of ``least`` words and more of two documents' words (``matches``: their ``anchors``). A chain that isn't similar as a whole is cut at
    its widest gap, and its pieces are aligned again."""
    out, matches = [], anchors([a], first_places(b))[0] if matches is None else matches
    if not matches:
        return out
    (p, o), (q, r) = matches[0], matches[-1]
    todo = [matches] if q - p == r - o <= STEP else chains(matches)  # near places of one distance are one chain
    while todo:
        chain = todo.pop()
        found = aligned(a, b, (chain[0][0], chain[-1][0] + FINE), (chain[0][1], chain[-1][1] + FINE))
        x0, x1, y0, y1, same = found
        if same >= SIMILARITY:
            if min(x1 - x0, y1 - y0) >= least:
                out.append(found)
        elif len(chain) > 1:
            at = max(range(1, len(chain)), key=lambda i: max(chain[i][0] - chain[i - 1][0], chain[i][1] - chain[i - 1][1]))
            todo += [chain[:at], chain[at:]]
    return out


def prime(least: int) -> int:
    """The first prime number from ``least`` on: ids with a common step are dealt evenly by the remainder."""
    return next(n for n in range(max(2, least), 2 * least + 4) if all(n % i for i in range(2, int(n**0.5) + 1)))


#: Numbers that travel as bytes, many in a row.
KINDS = {"key": "<i8", "doc": "<i8", "owner": "<i8", "pos": "<i4", "there": "<i4", "p": "<i4", "q": "<i4"}


def lists(group: np.ndarray, columns: dict[str, np.ndarray], name: str) -> pa.RecordBatch:
    """A row for each run of equal numbers in ``group``, named ``name``, with its part of each column as bytes (``KINDS``)."""
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(group), 1), bool), group[1:] != group[:-1]]))
    ends = np.append(begins, len(group))
    parts = []
    for c, x in columns.items():
        x = np.ascontiguousarray(x, KINDS[c])
        parts.append(pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(group[begins], pa.int64()), *parts], [name, *columns])


def flat(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), KINDS[name])


def equal_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins, and its length."""
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return begins, np.diff(np.append(begins, len(key)))


def by_key(groups: int, key: np.ndarray, doc: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch as bytes by group of keys. Of a key that more than CROWD rows have, the first ones and the last go there;
    the others go to negative groups, by document, since other batches may have as many."""
    order = np.argsort(key.view(np.uint64))
    begins, sizes = equal_keys(key[order])
    crowd = []
    for i in np.flatnonzero(sizes > CROWD + 1):  # few
        rows = slice(begins[i], begins[i] + sizes[i])
        order[rows] = order[rows][np.argsort(doc[order[rows]])]
        crowd.append(np.arange(begins[i] + CROWD, begins[i] + sizes[i] - 1))
    key, doc, more = key[order], doc[order], {k: x[order] for k, x in more.items()}
    group = ((key.view(np.uint64) >> np.uint64(33)) * np.uint64(groups) >> np.uint64(31)).astype(np.int64)
    if crowd:
        crowd = np.concatenate(crowd)
        group[crowd] = -1 - doc[crowd] % groups
        order = np.argsort(group, kind="stable")
        group, key, doc, more = group[order], key[order], doc[order], {k: x[order] for k, x in more.items()}
    return lists(group, {"key": key, "doc": doc, **more}, "group")


def owned(table: pa.Table, *more: str) -> tuple[np.ndarray, ...]:
    """Of a group that ``by_key`` made, the rows of keys that several documents have: key, document, owner, the columns ``more`` and
    for the first of these the owner's, and the rows that stand for keys that may be crowded. Rows of a negative group stay, all
    without owners."""
    key, doc, *rest = [flat(table, c) for c in ("key", "doc", *more)]
    if table.column("group")[0].as_py() < 0:
        return key, doc, None, *rest, None, None
    order = np.argsort(key)
    begins, sizes = equal_keys(key[order])
    order = order[np.repeat(sizes > 1, sizes)]  # most keys have one row
    order = order[np.lexsort((rest[0][order], doc[order], key[order]))]
    key, doc, rest = key[order], doc[order], [x[order] for x in rest]
    begins, sizes = equal_keys(key)
    kept = np.repeat(doc[begins] != doc[begins + sizes - 1], sizes)
    first = np.repeat(begins, sizes)[kept]
    heads = np.repeat(sizes > CROWD, sizes)[kept] & (np.flatnonzero(kept) == first)
    return key[kept], doc[kept], doc[first], *[x[kept] for x in rest], rest[0][first], heads


def crowded(rest: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of crowded keys with the columns of ``heads``, a row (or equal ones) a key."""
    n = written(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "crowded")
    return join_counted(rest, written(heads.distinct().join(n, "key"), "owners"), "key").drop("n")


def near_pairs(doc: np.ndarray, owner: np.ndarray, pos: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and owners with two seeds that follow each other, are near, and lie about as far apart on both sides, and whether
    they have many of these."""
    order = np.lexsort((there, pos, owner, doc))
    doc, owner, pos, there = (x[order] for x in (doc, owner, pos, there))
    step, other = pos[1:] - pos[:-1], there[1:] - there[:-1]
    near = (doc[1:] == doc[:-1]) & (owner[1:] == owner[:-1]) & (doc[1:] != owner[1:]) & (step <= NEAR) & (other > 0) & (abs(other - step) <= 1 + SHIFT * step)
    doc, owner = doc[1:][near], owner[1:][near]
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(doc), 1), bool), (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])]))
    return doc[begins], owner[begins], np.diff(np.append(begins, len(doc))) >= STRONG


def free_runs(doc: np.ndarray, pos: np.ndarray, h: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs of two seeds that lie in none of their document's passages (``spans``: documents, starts and ends): key, document, places."""
    order = np.lexsort((h, pos, doc))
    doc, pos, h = doc[order], pos[order], h[order]
    kept = np.ones(len(doc), dtype=bool)
    kept[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (h[1:] != h[:-1])
    at = np.argsort(spans[0], kind="stable")
    held, start, end = (x[at] for x in spans)
    low, high = np.searchsorted(held, doc), np.searchsorted(held, doc, "right")
    row = np.repeat(np.arange(len(doc)), high - low)
    span = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - high, high - low)
    kept[row[(start[span] <= pos[row]) & (end[span] >= pos[row] + K)]] = False
    doc, pos, h = doc[kept], pos[kept], h[kept].view(np.uint64)
    out = []
    for n in RUNS:
        i = np.flatnonzero(doc[n:] == doc[:-n])
        key = (h[i] ^ (h[i] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[i + n]  # wraps
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(((key ^ (key >> np.uint64(29))).view(np.int64), doc[i], pos[i], pos[i + n]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def with_owner(rows: DataFrame, key: str, there: str | None = None) -> DataFrame:
    """The rows (``key``, ``doc``, others) of keys that several documents have, with ``owner``, the least of these, and ``n``, the rows
    of the key; with a column ``there`` also the owner's, as ``there``. Keys are counted before they are shuffled, and very frequent
    ones don't meet in one task."""
    more = [F.min_by(there, "doc").alias("there")] if there else []
    owners = rows.groupBy(key).agg(F.min("doc").alias("owner"), F.max("doc").alias("_last"), F.count(F.lit(1)).alias("n"), *more)
    return join_counted(rows, written(owners.where("owner <> _last").drop("_last"), "owners"), key)


def touched(keys: DataFrame, fresh: DataFrame, many: DataFrame | None = None) -> DataFrame:
    """The rows (``key, doc, p, q``) of keys that a document of ``fresh`` (``doc, fresh``) holds: after new passages no other key can get
    another owner. Only these are joined; ``many``: ``frequent(keys, "key")``."""
    again = keys.join(fresh, "doc").select("key").distinct()
    counted = again.join(F.broadcast(frequent(keys, "key") if many is None else many), "key", "left").select("key", F.coalesce("n", F.lit(1)).alias("n"))
    return join_counted(keys, written(counted, "keys"), "key").select("key", "doc", "p", "q")


def shared_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, other_id, start_word, end_word, other_start, other_end, similarity``: each document's passages with an owner
    (``other_id`` is less than ``doc_id``); word positions, ends exclusive."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")

    def make():
        known = WordHashes()

        def hashed(texts: list) -> list[tuple]:
            out = [(word_hashes(t, known) & np.uint64(0xFFFFFFFF)).astype("<u4") for t in texts]
            return [(w.tobytes(), (w & np.uint32(0xFF)).astype(np.uint8).tobytes()) for w in out]

        return hashed

    packed = written(map_texts(base, ("doc",), "text", make, {"w": pa.binary(), "v": pa.binary()}, "w binary, v binary", binary=True), "words", "doc")
    groups = 1 + (packed.agg(F.sum(F.length("v"))).first()[0] or 0) // (ONE_IN * GROUP)
    parts = prime(groups)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seeds(np.frombuffer(w, "<u4").astype(np.uint64)) for w in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(h) for h, _ in found])
            join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
            yield by_key(groups, join([h for h, _ in found]), ids, pos=join([p for _, p in found]).astype(np.int32))

    def own_seeds(table: pa.Table) -> pa.Table:
        key, doc, owner, pos, there, heads = owned(table, "pos")
        columns = {"key": key, "doc": doc, "pos": pos, "owner": owner, "there": there}
        order = np.argsort(doc % parts, kind="stable")
        out = [lists((doc % parts)[order], {k: x[order] for k, x in columns.items() if x is not None}, "part")]
        if owner is None:
            for k in ("owner", "there"):
                out[0] = out[0].append_column(k, pa.nulls(len(out[0]), pa.binary()))
        else:
            out.append(lists(np.full(heads.sum(), -1), {k: x[heads] for k, x in columns.items()}, "part"))
        return pa.Table.from_batches([x.cast(out[0].schema) for x in out])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(k).to_numpy() for k in batch.schema.names}
            order = np.argsort(columns["doc"] % parts, kind="stable")
            yield lists((columns["doc"] % parts)[order], {k: x[order] for k, x in columns.items()}, "part")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(flat(batch, c)) for c in batch.schema.names], batch.schema.names)

    def propose(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("doc", "owner", "strong"), near_pairs(*[flat(table, c) for c in ("doc", "owner", "pos", "there")]), strict=True)))

    def run(seeds: pa.Table, spans: pa.Table) -> pa.Table:
        if not len(seeds):
            return pa.Table.from_batches([by_key(groups, *[np.empty(0, np.int64)] * 2, p=np.empty(0, np.int32), q=np.empty(0, np.int32))])
        key, doc, p, q = free_runs(*[flat(seeds, c) for c in ("doc", "pos", "key")], [spans.column(c).to_numpy() for c in ("doc", "start_word", "end_word")])
        return pa.Table.from_batches([by_key(groups, key, doc, p=p, q=q)])

    def own_runs(table: pa.Table) -> pa.Table:
        key, doc, owner, p, q, *_ = owned(table, "p", "q")
        return pa.table({"key": key, "doc": doc, "p": p, "q": q, "owner": pa.nulls(len(key), pa.int64()) if owner is None else owner})

    kinds = [pa.int64()] * 6 + [pa.float64()]
    names = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "similarity"]

    def pairwise(batch: pa.RecordBatch, kind: str, least: int) -> Iterator[tuple]:
        """Document, owner, copy and passages of each pair in a batch. Pairs of one owner mostly follow each other and are compared
        together, up to AT_ONCE bytes."""
        sides, held = [c.to_pylist() for c in batch.columns[3:]], 0
        ids = list(zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True))
        begin = 0
        for i, (a, b) in enumerate(zip(*sides, strict=True)):
            held += len(a)
            if i + 1 < len(ids) and sides[1][i + 1] == b and held < AT_ONCE:
                continue
            other, texts = np.frombuffer(b, kind), [np.frombuffer(x, kind) for x in sides[0][begin : i + 1]]
            for at, x, matches in zip(ids[begin : i + 1], texts, anchors(texts, first_places(other)), strict=True):
                yield *at, passages_between(x, other, matches, least)
            begin, held = i + 1, 0

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x[:3] for x in pairwise(batch, "u1", MIN_WORDS - SLACK) if x[3]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["doc", "owner", "copy"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, owner, *x[:4], round(x[4], 6)) for doc, owner, _, found in pairwise(batch, "<u4", MIN_WORDS) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def sides(pairs: DataFrame, words: str) -> DataFrame:
        """The words of both documents of pairs ``doc, owner, copy``."""
        owners = pairs.select("owner", "copy").distinct().join(packed.select(F.col("doc").alias("owner"), F.col(words).alias("b")), "owner")
        return pairs.join(packed.select("doc", F.col(words).alias("a")), "doc").join(owners, ["owner", "copy"]).select("doc", "owner", "copy", "a", "b")

    def passages_of(pairs: DataFrame) -> DataFrame:
        """Pairs ``doc, owner, strong`` are screened by one byte a word unless they are strong, then compared. Those of an owner that many documents have are spread over copies
        of its words."""
        counts = written(pairs.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.ceil(F.col("n") / OWNER_PAIRS)), "owners")
        spread = written(join_counted(pairs, counts, "owner").select("doc", "owner", "strong", F.pmod(F.xxhash64("doc"), "copies").alias("copy")), "copies")
        likely = sides(spread.where("not strong"), "v").mapInArrow(screen, "doc long, owner long, copy long")
        left = written(likely.union(spread.where("strong").select("doc", "owner", "copy")), "screened")
        turns = min(TURNS, 1 + left.count() // TURN_PAIRS)
        turn = F.pmod(F.xxhash64("doc", F.lit(turns)), F.lit(turns))
        schema = "doc_id long, other_id long, start_word long, end_word long, other_start long, other_end long, similarity double"
        out = reduce(DataFrame.union, [written(sides(left.where(turn == i), "w").mapInArrow(align, schema), "passages") for i in range(turns)])
        discard(counts, spread, left)
        return out

    found = packed.select("doc", "w").mapInArrow(seed, "group long, key binary, doc binary, pos binary")
    in_parts = "part long, key binary, doc binary, pos binary, owner binary, there binary"
    shared = [written(found.groupBy("group").applyInArrow(own_seeds, in_parts), "shared-seeds")]
    rest = shared[0].where("owner is null")
    if rest.limit(1).count():
        # written, so that no task runs two Python workers, to unpack rows and to pack them again
        rest = written(rest.select("key", "doc", "pos").mapInArrow(unpack, "key long, doc long, pos int"), "rest")
        heads = written(shared[0].where("part = -1").select("key", "owner", "there").mapInArrow(unpack, "key long, owner long, there int"), "heads")
        rows = crowded(rest, heads)
        shared.append(written(rows.select("key", "doc", "pos", "owner", "there").mapInArrow(pack, in_parts), "shared-seeds"))
        discard(rest, heads)
    in_docs = reduce(DataFrame.union, [shared[0].where("owner is not null and part >= 0"), *shared[1:]])

    tried = written(in_docs.groupBy("part").applyInArrow(propose, "doc long, owner long, strong boolean"), "pairs")
    passages = passages_of(tried)

    def free(rows: DataFrame, *places: str) -> DataFrame:
        """Rows of documents' seeds of which none lies in a passage found."""
        spans = passages.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
        held = lambda at: F.exists("spans", lambda x: (x["start_word"] <= F.col(at)) & (x["end_word"] >= F.col(at) + K))
        inside = reduce(or_, map(held, places))
        return rows.join(spans, "doc", "left").where(~F.coalesce(inside, F.lit(False))).drop("spans")

    # runs: keys of two free seeds of a document, so far apart in order, that another document has too
    spans = passages.select(F.pmod("doc_id", F.lit(parts)).alias("part"), F.col("doc_id").alias("doc"), "start_word", "end_word").distinct()
    runs = in_docs.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(run, "group long, key binary, doc binary, p binary, q binary")
    keys = written(runs.groupBy("group").applyInArrow(own_runs, "key long, doc long, p int, q int, owner long"), "runs")
    rest = keys.where("owner is null")
    discard(*shared)
    if rest.limit(1).count():
        rows = crowded(rest.drop("owner"), keys.where("owner = doc").select("key", "owner"))
        first, keys = keys, written(keys.where("owner is not null").unionByName(rows), "runs")
        discard(first)
    held, many = keys, None
    while True:
        pairs = held.where("doc <> owner").select("doc", "owner").distinct()
        pairs = written(pairs.join(tried, ["doc", "owner"], "left_anti").withColumn("strong", F.lit(False)), "pairs")
        if pairs.limit(1).count() == 0:
            discard(packed, keys)
            return passages.distinct()
        more = passages_of(pairs)
        fresh = more.select(F.col("doc_id").alias("doc"), F.lit(True).alias("fresh")).distinct()
        if fresh.limit(1).count() == 0:
            discard(packed, keys)
            return passages.distinct()
        tried, passages = tried.union(pairs), passages.union(more)
        many = frequent(keys, "key") if many is None else many
        held = with_owner(free(touched(keys, fresh, many), "p", "q"), "key")
