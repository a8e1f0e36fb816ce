"""Line deduplication, divergence audit and hard negatives against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import divergence, hard_negatives, line_dedup
from heliograph.llm.shared import written


def plain_lines(rows, min_docs, min_chars=1, keep_first=False):
    """Kept text by row, of rows ``(doc_id, text)``."""
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda x: x.strip(line_dedup.BLANKS).translate(low)
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    held, seen = Counter(), set()
    for d in docs:
        held.update({key(x) for x in d[2].split("\n") if len(key(x)) >= min_chars})
    kept = {}
    for d in docs:
        lines = []
        for x in d[2].split("\n"):
            common = len(key(x)) >= min_chars and held[key(x)] >= min_docs
            if not common or (keep_first and key(x) not in seen):
                lines.append(x)
            seen.add(key(x))
        kept[d] = "\n".join(lines)
    return [kept[(i is not None, i or 0, t or "")] for i, t in rows]


@pytest.mark.parametrize("min_chars", [0, 1, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_equal_brute_force(spark, min_chars, keep_first):
    rng = np.random.default_rng(3)
    pool = ["", " ", "Menu", "menu ", "\tMENU", "ab", "É b", "é b", "a ", "long line of its own", "x\r"]
    rows = [(int(i), "\n".join(rng.choice(pool, rng.integers(1, 9)))) for i in range(60)] + [(60, None), (61, ""), (62, "only\n"), (62, "only\n"), (None, "Menu\nnull id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")).withColumn("pos", F.lit(1))
    out = line_dedup.line_bitmaps(df, ("doc_id", "text", "hash"), with_text=True, min_docs=20, min_chars=min_chars, keep_first=keep_first).collect()
    assert len(out) == len(rows)
    want = dict(zip(rows, plain_lines(rows, 20, min_chars, keep_first), strict=True))
    for r in out:
        assert r["kept_text"] == want[(r["doc_id"], r["text"])], r
        assert sum(r["keep"]) == r["n_lines"] == len((r["text"] or "").split("\n"))
        assert sum(r["keep"][1::2]) == r["n_dropped"]


def test_line_windows_use_the_range_partitioning(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup.first_occurrences(line_dedup.line_rows(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(hash" in plan and plan.count("Sort [") == 1


def test_no_lines_of_an_empty_table_and_a_very_long_text(spark):
    assert line_dedup.line_bitmaps(spark.createDataFrame([], "doc_id long, text string"), with_text=True).count() == 0
    long = "\n".join(f"line {i % 50_000}" for i in range(150_000))
    df = spark.createDataFrame([(i, long if i < 2 else "line 7") for i in range(4)], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_bitmaps(df, min_docs=3, with_text=True).collect()}
    assert out == {0: (150_000, 3), 1: (150_000, 3), 2: (1, 1), 3: (1, 1)}


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in held if held[t] >= min_docs)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)}
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


@pytest.mark.parametrize("cells", [6, 400_000])
def test_audit_equals_brute_force(spark, cells):
    rng = np.random.default_rng(5)
    pool = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Straße", "STRASSE", "日本", "a1b"]
    rows = []
    for i in range(300):
        words = rng.choice(pool, rng.integers(0, 30), p=None)
        rows.append((["en", "de", None, ""][i % 4], [f"s{i % 7}", None, ""][0 if i % 11 else i % 3], " ".join(words)))
    rows += [("xx", "lonely", "nothing kept"), ("yy", "a", None), ("yy", "b", "12 34"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash"))
    got = [tuple(r) for r in divergence.divergence_audit(df, min_docs=10, cells=cells).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 10, 10)
    assert divergence.divergence_audit(df.limit(0)).count() == 0


def test_shares_are_exact_for_very_large_counts():
    count = np.array([[5_000_000_000_000_123, 2, 9_000_000_000_000_000]])
    total = np.array([[9_000_000_000_000_007]])
    assert divergence._share(count, total).tolist() == [[1 + 10**9 * int(c) // int(total[0, 0]) for c in count[0]]]


def test_words_are_handed_on_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"en"] * 4), pa.array([b"a", b"a", b"b", b"a"]), pa.array([b"x y z w x", b"X", b"", b"x q"])], ["a", "b", "c"])
    out = list(divergence._task_counts(iter([batch])))
    total = Counter()
    for b in out:
        for r in b.to_pylist():
            total[(r["source"], r["term"])] += r["n"]
    assert len(out) > 1 and total == {(b"a", None): 0, (b"b", None): 0, (b"a", b"x"): 4, (b"a", b"y"): 1, (b"a", b"z"): 1, (b"a", b"w"): 1, (b"a", b"q"): 1}


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, v)), (label, v))
    dim = max(len(v) for _, v in best.values())
    y = {i: np.array([int(np.floor(256 * float(x))) for x in v] + [0] * (dim - len(v)), dtype=object) for i, (_, v) in best.items()}
    out = set()
    for a in best:
        if not is_anchor(a):
            continue
        ranked = sorted((-int(y[a] @ y[i]), i) for i in best if i != a)
        for ps, p in [r for r in ranked if best[r[1]][0] == best[a][0]][:positives]:
            fit = [(s, i) for s, i in ranked if best[i][0] != best[a][0] and low * -ps <= 100 * -s <= high * -ps][:negatives]
            out |= {(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit)}
    return out


def vectors(kind, n, dim=8):
    rng = np.random.default_rng(11)
    if kind == "clustered":
        centres = rng.normal(size=(12, dim))
        x = (centres / np.linalg.norm(centres, axis=1, keepdims=True))[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.02
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "ties":
        x = rng.integers(-1, 2, size=(n, 3)) / 2
    else:
        x = rng.normal(size=(n, dim))
    return [(i, [float(np.float32(v)) for v in row], int(rng.integers(0, 3))) for i, row in enumerate(x)]


@pytest.mark.parametrize(("kind", "most_anchors", "most_rows"), [("random", 65_536, 65_536), ("clustered", 10, 150), ("ties", 7, 100)])
def test_negatives_equal_brute_force(spark, kind, most_anchors, most_rows):
    rows = vectors(kind, 600)
    odd = [(601, None, 1), (602, [1.0] * 8, None), (603, [float("nan")] * 8, 1), (604, [None] * 8, 1), (605, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), rows[10], (rows[10][0], rows[11][1], 0), (610, [], 1), (620, [0.5], 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit("clash"))
    out = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, pivots=16, most_anchors=most_anchors, most_rows=most_rows)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows + odd, lambda i: i % 10 == 0)


def test_vectors_without_components(spark):
    df = spark.createDataFrame([(i, [], i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int")
    got = {tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 10 == 0).collect()}
    assert got == plain_negatives([(i, [], i % 2) for i in range(20)], lambda i: i % 10 == 0) and len(got) == 30


def test_no_anchors_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 1), (2, [0.5], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df, F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") > 0).count() == 0


def test_bounds_keep_rows_from_groups_that_they_cannot_serve(spark, monkeypatch):
    """On clustered vectors most rows go to few groups, and what a row is ruled out for isn't needed (see the brute-force test)."""
    sent = []
    route = hard_negatives.route
    monkeypatch.setattr(hard_negatives, "route", lambda *a: sent.append(written(route(*a), "sent")) or sent[-1])
    df = spark.createDataFrame(vectors("clustered", 600), "vec_id long, embedding array<float>, label int")
    hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, pivots=16, most_anchors=10).count()
    groups = sent[0].select("group").distinct().count()
    assert groups >= 6
    assert sent[0].count() < 0.7 * groups * 600 and sent[1].count() < 0.7 * groups * 600, [x.count() / groups / 600 for x in sent]


def test_groups_are_bounded():
    apart = np.abs(np.arange(6)[:, None] - np.arange(6)[None, :]).astype(float)
    first, parts = hard_negatives.plan_groups(np.array([3, 0, 25, 4, 4, 9]), apart, 10)
    assert parts.tolist() == [1, 0, 3, 1, 1, 1]
    held = Counter()
    for c, n in enumerate([3, 0, 25, 4, 4, 9]):
        for g in range(first[c], first[c] + parts[c]):
            held[g] += -(-n // parts[c])
    assert max(held.values()) <= 10
