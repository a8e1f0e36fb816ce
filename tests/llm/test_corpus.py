"""Corpus operators: hand-made cases, brute-force versions, and odd inputs."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import decontaminate, html_extract, language_id, license_scan, near_dups, passages, pii, quality_rules, secret_scan, source_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string"
RNG = np.random.default_rng(5)


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghiklmnoprstu"), r.integers(2, 9))) for _ in range(n))


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = prose(30_000, 1)
ODD = [None, "", " \n\t", "x", "é" * 10, LONG, LONG, "..."]
RUNS = {
    "quality": lambda d: quality_rules.quality_rules(d),
    "licenses": lambda d: license_scan.scan_licenses(d),
    "secrets": lambda d: secret_scan.scan_secrets(d),
    "pii": lambda d: pii.find_pii(d),
    "language": lambda d: language_id.identify_languages(d),
    "near": lambda d: near_dups.near_duplicates(d),
    "mix": lambda d: source_mix.mix_sources(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_texts_give_a_row_each_and_empty_tables_none(spark, name):
    d = docs(spark, ODD, [None, "a", None, "b", "a", "a", "a", "b"])
    twice = d.union(d.where("doc_id = 3")).union(spark.createDataFrame([(None,) * 7], SCHEMA))
    assert RUNS[name](twice).count() == len(ODD) + 2
    assert RUNS[name](d.where("false")).count() == 0


def test_odd_inputs_of_pair_operators(spark):
    d = docs(spark, ODD)
    assert passages.shared_passages(d.where("false")).count() == 0
    assert [(r.doc_id, r.other_id) for r in passages.shared_passages(d).collect()] == [(6, 5)]
    b = spark.createDataFrame([(0, None), (1, ""), (2, "x")], "item_id int, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()] == [(3, 2)]
    assert decontaminate.contaminated(d, b.where("false")).count() == 0 == decontaminate.contaminated(d.where("false"), b).count()


def test_repeated_words_and_rules(spark):
    clean, repeated = prose(100, 2), " ".join([prose(10, 3)] * 10)
    nine = prose(8, 4)
    d = docs(spark, [clean, repeated, f"{nine} zz {nine} " + prose(60, 5), "short text"])
    out = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    assert (out[0].n_repeat_words, out[0].kept) == (0, True)
    assert (out[1].n_repeat_words, out[1].kept) == (100, False)
    assert out[2].n_repeat_words == 16 and out[2].kept
    assert out[3].base_failed


def test_poor_hosts_lose_only_failing_documents(spark):
    junk = lambda i: " ".join(w + "##" for w in prose(40, i).split())
    d = docs(spark, [prose(40, i) for i in range(4)] + [junk(10 + i) for i in range(40)] + [prose(40, 60 + i) for i in range(20)] + [junk(99)], ["bad"] * 44 + ["good"] * 21)
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(d).collect()}
    assert all(out[i] for i in range(4)) and not any(out[i] for i in range(4, 44)) and all(out[i] for i in range(44, 65))
    assert sorted(r.doc_id for r in quality_rules.kept_documents(d).collect()) == [i for i, k in sorted(out.items()) if k]
    same = docs(spark, [junk(1), prose(40, 2)] * 2, ["a", "a", "b", "b"])
    assert all(r.kept for r in quality_rules.quality_rules(same).collect())


def test_hosts_of_one_raw_rate_and_different_sizes_get_different_verdicts(spark):
    """30 % failures are chance for 10 documents, and not for 1000; a mean of raw rates would reject both."""
    sizes = {"small": (10, 3), "large": (1000, 300), **{f"plain{i}": (400, 30 + 4 * i) for i in range(6)}}
    rows = [(host, i < failed) for host, (n, failed) in sizes.items() for i in range(n)]
    rated = spark.createDataFrame(rows, "host string, soft_failed boolean").withColumn("base_failed", F.lit(False))
    out = {r.host: r for r in quality_rules.host_verdicts(rated).collect()}
    assert out["large"].host_rejected and not out["small"].host_rejected and out["small"].host_rate < out["large"].host_rate
    assert not any(out[f"plain{i}"].host_rejected for i in range(6))


def test_rates_that_vary_by_chance_only_reject_no_host(spark):
    rows = [(f"h{i}", j < n) for i, n in enumerate([71, 75, 68, 80, 74, 77, 70, 79]) for j in range(500)]
    rated = spark.createDataFrame(rows, "host string, soft_failed boolean").withColumn("base_failed", F.lit(False))
    assert not any(r.host_rejected for r in quality_rules.host_verdicts(rated).collect())


def test_license_positions_and_suppression(spark):
    d = docs(spark, ["Released under the MIT License. CC BY-NC 4.0, cc by nc", "commit license", "GNU General Public License, version 3 or later"])
    out = {r.doc_id: r for r in license_scan.scan_licenses(d).collect()}
    assert (out[0].n_words, out[0].n_base, out[0].first_word, out[0].last_word) == (13, 3, 1, 10)
    assert out[0].base_labels == "cc-by-nc,mit" and "cc-by-nc-4.0" in out[0].labels
    assert (out[1].n_base, out[1].first_word, out[1].labels, out[1].score) == (0, None, "", 0.0)
    assert "gpl-3-or-later" in out[2].labels.split(",") and "gpl" not in out[2].labels.split(",")


def test_secrets_no_retries_and_ownership(spark):
    key = "ghp_" + "a1B2" * 9
    texts = [f"secret=token: abcdefgh AKIA{'Q' * 16} é PASSWORD : 'hunter22'", *[f"see {key} doc {i}" for i in range(5)], "mine ghp_" + "z9Y8" * 9]
    out = {r.doc_id: r for r in secret_scan.scan_secrets(docs(spark, texts, list("abcdefg"))).collect()}
    assert out[0].spans == f"access:{texts[0].index('AKIA')}:{texts[0].index('AKIA') + 20},assign:{texts[0].index('PASSWORD')}:{len(texts[0]) - 1}"
    assert out[0].base_sha256 == hashlib.sha256(out[0].spans.encode()).hexdigest()
    assert out[1].spans == "" and out[1].n_example == 1
    assert out[6].spans.startswith("github:5:") and out[6].n_live == 1


def plain_pii(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        x = re.sub(r"\D", "", m.group())
        s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(x[::-1]))
        if 12 <= len(x) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    r = np.random.default_rng(7)
    for _ in range(3000):
        t = "".join(r.choice(list("a.@+-1 25(0)é4"), r.integers(0, 40)))
        assert pii.base_spans(t) == plain_pii(t), t
    for t in ("@@a.b@c.d", "x@a.b@c.d.", "4111 1111 1111 1111 9", "+1 (017) 555-7713.", "1.2.3.4.5.6.7.8", "256.1.1.1", "@a.b@c.d"):
        assert pii.base_spans(t) == plain_pii(t)


def test_loopy_messages_make_alike_tokens_agree():
    k = len(pii.LABELS)
    nodes = np.zeros((pii.FEATURES, k))
    nodes[0, 1], nodes[1, 0] = 4.0, 0.2
    skip = np.full((k, k), -2.0) + 4 * np.eye(k)
    field = pii.Field(nodes, np.zeros((k, k)), skip)
    alone = field.marginals([[0], [1]], [(0, 1)], [])
    tied = field.marginals([[0], [1]], [(0, 1)], [(0, 1)])
    assert alone[1].argmax() == 0 and tied[1].argmax() == 1


def test_fingerprints_and_components_equal_brute_force(spark):
    base = prose(200, 20).split()
    texts = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 60, 3)] + [prose(80, 100 + i) for i in range(40)] + ["", None, "A b", "a B"]
    out = {r.doc_id: r for r in near_dups.near_duplicates(docs(spark, texts)).collect()}
    fps = [int(out[i].fingerprint, 16) for i in range(len(texts))]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(texts))]
    assert [out[i].component_id for i in range(len(texts))] == label


@pytest.mark.parametrize("cap", [2048, 4])
def test_large_shards_lose_no_link(spark, cap):
    r = np.random.default_rng(3)
    fps = sorted({0} | {int(sum(1 << int(b) for b in set(r.integers(0, 40, r.integers(1, 4))))) for _ in range(60)})
    out = near_dups.links(spark.createDataFrame([(x,) for x in fps], "fp long"), max_tree=cap).collect()
    label = {x: x for x in fps}
    for _ in fps:
        for e in out:
            label[e.a] = label[e.b] = min(label[e.a], label[e.b])
    want = {x: x for x in fps}
    for _ in fps:
        want = {x: min(want[y] for y in fps if (x ^ y).bit_count() <= 2) for x in fps}
    assert label == want


def test_deduplication_keeps_the_first_of_similar_texts(spark):
    base = prose(300, 30).split()
    texts = [" ".join(base), " ".join(base), " ".join([*base[:150], "other", *base[151:]]), prose(300, 31), " ".join(base[:60]) + " " + prose(240, 32)]
    assert sorted(r.doc_id for r in near_dups.near_duplicate_ids(docs(spark, texts)).collect()) == [1, 2]


def test_seats_go_to_the_highest_quotients():
    r = np.random.default_rng(2)
    for _ in range(200):
        w, seats = [float(x) for x in r.integers(0, 50, r.integers(1, 7))], int(r.integers(0, 40))
        got = source_mix.sainte_lague(w, seats)
        if not sum(w):
            assert got == [0] * len(w)
            continue
        quotients = sorted((-x / (2 * k + 1), i) for i, x in enumerate(w) for k in range(seats) if x)[:seats]
        assert sum(got) == seats
        assert sorted(x / (2 * k + 1) for x, n in zip(w, got) for k in range(n)) == pytest.approx(sorted(-q for q, _ in quotients))


def plain_targets(sizes, weights, share=1.5, most=2.0):
    out, left = [0.0] * len(sizes), share * sum(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * rate > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else weights[i] * rate
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


@pytest.mark.parametrize("n,high,block", [(1, 900, 50), (3, 0, 50), (40, 3000, 50), (400, 60, 50), (300, 5, 1000), (25, 100_000, 1)])
def test_planned_sources_equal_the_plain_plan(spark, n, high, block):
    r = np.random.default_rng(n)
    sizes = [int(x) for x in r.integers(0, high + 1, n) * (r.random(n) > 0.1)]
    names = sorted({f"s{i}\u00e9" for i in range(n - 1)} | {"\U0001f600"} if n > 1 else {"x"})
    names = [*names[: n - 1], None] if n > 1 else names
    totals = spark.createDataFrame(list(zip(names, sizes)), "source string, size long").repartition(4)
    goals, total = source_mix.with_targets(totals)
    want = plain_targets(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(n)])
    seats = round(total / block)
    got = {x.source: x for x in source_mix.with_seats(goals, "target", "place", total, seats).collect()}
    assert [got[x].target for x in names] == pytest.approx(want) and total == pytest.approx(sum(want))
    quota = [got[x].quota for x in names]
    assert sum(quota) == (seats if total else 0)
    plain = source_mix.sainte_lague(want, seats)
    assert sorted(w / (2 * k + 1) for w, q in zip(want, quota) for k in range(q)) == pytest.approx(sorted(w / (2 * k + 1) for w, q in zip(want, plain) for k in range(q)))


def test_targets_and_mix(spark):
    texts = [prose(int(n), 40 + i) for i, n in enumerate(RNG.integers(1, 400, 60))]
    d = docs(spark, texts, [("a", "b", "c", None)[min(3, i % 7)] for i in range(60)])
    rows = source_mix.mix_sources(d).collect()
    again = source_mix.mix_sources(d.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    goals = {r.source: r.target for r in rows}
    sizes = {r.source: r.source_size for r in rows}
    assert sum(goals.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, goal in goals.items():
        assert goal <= 2 * sizes[s] and abs(sum(r.taken for r in rows if r.source == s) - goal) <= 2 * source_mix.BLOCK


def test_pages():
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy now, buy now, buy it now</div><article><h1>Head &amp; line</h1><p>A  long\nparagraph with <b>bold</b> words, and more of them, so that it is content.<br><p>Second.</p><section class='comments'><p>I disagree</p></section></article><footer>&copy; me</footer></body></html>"
    assert html_extract.main_text(page) == "Head & line\nA long paragraph with bold words, and more of them, so that it is content.\nSecond."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p> </p>") == ""
    assert html_extract.main_text("<article><p>cut off text &am") == "cut off text &am"


def test_passages_with_edits_are_found(spark):
    shared = prose(90, 50).split()
    edited = [*shared[:40], "new", "words", *shared[41:70], *shared[71:]]
    texts = [prose(100, 51) + " " + " ".join(shared) + " " + prose(50, 52), prose(70, 53) + " " + " ".join(edited) + " " + prose(80, 54), prose(300, 55)]
    out = passages.shared_passages(docs(spark, texts)).collect()
    assert [(r.doc_id, r.other_id, r.other_start, r.other_end, r.start_word, r.end_word) for r in out] == [(1, 0, 100, 190, 70, 160)]


def test_chains_equal_the_quadratic_version():
    r = np.random.default_rng(9)
    for _ in range(100):
        m = sorted({(int(a), int(b)) for a, b in r.integers(0, 60, (12, 2))})
        best = []
        for i, (p, o) in enumerate(m):
            best.append(passages.SEED_SCORE + max([0.0, *(best[j] - passages.GAP_COST * (p - a + o - b) for j, (a, b) in enumerate(m[:i]) if a < p and b < o)]))
        got = passages.chains(m)
        score = lambda c: len(c) * passages.SEED_SCORE - passages.GAP_COST * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
        assert score(got[0]) == pytest.approx(max(best)) and sorted(x for c in got for x in c) == m


def test_common_equals_dynamic_programming():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(0, 30)), r.integers(0, 5, r.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert passages.common(a, b) == t[-1, -1]


def test_decontamination_finds_copies_and_slightly_changed_ones(spark):
    item = prose(60, 60).split()
    changed = [*item[:30], "changed", *item[31:]]
    texts = [prose(50, 61) + " " + " ".join(item).upper() + ". " + prose(50, 62), prose(20, 63) + " " + " ".join(changed), prose(200, 64), " ".join(item[:30])]
    b = spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")
    out = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, texts), b).collect()}
    assert sorted(out) == [0, 1] and (out[0].start_word, out[0].similarity) == (50, 1.0) and out[1].similarity == pytest.approx(51 / 61, abs=1e-6)


def test_blocks_lose_no_window_within_the_radius_and_the_radius_prunes(spark):
    r = np.random.default_rng(8)
    item = int(r.integers(-(2**63), 2**63))
    rows = []
    for i in range(4000):
        flips = r.choice(64, r.integers(0, 30) if i % 4 == 0 else r.binomial(64, 0.5), replace=False)
        fp = (item ^ sum(1 << int(b) for b in flips)) & (2**64 - 1)
        rows.append((i, 0, 60, 5, fp - 2**64 if fp >= 2**63 else fp, len(flips)))
    windows = spark.createDataFrame(rows, "rid long, item_id int, n int, start int, fp long, bits int")
    items = spark.createDataFrame([(0, 60, item)], "item_id int, n int, fp long")
    kept = {x.rid for x in decontaminate.within_radius(windows.drop("bits"), items).collect()}
    assert kept == {x[0] for x in rows if x[5] <= decontaminate.RADIUS}
    assert len([i for i in kept if i % 4]) < 3000 / 50


def test_counted_sets_weigh_repeats(spark):
    x = [5, 3, 5, 5, 9, 3]
    got = spark.createDataFrame([(x,), ([],)], "x array<long>").select(decontaminate.counted(F.col("x")).alias("y")).collect()
    assert len(set(got[0].y)) == 6 and got[1].y == []
    less = spark.createDataFrame([([3, 5, 5],)], "x array<long>").select(decontaminate.counted(F.col("x")).alias("y")).first().y
    assert set(less) < set(got[0].y)


def test_texts_of_one_word_take_bounded_time(spark):
    began = time.time()
    d = docs(spark, ["word " * 2400, "word " * 600, prose(50, 1)])
    b = spark.createDataFrame([(1, "word " * 800), (2, "word " * 500)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(0, 1): (0, 800, 1.0), (0, 2): (0, 500, 1.0), (1, 2): (0, 500, 1.0)}
    assert time.time() - began < 240


def test_language_profiles():
    grams = language_id.Grams()
    train = {"en": "the cat and the dog with that thing " * 20, "de": "der hund und die katze nicht ein schatz " * 20}
    profiles = {k: {g: i for i, g in enumerate(language_id.ranked(language_id.count_grams(t, grams)))} for k, t in train.items()}
    assert language_id.predict("that dog with the cat", profiles, grams)[0] == "en"
    assert language_id.predict("nicht die katze", profiles, grams)[0] == "de"
    assert language_id.predict("12 34 !", profiles, grams) == ("und", 0.0)


def similar_groups(texts):
    """Ids that aren't the first of their group, by brute force over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(texts))]
        if new == label:
            return [i for i, x in enumerate(label) if x < i]
        label = new


@pytest.mark.parametrize("cell", [1024, 8])
def test_deduplication_equals_all_pairs(spark, cell):
    r = np.random.default_rng(11)
    texts = []
    for f in range(3):
        base = prose(120, 70 + f).split()
        for i in range(20):
            w = list(base)
            for at in r.integers(0, len(w), r.integers(0, 5)):
                w[at] = f"new{i}{at}"
            texts.append(" ".join(w))
    texts += [" ".join(r.permutation(base)) for _ in range(3)] + [texts[0], None, "", "a b a b", "b a"]
    want = similar_groups(texts)
    assert 3 < len(want) < len(texts) - 5
    got = sorted(x.doc_id for x in near_dups.near_duplicate_ids(docs(spark, texts), cell=cell).collect())
    if cell == 1024:
        assert got == want
    else:  # shards are cut and dealt again
        assert set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_a_link_at_the_border_is_found():
    r, found = np.random.default_rng(3), 0
    for _ in range(300):
        a = r.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([a[:160], r.integers(0, 2**63, 20).astype(np.uint64)])
        apart = (near_dups.set_fingerprint(a) ^ near_dups.set_fingerprint(b)) & (2**64 - 1)
        found += bool(set(near_dups.band_keys(a)) & set(near_dups.band_keys(b))) and apart.bit_count() <= near_dups.DEDUP_RADIUS
    assert found >= 297


def test_items_at_the_border_are_found(spark):
    items = [prose(60, 5000 + i).split() for i in range(150)]
    planted = [" ".join([prose(30, 7000 + i), *x[:20], "new", "words", *x[22:], prose(30, 8000 + i)]) for i, x in enumerate(items)]
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(1000, " ".join(items[0]))], "item_id int, text string")
    d = docs(spark, planted)
    out = decontaminate.contaminated(d.union(d.where("doc_id = 1")), b).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == sorted([(i, i) for i in range(150)] + [(0, 1000)])
    assert {r.similarity for r in out} == {round(50 / 62, 6)} and {r.start_word for r in out} == {30}


def test_language_prediction_equals_a_plain_version(spark):
    r = np.random.default_rng(21)
    alphabets = {"xa": "abcdefg", "xb": "cdefghij", "xc": "fghijklmé"}
    rows = [(i, " ".join("".join(r.choice(list(alphabets[x]), r.integers(1, 7))) for _ in range(r.integers(1, 60))) + " ½ 12.", x, "s", None, "", "") for i, x in enumerate(list(alphabets) * 25)]
    rows += [(900, "½ 12 ②", "xa", "s", None, "", ""), (901, None, "xb", "s", None, "", "")]
    d = spark.createDataFrame(rows, SCHEMA)

    def grams(text):
        n = {}
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {w} "
            for size in (1, 2, 3):
                for i in range(len(padded) - size + 1):
                    g = padded[i : i + size]
                    if g.strip() and not (size == 3 and not g[1].strip()):
                        n[g] = n.get(g, 0) + 1
        return n

    top = lambda n: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0].ljust(3, "\0")))][: language_id.PROFILE]
    import zlib

    total = {}
    for i, t, x, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for g, c in grams(t).items():
                total.setdefault(x, {}).setdefault(g, 0)
                total[x][g] += c
    profiles = {x: {g: k for k, g in enumerate(top(n))} for x, n in total.items()}
    learn = d.where("crc32(cast(doc_id as string)) % 5 <> 0")
    for size in (2000, 2):
        got = {y.doc_id: (y.lang_pred, round(y.score, 9)) for y in language_id.predict_languages(d, language_id.learn_profiles(learn), size=size).collect()}
        for i, t, *_ in rows:
            mine = top(grams(t))
            gained = {x: sum(language_id.PROFILE - abs(p[g] - k) for k, g in enumerate(mine) if g in p) for x, p in profiles.items()}
            best = min(gained, key=lambda x: (-gained[x], x))
            assert got[i] == ((best, round(gained[best] / (language_id.PROFILE * len(mine)), 9)) if mine else ("und", 0.0)), i


def test_tokens_are_linear_in_unspaced_text():
    began = time.time()
    assert pii.tokens("a" * 1_000_000) == pii.tokens("漢" * 1_000_000) == [] and len(pii.tokens(("x" * 50 + "1") * 20_000)) == 1
    assert time.time() - began < 2


def test_quoted_candidates_are_judged_by_owners(spark):
    value, mine = "q1W2e3R4t5Y6u7I8o9", "z1X2c3V4b5N6m7Q8w9"
    texts = [f'key = "{value}" and more {i}' for i in range(6)] + [f'key = "{mine}"']
    out = {r.doc_id: r for r in secret_scan.scan_secrets(docs(spark, texts, list("abcdefg"))).collect()}
    assert out[0].spans == "" and out[0].n_example == 1 and out[6].spans == f"quoted:4:{len(texts[6])}"


def test_copies_over_owners_are_marked_as_examples(spark):
    """One owner may hold a value as often as it likes; spread over owners it is an example, marked once for all kinds."""
    mine, shared = "0123456789abcdef0123456789aa", "f123456789abcdef0123456789ff"
    texts = [f'token = "{mine}" {i}' for i in range(6)] + [f'token = "{shared}" {i}' for i in range(4)] + [f'key: "{mine}"', "AKIA" + "Q" * 16]
    owners = ["a"] * 5 + ["b"] + ["a", "b", "c", "c"] + [None, None]
    out = {r.doc_id: r for r in secret_scan.scan_secrets(docs(spark, texts, owners)).collect()}
    assert out[0].spans == "assign:0:37,hex:9:37" and out[0].n_live == 3 and out[5].n_live == 3  # assign, hex and quoted
    assert out[6].spans == "assign:0:37,hex:9:37,example:9:37" and out[6].n_example == 3
    assert out[10].spans == "hex:6:34" and out[11].n_live == 1


def test_redaction_of_overlaps_nulls_and_other_columns(spark):
    rows = [(1, "call +4222222222222 now", "a", 1.5), (2, None, None, None), (3, "", "b", 0.0), (4, "me@example.org me@example.org", "c", 2.0), (None, "no data here", "d", 3.0), (4, "me@example.org me@example.org", "c", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base_sha256 double")
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    got = {(r.doc_id, r.spans): r.text for r in out.collect()}
    assert got[1, "a"] == "call [PHONE] now"  # the card inside it begins later
    assert got[2, None] is None and got[3, "b"] == "" and got[4, "c"] == "[EMAIL] [EMAIL]" and got[None, "d"] == "no data here"
    assert pii.redact(df.where("false")).count() == 0


def test_of_equally_similar_places_the_first_is_told(spark):
    item = prose(30, 980)
    d = docs(spark, [f"{prose(9, 981)} {item} {prose(20, 982)} {item} {prose(5, 983)}"])
    b = spark.createDataFrame([(2, item), (1, item)], "item_id int, text string")
    assert sorted((r.item_id, r.start_word, r.similarity) for r in decontaminate.contaminated(d, b).collect()) == [(1, 9, 1.0), (2, 9, 1.0)]


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    item = prose(60, 900)
    good = [prose(60, 910 + i) for i in range(12)]
    near = good[0].split()
    near[30] = "changed"
    near = [*near, *prose(60, 950).split()]
    texts = [*good, " ".join(near[:60]) + " " + good[1], "too short", prose(30, 960) + " " + item, good[2], good[3] + " mail me@example.org now", " ".join([good[4]] * 2)]
    docs(spark, texts, [("a", "b")[i % 2] for i in range(len(texts))]).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, d, "").collect()}
    assert 13 not in kept and all(i in kept for i in range(12))
    unique = [i for n, i in enumerate(sorted(kept)) if n not in similar_groups([kept[i] for i in sorted(kept)])]
    assert 15 not in unique and 16 not in unique
    clean = [i for i in unique if i != 14]
    sizes = {r.doc_id: r["size"] for r in rows.values()}
    assert set(rows) <= set(clean) and sum(r.taken for r in rows.values()) > sum(len(texts[i].split()) for i in clean)
    assert all(sizes[i] == len(texts[i].split()) for i in rows) and all(r.taken <= 2 * r["size"] for r in rows.values())
    empty = d.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("gap", [40, 60, 100, 150, 250])
def test_two_passages_with_other_words_between_are_both_found(spark, gap):
    one, two = prose(60, 200), prose(60, 201)
    texts = [" ".join([prose(30, s), one, prose(gap, s + 1), two, prose(30, s + 2)]) for s in (210, 220)]
    out = sorted((r.start_word, r.end_word, r.other_start, r.other_end) for r in passages.shared_passages(docs(spark, texts)).collect())
    assert out == [(30, 90, 30, 90), (90 + gap, 150 + gap, 90 + gap, 150 + gap)]


@pytest.mark.parametrize("every,least", [(20, 59), (10, 57), (7, 54)])
def test_passages_with_spread_edits_are_proposed_and_found(every, least):
    r, found = np.random.default_rng(8), 0
    for i in range(60):
        a = r.integers(1, 60_000, 80)
        b = np.where(np.arange(80) % every == every - 1, r.integers(1, 60_000, 80), a)
        sides = [np.concatenate([r.integers(1, 60_000, 100), x, r.integers(1, 60_000, 100)]) for x in (a, b)]
        held = [passages.seeds(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] for x in sides]
        found += len(np.intersect1d(*held)) >= passages.MIN_SEEDS and len(passages.passages_between(*sides)) == 1
    assert found >= least


@pytest.mark.parametrize("words", [55, 60, 80, 120])
def test_passages_with_every_fifth_word_changed_are_found(words):
    """At the limit of 0.8 itself: 0.9 and more of the pairs have two neighbouring seeds and one passage."""
    r, found = np.random.default_rng(words), 0
    for _ in range(400):
        a = r.integers(1, 60_000, words)
        b = np.where(np.arange(words) % 5 == 4, r.integers(1, 60_000, words), a)
        sides = [np.concatenate([r.integers(1, 60_000, 100), x, r.integers(1, 60_000, 100)]) for x in (a, b)]
        (h, p), (g, q) = [passages.seeds(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in sides]
        _, i, j = np.intersect1d(h, g, return_indices=True)
        met = np.array(sorted(zip(p[i], q[j], strict=True))).reshape(-1, 2)
        step = np.diff(met, axis=0)
        near = (step[:, 0] <= passages.NEAR) & (step[:, 1] > 0) & (abs(step[:, 1] - step[:, 0]) <= 1 + passages.SHIFT * step[:, 0])
        found += bool(near.any()) and len(passages.passages_between(*sides)) == 1
    assert found >= 360


def test_the_whole_query_against_all_pairs(spark):
    """Texts with edited passages at rates up to 0.2: nine in ten of the pairs that alignment of all pairs finds are found, and no other."""
    r = np.random.default_rng(4)
    pool = prose(4000, 77).split()
    texts = []
    for i in range(40):
        core = list(r.choice(pool, r.integers(60, 100)))
        for j in range(2):
            rate = [0.0, 0.1, 0.15, 0.18][i % 4] * j
            words = [w if r.random() > rate else str(r.choice(pool)) for w in core]
            texts.append(" ".join([*r.choice(pool, 40), *words, *r.choice(pool, 40)]))
    hashed = [passages.word_hashes(t.encode(), passages.WordHashes()) & np.uint64(0xFFFFFFFF) for t in texts]
    want = {(j, i) for j in range(len(texts)) for i in range(j) if passages.passages_between(hashed[j], hashed[i])}
    got = {(x.doc_id, x.other_id) for x in passages.shared_passages(docs(spark, texts)).collect()}
    assert len(want) >= 30 and got <= want and len(got) >= 0.9 * len(want)


def test_hot_seeds_meet_in_no_window(spark, monkeypatch):
    """A seed that all documents hold: its rows are joined to a broadcast owner beyond a limit."""
    monkeypatch.setattr("heliograph.llm.shared.HOT", 3)
    rows = spark.createDataFrame([(1, d) for d in range(10)] + [(2, 5), (2, 7), (3, 4)], "h long, doc long")
    out = passages.with_owner(rows, "h")
    assert {(x.h, x.doc, x.owner, x.n) for x in out.collect()} == {(1, d, 0, 10) for d in range(10)} | {(2, 5, 5, 2), (2, 7, 5, 2)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_quotations_in_earlier_documents_hide_no_passage(spark):
    shared = prose(60, 300).split()
    quoted = [shared[:24], shared[17:44], shared[37:]]
    texts = [" ".join([prose(40, 301 + i), *q, prose(40, 311 + i)]) for i, q in enumerate(quoted)]
    texts += [" ".join([prose(50, s), *shared, prose(50, s + 1)]) for s in (320, 330)]
    out = passages.shared_passages(docs(spark, texts)).collect()
    assert [(r.doc_id, r.other_id, r.start_word, r.end_word, r.other_start, r.other_end) for r in out] == [(4, 3, 50, 110, 50, 110)]


def test_the_field_looks_at_texts_without_a_base_span(spark):
    r = np.random.default_rng(17)
    number = lambda: f"({r.integers(200, 999)}) {r.integers(200, 999)}-{r.integers(1000, 9999)}"
    train = [prose(12, 400 + i) + f" phone +1 {number()} " + prose(8, 500 + i) + f" in {1900 + i} " + prose(5, 600 + i) for i in range(60)]
    field = pii.train(docs(spark, [train[0]] * 500 + train), n=60)
    text = "please phone (415) 555-2671 today"
    assert not pii.base_spans(text)
    assert [text[a:b] for a, _, _, b in pii.added(text, [], field, pii.Buckets(), 0.5)] == ["(415) 555-2671"]
    nodes = np.zeros((pii.FEATURES, len(pii.LABELS)))
    nodes[pii._bucket("brackets=True"), 4] = 9.0
    k = len(pii.LABELS)
    sure = pii.Field(nodes, np.zeros((k, k)), np.zeros((k, k)))
    assert [r.text for r in pii.redact(docs(spark, [text]), field=sure).select("text").collect()] == ["please phone [PHONE] today"]
    assert [r.spans for r in pii.find_pii(docs(spark, [text]), field=sure).collect()] == ["phone:13:27"]


def test_second_mentions_are_found_and_other_numbers_left_alone(spark):
    """Phone numbers told again in another form; order numbers of the same shape, and card-like numbers that fail the Luhn sum and
    stand twice, stay. Precision and recall are 1 here; 0.9 is asked for."""
    r = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, r.integers(1, 10, n)))
    texts, want = [], []
    for i in range(200):
        area, head, tail = digits(3), digits(3), digits(4)
        again = [f"({area}) {head}-{tail}", f"{area}-{head}-{tail}", f"{area}{head}{tail}"][i % 3]
        no_card = digits(16)
        while pii.luhn(no_card):
            no_card = digits(16)
        texts.append(f"{prose(15, i)} phone +1 {area} {head} {tail} {prose(9, i + 500)} again {again} {prose(5, i + 900)} order {digits(10)} and {no_card} or {no_card} {prose(5, i)}")
        want.append(f"phone:{texts[-1].index(again)}:{texts[-1].index(again) + len(again)}")
    out = {r.doc_id: set(r.spans.split(",")) for r in pii.find_pii(docs(spark, texts)).collect()}
    more = [{x for x in out[i] if x not in pii.said(pii.base_spans(t)).split(",")} for i, t in enumerate(texts)]
    hits = sum(w in m for w, m in zip(want, more, strict=True))
    assert hits >= 0.9 * len(texts) and hits >= 0.9 * sum(map(len, more))
    assert not any(x.startswith("card") for m in more for x in m)


@pytest.mark.parametrize(("token", "kinds"), [("4111111111111111", ["phone"]), ("4111111111111112", ["card", "phone"]), ("10.0.0.256", ["ip", "card"]), ("10.0.0.25", ["card"]), ("+12", ["card", "phone"]), ("a4111", []), ("(030) 123456", ["card"])])
def test_checks_refuse_kinds(token, kinds):
    assert pii.refused(token) == kinds


@pytest.mark.parametrize("piece", ["a1", "a1.", "a@", "1", "+1(", "1."])
def test_long_unspaced_tokens_cost_linear_time(piece):
    text, buckets = piece * (1_000_000 // len(piece)), pii.Buckets()
    began = time.time()
    pii.example(text, buckets)
    assert time.time() - began < 20  # a quadratic cost would be minutes


def test_copies_count_once_in_the_training_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda examples: seen.extend(examples))
    pii.train(docs(spark, [f"call +1 415 555 26{i:02d} now" for i in range(12) for _ in range(9)]), n=12)
    assert len(seen) == 12


def test_a_repeated_line_has_seeds_enough():
    r = np.random.default_rng(12)
    for _ in range(40):
        line = r.integers(1, 2**63, 10).astype(np.uint64)
        sides = [np.concatenate([r.integers(1, 2**63, 30).astype(np.uint64), np.tile(line, 7)]) for _ in range(2)]
        assert len(np.intersect1d(*[passages.seeds(x)[0] for x in sides])) >= passages.MIN_SEEDS


def test_clusters_choose_the_content_of_pages_without_telling_names(monkeypatch):
    links = "".join(f"<li><a href=/{i}>{w}</a></li>" for i, w in enumerate(prose(60, 700).split()))
    body = [prose(60, 701 + i) for i in range(5)]
    page = f"<html><body><div class=x1><ul>{links}</ul></div><div class=x2><h1>{prose(6, 710)}</h1>{''.join(f'<p>{p}</p>' for p in body)}</div><div class=x3><ul>{links}</ul></div></body></html>"
    want = "\n".join([prose(6, 710), *body])
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "threshold", lambda values: float("-inf"))
    assert html_extract.main_text(page) != want


@pytest.mark.parametrize("shape", ["two containers", "in the body", "menu between", "nested"])
def test_clusters_choose_where_no_container_holds_the_content(monkeypatch, shape):
    links = "".join(f"<li><a href=/{i}>{w}</a></li>" for i, w in enumerate(prose(60, 700).split()))
    head, body = prose(6, 710), [prose(60, 701 + i) for i in range(5)]
    p = [f"<p>{x}</p>" for x in body]
    page = {
        "two containers": f"<div><ul>{links}</ul></div><div><h1>{head}</h1>{p[0]}{p[1]}</div><div>{p[2]}{p[3]}{p[4]}</div><div><ul>{links}</ul></div>",
        "in the body": f"<ul>{links}</ul><h1>{head}</h1>{''.join(p)}<ul>{links}</ul>",
        "menu between": f"<h1>{head}</h1>{p[0]}{p[1]}<div><ul>{links}</ul></div>{p[2]}{p[3]}{p[4]}",
        "nested": f"<table><tr><td><ul>{links}</ul></td></tr></table><section><div><h1>{head}</h1>{p[0]}{p[1]}</div></section><section><div>{p[2]}</div><div>{p[3]}{p[4]}</div></section>",
    }[shape]
    page = f"<html><body>{page}</body></html>"
    want = "\n".join([head, *body])
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "threshold", lambda values: float("-inf"))
    assert html_extract.main_text(page) != want


def test_only_tags_are_cut_off_at_the_end():
    assert html_extract.main_text("<p>a <") == "a <" and html_extract.main_text("<p>a < b") == "a < b" and html_extract.main_text("<p>1 </") == "1 </"
    assert html_extract.main_text("<article><p>x <b") == html_extract.main_text("<article><p>x </b") == html_extract.main_text("<article><p>x <!-- y") == "x"


def test_pages_of_one_kind_stay_whole():
    assert html_extract.main_text("<body><p>one<p>two<p>six") == "one\ntwo\nsix"
    assert html_extract.main_text("plain text") == "plain text"


def plain_extract(html):
    """The article of the given pages by regular expressions: no parser, ratios or clusters."""
    import html as entities

    body = re.search(r"<article[^>]*>(.*?)(?:</article>|$)", html, re.S)
    body = re.sub(r"<!--.*?-->|<(script|style|noscript|form|nav|aside|footer)\b.*?</\1>", " ", body[1] if body else "", flags=re.S)
    body = re.sub(r"<(div|section)[^>]*class=[\"']?(?:ad|comments?|notice|sidebar)\b.*?</\1>", "\n", body, flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|li|ul|ol|blockquote|pre|table|tr|td|th|div|section|figure|figcaption)\b[^>]*>", body)
    lines = [" ".join(entities.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"</?(?!br)[a-z][^>]*>", "", b))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_given_pages_equal_a_plain_extraction():
    import pyarrow.parquet as pq
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no given pages here")
    rows = pq.read_table(path, columns=["html"]).column("html").to_pylist()
    wrong = [i for i, x in enumerate(rows) if html_extract.main_text(x) != plain_extract(x)]
    assert len(rows) > 100 and not wrong, (len(wrong), wrong[:5])


def test_only_whole_names_tell():
    p = prose(40, 720)
    for name in ("side-effects", "share-price", "search-results", "skip-count", "related-work", "menu-engineering", "notice-period"):
        assert html_extract.main_text(f"<article><p>{p}</p><div class='{name}'><p>Take it daily.</p></div></article>") == f"{p}\nTake it daily."
    for name in ("ad", "ad-box", "comment-list", "sidebar left", "cookie-notice"):
        assert html_extract.main_text(f"<article><p>{p}</p><div class='{name}'><p>Take it daily.</p></div></article>") == p


def test_unclosed_elements_cost_linear_time():
    began = time.time()
    assert len(html_extract.main_text("<div>word" * 20_000).split("\n")) == 20_000
    assert html_extract.main_text("<div>" * 20_000 + "</p></ul>" * 20_000 + "word") == "word"
    assert time.time() - began < 5


def test_odd_pages(spark):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (3, "u", "<p>a</p>", "c"), (3, "u", "<p>a</p>", "c"), (None, "u", "<p> b\n c &amp; d</p>", "c")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_pages(d).collect()), key=str)
    assert out == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", "a", 1), (3, "u", "a", 1), (None, "u", "b c & d", 7)], key=str)
    assert html_extract.extract_pages(d.where("false")).count() == 0


def test_many_license_matches_of_one_rule_cost_linear_time(spark):
    text = "word under the MIT license, " * 20_000
    at = time.time()
    row = license_scan.scan_licenses(docs(spark, [text])).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (20_000, 1, 5 * 19_999 + 1, "mit") and time.time() - at < 60


def test_passages_leave_no_table_that_nothing_reads_and_runs_are_owned_once(spark, monkeypatch, tmp_path):
    """Words, seeds and runs go; a later round takes only keys of documents with new passages."""
    monkeypatch.setattr("heliograph.llm.shared.shared_root", lambda spark: str(tmp_path))
    shared = prose(60, 300).split()
    texts = [" ".join([prose(40, 301 + i), *q, prose(40, 311 + i)]) for i, q in enumerate([shared[:24], shared[17:44], shared[37:]])]
    texts += [" ".join([prose(50, s), *shared, prose(50, s + 1)]) for s in (320, 330)]
    assert passages.shared_passages(docs(spark, texts)).count() == 1
    assert not {p.name.rsplit("-", 5)[0] for p in tmp_path.iterdir()} & {"words", "shared-seeds", "runs"}
    rows = spark.createDataFrame([(1, d, 10 * d) for d in (3, 4, 9)] + [(2, 5, 1), (2, 7, 2), (3, 4, 8)], "h long, doc long, pos int")
    assert {(x.h, x.doc, x.owner, x.there) for x in passages.with_owner(rows, "h", "pos").collect()} == {(1, d, 3, 30) for d in (3, 4, 9)} | {(2, 5, 5, 1), (2, 7, 5, 1)}
    keys = spark.createDataFrame([(1, 3, 0, 1), (1, 4, 0, 1), (2, 4, 5, 6), (2, 5, 5, 6), (3, 5, 0, 1), (3, 6, 0, 1)], "key long, doc long, p int, q int")
    fresh = spark.createDataFrame([(4, True)], "doc long, fresh boolean")
    assert sorted((x.key, x.doc) for x in passages.touched(keys, fresh).collect()) == [(1, 3), (1, 4), (2, 4), (2, 5)]


def test_pairs_with_a_short_stretch_in_common_are_told_by_one_byte_a_word(spark, monkeypatch):
    """Words of four bytes are sent for likely pairs only, words don't move again, and seeds and runs move once."""
    made, plain = {}, passages.written

    def written(df, name, *by):
        made.setdefault(name, []).append((plain(df, name, *by), df._jdf.queryExecution().executedPlan().toString()))
        return made[name][-1][0]

    monkeypatch.setattr(passages, "written", written)
    monkeypatch.setattr(passages, "discard", lambda *tables: None)
    opening, shared = prose(14, 700), prose(60, 701)
    texts = [opening + " " + prose(80, 710 + i) for i in range(8)] + [prose(40, s) + " " + shared for s in (730, 731)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = passages.shared_passages(docs(spark, texts)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.doc_id, r.other_id, r.start_word, r.end_word) for r in out] == [(9, 8, 40, 100)]
    assert {(r.doc, r.owner) for r in made["pairs"][0][0].collect()} == {(i, 0) for i in range(1, 8)} | {(9, 8)}
    assert [(r.doc, r.owner) for r in made["screened"][0][0].collect()] == [(9, 8)]
    assert made["shared-seeds"][0][1].count("Exchange hashpartitioning") == 1 == made["runs"][0][1].count("Exchange hashpartitioning(group")
    assert "Bucketed: true" in made["screened"][0][1] and "Bucketed: true" in made["passages"][0][1]


def test_keys_by_groups_have_the_owners_that_counting_gives(monkeypatch):
    """Rows beyond CROWD of a batch go to groups by document, and their keys have one row that stands for them."""
    monkeypatch.setattr(passages, "CROWD", 5)
    r, groups, rows, crowd, heads = np.random.default_rng(3), {}, [], [], {}
    for _ in range(6):
        key = np.where(r.random(300) < 0.3, r.integers(0, 3, 300), r.integers(0, 200, 300)).astype(np.uint64) * np.uint64(2**64 // 201)
        key, doc, pos = key.view(np.int64), r.integers(0, 150, 300), r.integers(0, 9, 300).astype(np.int32)
        rows += zip(key.tolist(), doc.tolist(), pos.tolist(), strict=True)
        batch = passages.by_key(7, key, doc, pos=pos)
        for i in range(len(batch)):
            groups.setdefault(batch.column("group")[i].as_py(), []).append(batch.slice(i, 1))
    least, most, got = {}, {}, []
    for k, d, p in rows:
        least[k], most[k] = min(least.get(k, (d, p)), (d, p)), max(most.get(k, d), d)
    for batches in groups.values():
        key, doc, owner, pos, there, head = passages.owned(passages.pa.Table.from_batches(batches), "pos")
        if owner is None:
            crowd += zip(key.tolist(), doc.tolist(), pos.tolist(), strict=True)
            continue
        assert all((o, t) == least[k] for k, o, t in zip(key.tolist(), owner.tolist(), there.tolist(), strict=True))
        got += zip(key.tolist(), doc.tolist(), pos.tolist(), strict=True)
        heads |= dict(zip(key[head].tolist(), owner[head].tolist(), strict=True))
    assert crowd and {k for k, *_ in crowd} <= set(heads) and all(heads[k] == least[k][0] for k in heads)
    assert sorted(got + crowd) == sorted(x for x in rows if least[x[0]][0] < most[x[0]])


def test_passages_that_very_many_documents_share(spark):
    """More holders of a seed and of a run in one batch than go one way."""
    shared, opening = prose(60, 740), prose(14, 741)
    texts = [" ".join([opening, prose(30, 10_000 + i), *[shared] * (i % 2), prose(12, 20_000 + i)]) for i in range(1400)]
    out = passages.shared_passages(docs(spark, texts)).collect()
    assert {(i, 1) for i in range(3, 1400, 2)} <= {(r.doc_id, r.other_id) for r in out}  # some also by a chance word beside it
    assert all(r.doc_id % 2 == r.other_id % 2 == 1 and 43 <= r.start_word <= 44 and 104 <= r.end_word <= 105 for r in out)


def test_lengths_below_a_bound_are_told_early():
    r = np.random.default_rng(5)
    for _ in range(300):
        a, b, least = r.integers(0, 8, r.integers(0, 30)), r.integers(0, 8, r.integers(0, 30)), r.integers(0, 20)
        assert (passages.common(a, b, least) >= least) == (passages.common(a, b) >= least)


def test_a_later_round_joins_the_rows_of_touched_keys_only(spark, monkeypatch):
    """Rows of all keys don't go through a join to learn that most aren't touched; very frequent keys are told once."""
    plans, plain = [], passages.written

    def written(df, name, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *by)

    monkeypatch.setattr(passages, "written", written)
    monkeypatch.setattr("heliograph.llm.shared.HOT", 3)
    rows = [(1, d, 0, 1) for d in range(6)] + [(2, 4, 5, 6), (2, 7, 5, 6), (3, 8, 0, 1), (3, 9, 0, 1)]
    keys = spark.createDataFrame(rows, "key long, doc long, p int, q int")
    fresh = spark.createDataFrame([(4, True)], "doc long, fresh boolean")
    got = passages.touched(keys, fresh)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] < 3)
    assert not [x for plan in plans for x in plan.splitlines() if "Join" in x and "[doc" in x and "LeftOuter" in x]


@pytest.mark.parametrize("kind", ["u1", "<u4"])
def test_texts_compared_together_have_the_places_of_each_alone(kind):
    """Places by a plain version, texts that end or begin with another's words, and one equal stretch without chaining."""
    r = np.random.default_rng(31)
    for _ in range(60):
        other = r.integers(0, 40, r.integers(0, 120)).astype(kind)
        texts = [r.integers(0, 40, r.integers(0, 60)).astype(kind) for _ in range(5)]
        at = int(r.integers(0, max(1, len(other) - 40)))
        texts += [other[at : at + 2], other[at + 2 : at + 4], np.concatenate([texts[0], other[at : at + 30], texts[1]])]
        together = passages.anchors(texts, passages.first_places(other))
        for a, got in zip(texts, together, strict=True):
            first = lambda x: {tuple(x[i : i + 4].tolist()): i for i in range(len(x) - 4, -1, -1)}
            here, there = first(a), first(other)
            want = {(p, there[w]) for w, p in here.items() if w in there}
            ends = {(p, o) for p, o in want if not {(p - 1, o - 1), (p + 1, o + 1)} <= want}
            assert set(got) <= want and ends <= set(got)
            assert passages.passages_between(a, other, got, 10) == passages.passages_between(a, other, None, 10)
    a, b = (np.concatenate([r.integers(*x, 20), np.arange(12), r.integers(*x, 20)]).astype(kind) for x in ((50, 100), (100, 150)))
    assert passages.passages_between(a, b, None, 12) == [(20, 32, 20, 32, 1.0)] and passages.passages_between(a, b, None, 13) == []
