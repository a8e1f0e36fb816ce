"""DuckDB forms of the corpus queries, over the given tables."""

from __future__ import annotations

from heliograph.llm import decontaminate, divergence, hard_negatives, license_scan, line_dedup, quality_rules, secret_scan

_TOKENS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body, {_TOKENS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + {quality_rules.REPEAT_WINDOW - 1}], ' ') AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - {quality_rules.REPEAT_WINDOW - 2})) AS i FROM d WHERE len(w) >= {quality_rules.REPEAT_WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {quality_rules.REPEAT_WINDOW})) AS j FROM twice) GROUP BY rid),
f AS (SELECT d.rid, doc_id, source AS host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
        FROM d LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed,
        100 * n_symbols > {quality_rules.SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {quality_rules.DUP_LINE_PERCENT} * n_lines
        OR word_chars < {quality_rules.WORD_LENGTHS[0]} * n_words OR word_chars > {quality_rules.WORD_LENGTHS[1]} * n_words AS soft_failed FROM f),
h AS (SELECT host, count(*) AS docs, count(*) FILTER (base_failed OR soft_failed) AS failures FROM v GROUP BY host),
p AS (SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v, avg(1 / docs) AS one FROM h),
q AS (SELECT m, CASE WHEN v - m * (1 - m) * one > 1e-9 THEN greatest(m * (1 - m) / (v - m * (1 - m) * one) - 1, 1e-3) ELSE {quality_rules.FLAT_STRENGTH} END AS k FROM p),
e AS (SELECT host, m, k, docs, (failures + m * k) / (docs + k) AS rate FROM h, q),
r AS (SELECT host, rate - m > {quality_rules.HOST_DEVIATIONS} * sqrt(rate * (1 - rate) / (docs + k + 1)) + 1e-9 AS host_rejected FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, host_rejected,
    NOT base_failed AND NOT (host_rejected AND soft_failed) AS kept
FROM v JOIN r ON v.host IS NOT DISTINCT FROM r.host
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op7() -> str:
    rows = ", ".join(f"({i}, {_quoted(a)}, {p}, {_quoted(k)}, {_quoted(r)})" for i, (a, p, k, r) in enumerate(license_scan.RULES))
    ranks = " OR ".join(f"(a.priority = {x} AND b.priority <= {x})" for x in sorted(license_scan.CONFIDENCE))
    conf = "CASE priority " + " ".join(f"WHEN {k} THEN {v}" for k, v in license_scan.CONFIDENCE.items()) + " END"
    return rf"""
WITH rules(rule, label, priority, keyword, pattern) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, ' ' || array_to_string(w, '  ') || ' ' AS spaced FROM d),
hit AS (SELECT rid, rule, label, priority, string_split_regex(spaced, pattern) AS gaps, regexp_extract_all(spaced, pattern) AS alls
        FROM s JOIN rules ON contains(spaced, ' ' || keyword || ' ') AND regexp_matches(spaced, pattern)),
pos AS (SELECT rid, rule, label, priority, (length(array_to_string(gaps[1:i], '')) - length(replace(array_to_string(gaps[1:i], ''), ' ', ''))
            + length(array_to_string(alls[1:i - 1], '')) - length(replace(array_to_string(alls[1:i - 1], ''), ' ', ''))) // 2 AS first,
        (length(alls[i]) - length(replace(alls[i], ' ', ''))) // 2 AS n
        FROM (SELECT *, unnest(range(1, len(alls) + 1)) AS i FROM hit)),
det AS (SELECT *, first + n AS stop, rule < {len(license_scan.BASE)} AS base, row_number() OVER (PARTITION BY rid ORDER BY first, first + n DESC, priority, label, rule) AS o FROM pos),
stay AS (SELECT *, base OR NOT EXISTS (SELECT 1 FROM det b WHERE b.rid = a.rid AND b.o < a.o AND b.stop >= a.stop AND ({ranks})) AS shown FROM det a),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (shown) AS labels,
        max({conf}) FILTER (shown) AS score FROM stay GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (rid)
"""


def _op10() -> str:
    parts, n = [], len(secret_scan.BASE)
    for i, (kind, pattern, group, least) in enumerate(secret_scan.KINDS):
        value = f"regexp_extract_all(body, {_quoted(pattern)}, {group})" if group else f"regexp_extract_all(body, {_quoted(pattern)})"
        parts.append(f"SELECT rid, {i} AS ord, '{kind}' AS kind, {least} AS least, {secret_scan.TAILS.get(kind, 0)} AS tail, string_split_regex(body, {_quoted(pattern)}) AS gaps, regexp_extract_all(body, {_quoted(pattern)}) AS alls, {value} AS vals FROM d")
    counts = ", ".join(f"count(*) FILTER (ord = {i}) AS n_{k[0]}" for i, k in enumerate(secret_scan.BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents),
hit AS ({' UNION ALL '.join(parts)}),
each AS (SELECT *, unnest(range(1, len(alls) + 1)) AS i FROM hit),
span AS (SELECT rid, ord, kind, tail, length(array_to_string(gaps[1:i], '')) + length(array_to_string(alls[1:i - 1], '')) AS a, length(alls[i]) AS n, length(vals[i]) AS v, sha256(vals[i]) AS hash FROM each WHERE length(vals[i]) >= least),
held AS (SELECT hash, source, count(DISTINCT doc_id) AS n FROM span JOIN d USING (rid) WHERE doc_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
copied AS (SELECT hash FROM held GROUP BY hash HAVING 100 * max(n) <= {secret_scan.OWN_PERCENT} * sum(n)),
judged AS (SELECT span.*, span.hash NOT IN (SELECT hash FROM copied) AS live FROM span),
said AS (SELECT rid, ord, a, kind || ':' || a || ':' || (a + n) AS what, ord < {n} AS base FROM judged s
    WHERE ord < {n} OR (live AND NOT EXISTS (SELECT 1 FROM span b WHERE b.rid = s.rid AND b.ord < {n} AND b.a < s.a + s.n AND s.a < b.a + b.n))
    UNION ALL SELECT DISTINCT rid, {len(secret_scan.KINDS)}, a + n - tail - v, 'example:' || (a + n - tail - v) || ':' || (a + n - tail), false FROM judged WHERE NOT live AND ord < {n}),
g AS (SELECT rid, string_agg(what, ',' ORDER BY a, ord) FILTER (base) AS base, string_agg(what, ',' ORDER BY a, ord) AS spans FROM said GROUP BY rid),
c AS (SELECT rid, {counts}, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM judged GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k[0]}, 0) AS n_{k[0]}' for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid) LEFT JOIN c USING (rid)
"""


_PLAIN = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

#: Every window that lines up with an item on a shared shingle is compared with it, without fingerprints or key shingles.
OP8 = f"""
WITH i0 AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), {decontaminate.SHINGLE}) AS k FROM i0 WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, o, array_to_string(w[o:o + k - 1], ' ') AS h FROM (SELECT *, unnest(range(1, n - k + 2)) AS o FROM i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS w FROM documents),
dsh AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS h FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
c AS (SELECT DISTINCT rid, item_id, ish.n, ish.k, p - o AS s FROM dsh JOIN ish USING (k, h)),
c2 AS (SELECT DISTINCT rid, item_id, c.n, c.k, greatest(0, least(s, len(w) - c.n)) AS s, least(c.n, len(w)) AS m FROM c JOIN d USING (rid)),
wsh AS (SELECT rid, item_id, c2.n, c2.k, c2.s, h, count(*) AS q FROM c2 JOIN dsh USING (rid, k) WHERE p > c2.s AND p + c2.k - 1 <= c2.s + m GROUP BY ALL),
isum AS (SELECT item_id, n, k, h, count(*) AS q FROM ish GROUP BY ALL),
both_ AS (SELECT rid, item_id, w.n, w.s, sum(least(w.q, i.q)) AS b FROM wsh w JOIN isum i USING (item_id, n, k, h) GROUP BY ALL),
wt AS (SELECT rid, item_id, n, s, sum(q) AS t FROM wsh GROUP BY ALL), it AS (SELECT item_id, n, sum(q) AS t FROM isum GROUP BY ALL),
sim AS (SELECT doc_id, item_id, both_.s AS start_word, both_.n AS n_words, b / (wt.t + it.t - b) AS similarity FROM both_ JOIN wt USING (rid, item_id, n, s) JOIN it USING (item_id, n) JOIN d USING (rid))
SELECT doc_id, item_id, first(start_word ORDER BY similarity DESC, start_word)::BIGINT AS start_word, first(n_words ORDER BY similarity DESC, start_word)::BIGINT AS n_words, round(max(similarity), 6) AS similarity
FROM sim WHERE similarity >= {decontaminate.SIMILARITY} GROUP BY doc_id, item_id
"""


_BLANKS = "' ' || " + " || ".join(f"chr({ord(c)})" for c in line_dedup.BLANKS[1:])

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT rid, i, x[i] AS line, trim(translate(x[i], '{line_dedup.UPPER}', '{line_dedup.LOWER}'), {_BLANKS}) AS key FROM (SELECT rid, x, unnest(range(1, len(x) + 1)) AS i FROM d)),
common AS (SELECT key FROM l WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT rid) >= {line_dedup.MIN_DOCS}),
m AS (SELECT rid, i, line, common.key IS NOT NULL AS gone FROM l LEFT JOIN common USING (key)),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g USING (rid)
"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS body FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + ({divergence.SCALE}::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + ({divergence.SCALE}::HUGEINT * (sum(c) + 2)) // (any_value(total) + 2 * any_value(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY 1) USING (lang) GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

OP13 = f"""
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor, id AS positive, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {hard_negatives.POSITIVES}),
n AS (SELECT anchor, positive, ps, id, score, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, id) AS rank FROM p JOIN s USING (anchor) WHERE NOT same AND {hard_negatives.LOW} * ps <= 100 * score AND 100 * score <= {hard_negatives.HIGH} * ps)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= {hard_negatives.NEGATIVES}
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op7_license_scan": _op7(), "op8_decontaminate": OP8, "op10_secret_scan": _op10(), "op11_line_dedup": OP11, "op12_divergence_audit": OP12, "op13_hard_negatives": OP13}
