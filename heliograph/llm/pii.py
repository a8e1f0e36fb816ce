"""Personal data with patterns and a skip-chain conditional random field.

Base kinds are fixed patterns. The field labels the tokens of a document that could hold personal data: node potentials come
from a token's shape and its neighbours' words, chain potentials tie consecutive tokens, and skip potentials tie tokens that
are repeated or alike however far apart; loopy message passing makes labels agree over the whole document. It adds spans that
no pattern gives, such as a number's second mention in another form. It is trained here, piecewise: a softmax for nodes and log
odds of label pairs for edges, on a bounded sample of documents labelled by the patterns.

Defined results: a null text is empty; documents without a candidate token get their base spans only; without any labelled
document nothing is added; repeated rows are read each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.shared import map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents in the training sample, those with the lowest hash of their text.
TRAIN_DOCS = 400
#: Longer texts aren't drawn for training.
TRAIN_CHARS = 50_000
#: An added span needs this probability.
SURE = 0.9
ROUNDS = 8
FEATURES = 512

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A candidate token: a run without spaces that has a digit or an at sign, and numbers that spaces or brackets group.
_CANDIDATE = re.compile(r"(\+?\(?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)*+|[^\s@0-9]*+[@0-9]\S*+)|\S++")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[^0-9]+")
_NOT_NUMBER = re.compile(r"[^0-9 ().+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, order of kind, kind, end)`` of the base kinds, sorted; code points, ends exclusive."""
    out = []
    done = 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, 0, "email", m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    return out


def said(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def tokens(text: str) -> list[tuple[int, int]]:
    """Candidate tokens, without punctuation around them."""
    out = []
    for m in _CANDIDATE.finditer(text):
        if m.lastindex is None:  # the rest of a run without digit or at sign
            continue
        a, b = m.span()
        while b > a and text[b - 1] in ".,;:!?)\"'":
            b -= 1
        while a < b and text[a] in ",;:!?\"'.":
            a += 1
        if a < b:
            out.append((a, b))
    return out


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


class Buckets(dict):
    def __missing__(self, name: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[name] = out = _bucket(name)
        return out


def _ends_like_a_host(t: str) -> bool:
    host, dot, last = t.rpartition(".")
    return bool(dot and len(last) > 1 and last.isascii() and last.isalpha() and host[-1:].isascii() and (host[-1:].isalnum() or host[-1:] == "-"))


def refused(t: str) -> list[str]:
    """The kinds whose fixed checks a token has failed that has their form: card numbers by length and Luhn sum, addresses by their
    parts, and phone numbers by length."""
    out = []
    parts = t.split(".", 4)
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in parts):
        out.append("ip")
    if t.isascii() and not _NOT_NUMBER.search(t):
        digits = _DIGITS.sub("", t)
        if not 12 <= len(digits) <= 19 or not luhn(digits):
            out.append("card")
        if not 9 <= len(digits) <= 15 and (t[0] == "+" or len(digits) > 15):
            out.append("phone")
    return out


def node_features(text: str, spans: list[tuple[int, int]], buckets: dict[str, int]) -> list[list[int]]:
    """Hashed features of each token: its shape, its parts, and the words beside it."""
    out = []
    for a, b in spans:
        t = text[a:b]
        digits = sum(ch.isdigit() for ch in t)
        letters = sum(ch.isalpha() for ch in t)
        names = [
            "bias",
            f"digits={min(digits, 20)}",
            f"letters={min(letters, 3)}",
            f"dots={min(t.count('.'), 4)}",
            f"dashes={min(t.count('-'), 4)}",
            f"at={'@' in t}",
            f"plus={t[0] == '+'}",
            f"brackets={'(' in t}",
            f"spaces={min(t.count(' '), 4)}",
            f"domain={_ends_like_a_host(t)}",
            *[f"refused={kind}" for kind in refused(t)],
        ]
        near = _WORD.findall(text[max(0, a - 24) : a])
        names.append(f"before={near[-1].lower() if near else ''}")
        out.append([buckets[n] for n in names])
    return out


def keys(text: str, span: tuple[int, int]) -> list[str]:
    """What makes two tokens alike: the same text without case, or the same last digits of a number, or the same host."""
    t = text[span[0] : span[1]].lower()
    out = ["=" + t]
    digits = _DIGITS.sub("", t)
    if len(digits) >= 7 and not any(ch.isalpha() for ch in t):
        out.append("#" + digits[-7:])
    if "@" in t:
        out.append("@" + t.rpartition("@")[2])
    return out


def links(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges; a skip edge goes to the last token before that is alike, so edges are linear in tokens."""
    chain = [(i, i + 1) for i in range(len(spans) - 1)]
    last: dict[str, int] = {}
    skip = set()
    for i, span in enumerate(spans):
        for k in keys(text, span):
            if k in last:
                skip.add((last[k], i))
            last[k] = i
    return chain, sorted(skip)


def label_of(spans: list[tuple[int, int]], base: list[tuple[int, int, str, int]]) -> list[int]:
    """The kind that covers most of a token, if it covers half of it; ties go to the kind listed first."""
    ends = [b for _, b in spans]
    best = [((b - a) / 2, 0) for a, b in spans]
    for s, order, _, e in sorted(base, key=lambda x: x[1]):
        i = bisect_right(ends, s)
        while i < len(spans) and spans[i][0] < e:
            size = min(e, spans[i][1]) - max(s, spans[i][0])
            if size > best[i][0] or size == best[i][0] and not best[i][1]:
                best[i] = (size, order + 1)
            i += 1
    return [label for _, label in best]


class Field:
    """Weights of the field."""

    def __init__(self, nodes: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.nodes, self.chain, self.skip = nodes, chain, skip

    def marginals(self, features: list[list[int]], chain: list[tuple[int, int]], skip: list[tuple[int, int]], barred: list[tuple[int, int]] = ()) -> np.ndarray:
        """Loopy sum-product over all edges at once, damped; ``barred`` are tokens and labels that can't meet."""
        k = len(LABELS)
        local = np.stack([self.nodes[f].sum(axis=0) for f in features])
        for i, label in barred:
            local[i, label] = -1e3
        if not chain and not skip:
            return _softmax(local)
        edges = np.array(chain + skip)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), k, k)), np.broadcast_to(self.skip, (len(skip), k, k))])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), k))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, messages)
            sent = belief[source] - messages[back]
            high = sent.max(axis=1, keepdims=True)
            new = np.log(np.einsum("ea,eab->eb", np.exp(sent - high), np.exp(pair)) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
        belief = local.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Weight of the prior in a table of label pairs, in pairs, and the largest log odds: neighbours tell little, alike tokens much.
CHAIN_PRIOR, CHAIN_MOST = 20.0, 2.0
SKIP_PRIOR, SKIP_MOST = 0.5, 10.0


def fit(examples: list[tuple], steps: int = 300) -> Field | None:
    """Piecewise training on what ``example`` gives; None without any token that has a kind."""
    rows = [f for x in examples for f, y in zip(x[0], x[1], strict=True) if y >= 0]
    labels = np.array([y for x in examples for y in x[1] if y >= 0], dtype=int)
    if not (labels > 0).any():
        return None
    k = len(LABELS)
    dense = np.zeros((len(rows), FEATURES))
    for i, f in enumerate(rows):
        np.add.at(dense[i], f, 1.0)
    want = np.eye(k)[labels]
    weights = np.zeros((FEATURES, k))
    for _ in range(steps):
        grad = dense.T @ (_softmax(dense @ weights) - want) / len(rows) + 1e-4 * weights
        weights -= 1.0 * grad
    freq = (np.bincount(labels, minlength=k) + 1.0) / (len(labels) + k)

    def odds(which: int, weight: float, most: float) -> np.ndarray:
        both = np.zeros((k, k))
        total = 0
        for x in examples:
            for a, b in x[which]:
                both[x[4][a], x[4][b]] += 1
                both[x[4][b], x[4][a]] += 1
                total += 2
        prior = np.outer(freq, freq)
        return np.clip(np.log((both + weight * prior) / (total + weight) / prior), -most, most)

    return Field(weights, odds(2, CHAIN_PRIOR, CHAIN_MOST), odds(3, SKIP_PRIOR, SKIP_MOST))


def example(text: str, buckets: dict[str, int]) -> tuple:
    """Features, labels, chain and skip edges, and supposed labels of a text's tokens.

    A token that no pattern takes but that is alike to one with a kind isn't known not to be of it (its label is -1), unless that
    kind is refused for it; it is supposed to be of that kind.
    """
    spans = tokens(text)
    known = label_of(spans, base_spans(text))
    chain, skip = links(text, spans)
    barred = [[LABELS.index(kind) for kind in refused(text[a:b])] for a, b in spans]
    supposed = list(known)
    for edges in (skip, [(j, i) for i, j in reversed(skip)]):
        for i, j in edges:
            if supposed[i] > 0 and supposed[j] == 0 and supposed[i] not in barred[j]:
                supposed[j] = supposed[i]
    labels = [y if y == z else -1 for y, z in zip(known, supposed, strict=True)]
    return node_features(text, spans, buckets), labels, chain, skip, supposed


def added(text: str, base: list[tuple[int, int, str, int]], field: Field | None, buckets: dict[str, int], sure: float = SURE) -> list[tuple[int, int, str, int]]:
    """Spans that the field finds and that touch no base span."""
    if field is None:
        return []
    spans = tokens(text)
    if not spans:
        return []
    barred = [(i, LABELS.index(kind)) for i, (a, b) in enumerate(spans) for kind in refused(text[a:b])]
    chance = field.marginals(node_features(text, spans, buckets), *links(text, spans), barred)
    best = chance.argmax(axis=1)
    out, j = [], 0
    edges = sorted((a, e) for a, _, _, e in base)
    reach = np.maximum.accumulate([e for _, e in edges]) if edges else []
    starts = [a for a, _ in edges]
    for i, (a, b) in enumerate(spans):
        if best[i] and chance[i, best[i]] >= sure:
            while j < len(starts) and starts[j] < b:
                j += 1
            if j == 0 or reach[j - 1] <= a:
                kind = int(best[i]) - 1
                out.append((a, kind, KINDS[kind], b))
    return out


#: One look that every text with a base span passes.
GATE = r"@[A-Za-z0-9]|[0-9]\.[0-9]|\+[0-9]|[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"


def train(docs: DataFrame, text: str = "text", n: int = TRAIN_DOCS) -> Field | None:
    """Fit on the ``n`` distinct texts with the lowest hash among those that have a candidate and aren't too long.

    Tasks send hashes only; the texts below the ``n``-th are read afterwards, copies once.
    """
    fits = (F.length("t") <= TRAIN_CHARS) & F.col("t").rlike(GATE)
    rows = docs.select(F.col(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    low = [r["h"] for r in rows.where(fits).select("h").distinct().orderBy("h").limit(n).collect()]
    if not low:
        return None
    chosen = rows.where((F.col("h") <= low[-1]) & F.col("h").isin(low) & fits).groupBy("h").agg(F.min("t").alias("t")).collect()
    buckets = Buckets()
    return fit([example(t, buckets) for t in sorted(r["t"] for r in chosen)])


def find_pii(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", field: Field | None = None) -> DataFrame:
    """``carry``, counts by base kind, ``base_sha256`` and ``spans`` (base and added) for each document."""
    field = field or train(docs, text)

    def make():
        buckets = Buckets()

        def work(texts: list) -> list[tuple]:
            out = []
            for t in texts:
                base = base_spans(t or "")
                counts = defaultdict(int)
                for s in base:
                    counts[s[2]] += 1
                spans = sorted(base + added(t or "", base, field, buckets))
                out.append((*[counts[k] for k in KINDS], hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
            return out

        return work

    fields = {f"n_{k}": pa.int64() for k in KINDS} | {"base_sha256": pa.string(), "spans": pa.string()}
    return map_texts(docs, carry, text, make, fields, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become the first's. Null texts stay null."""
    field = field or train(docs, text)
    carry = tuple(c for c in docs.columns if c != text)

    def make():
        buckets = Buckets()

        def clean(t: str | None) -> tuple[str | None]:
            if not t:
                return (t,)
            base = base_spans(t)
            out, done = [], 0
            for a, _, kind, b in sorted(base + added(t, base, field, buckets)):
                if a < done:
                    if b > done:
                        done = b
                    continue
                out += [t[done:a], f"[{kind.upper()}]"]
                done = b
            return ("".join(out) + t[done:],)

        return lambda texts: [clean(t) for t in texts]

    return map_texts(docs, carry, text, make, {text: pa.string()}, f"`{text}` string").select(*docs.columns)
