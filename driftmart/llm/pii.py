"""Personal data in texts: patterns, and a skip-chain conditional random field for consistency.

The base kinds email, ip, card and phone are found by pattern and check. The random field's
tokens are these spans and, besides them, digit groups and address-like strings that no
pattern accepted. Neighbouring tokens share a chain potential. Tokens with the same key (the
last nine digits of a number, an address up to its domain's first dot) share a skip
potential, however far apart: each with its next occurrence, so that edges grow with the
tokens. Base spans are observed; sum-product messages run over the loopy graph until they
settle and label the rest. A token without base span is added if its likeliest label is a
kind and some token of its key has a base span. Thus a phone number that is once written
with its country code is also found where it is not.

Weights are fitted by pseudo-likelihood on a bounded sample of documents; the labels are the
base spans, spread to equal keys.

Every text is read whole. Positions are code points, ends exclusive. No pattern goes back
over what it read, so very long texts take time in proportion.

Defined cases: NULL text is empty; repeated rows give a row each; an empty table gives an
empty result (and default weights); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
SAMPLE = 3000
ROUNDS = 30
CUES = (
    re.compile(r"e-?mail|contact|write|@", re.I),
    re.compile(r"\bip\b|host|server|address", re.I),
    re.compile(r"card|visa|credit|payment", re.I),
    re.compile(r"phone|tel|call|mobile|fax", re.I),
)
CUE_CHARS = 24
NEAR = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]++(?:[().\x20/_-]{1,3}[0-9]++)*+")
_ADDRESS = re.compile(r"[^\s@<>,;:()\"']{1,64}@[^\s@<>,;:()\"']{1,255}")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_INTERESTING = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: all local characters before it, and a domain with a dot after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    if _INTERESTING.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


@dataclass
class Tokens:
    start: list[int]
    end: list[int]
    observed: np.ndarray  # a kind, or -1
    features: np.ndarray  # tokens x FEATURES
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of equal keys
    supported: np.ndarray  # whether a token of the same key is observed


FEATURES = 13


def _features(text: str, start: int, end: int) -> list[float]:
    own = text[start:end]
    digits = sum(c.isdigit() for c in own)
    before = text[max(0, start - CUE_CHARS) : start]
    return [
        1.0,
        float("@" in own),
        float(own.startswith("+")),
        float(own.count(".") == 3),
        float(any(c.isalpha() for c in own)),
        float(7 <= digits <= 8),
        float(9 <= digits <= 11),
        float(12 <= digits <= 19),
        float(digits > 19),
        *[float(bool(cue.search(before))) for cue in CUES],
    ]


def _key(text: str, start: int, end: int) -> str:
    own = text[start:end]
    if "@" in own:
        name, _, domain = own.partition("@")
        return f"{name}@{domain.split('.')[0]}".lower()
    return _NOT_DIGIT.sub("", own)[-9:]


def _known_runs(text: str, start: int, end: int, known: set[str]) -> Iterator[tuple[int, int]]:
    """Runs of digit groups between ``start`` and ``end`` that have a known key, the shortest ones.

    So a number next to others, or behind another's last group, is a token of its own.
    """
    groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, start, end)]
    done = 0
    for j, (_, stop) in enumerate(groups):
        digits = ""
        for i in range(j, done - 1, -1):
            digits = text[groups[i][0] : groups[i][1]] + digits
            if len(digits) >= 7 and digits[-9:] in known:
                yield groups[i][0], stop
                done = j + 1
                break
            if len(digits) >= 9:
                break


def tokens(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    spans = [(a, b, k) for a, k, b in base]
    covered = np.zeros(0)
    if base:
        edges = sorted((a, b) for a, _, b in base)
        starts, ends = [edges[0][0]], [edges[0][1]]
        for a, b in edges[1:]:
            if a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        covered = np.array([starts, ends])

    def free(a: int, b: int) -> bool:
        if not covered.size:
            return True
        i = int(np.searchsorted(covered[0], b)) - 1
        return i < 0 or covered[1][i] <= a

    more: list[tuple[int, int, int]] = []
    known = {_key(text, a, b) for a, _, b in base}
    for m in _NUMBER.finditer(text):
        runs = [(a, b, -1) for a, b in _known_runs(text, m.start(), m.end(), known) if free(a, b)] if known else []
        if runs:
            more += runs
        elif 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 25 and free(m.start(), m.end()):
            more.append((m.start(), m.end(), -1))
    if "@" in text:
        for m in _ADDRESS.finditer(text):
            if free(m.start(), m.end()) and not any(a < m.end() and m.start() < b for a, b, _ in more[-1:]):
                more.append((m.start(), m.end(), -1))
    spans = sorted(spans + more)
    start, end = [s[0] for s in spans], [s[1] for s in spans]
    observed = np.array([s[2] for s in spans], np.int64)
    keys = [_key(text, a, b) for a, b in zip(start, end)]
    last: dict[str, int] = {}
    skip = []
    for i, key in enumerate(keys):
        if key in last:
            skip.append((last[key], i))
        last[key] = i
    seen = {k for k, o in zip(keys, observed) if o >= 0}
    chain = [(i, i + 1) for i in range(len(spans) - 1) if start[i + 1] - end[i] <= NEAR]
    return Tokens(
        start,
        end,
        observed,
        np.array([_features(text, a, b) for a, b in zip(start, end)]).reshape(-1, FEATURES),
        np.array(chain, np.int64).reshape(-1, 2),
        np.array(skip, np.int64).reshape(-1, 2),
        np.array([k in seen for k in keys], bool),
    )


@dataclass(frozen=True)
class Field:
    node: np.ndarray  # FEATURES x LABELS
    chain: np.ndarray  # LABELS x LABELS
    skip: np.ndarray  # LABELS x LABELS


def default_field() -> Field:
    """Where nothing is learned: other by default, and equal keys agree."""
    node = np.zeros((FEATURES, LABELS))
    node[0, OTHER] = 1.0
    return Field(node, np.zeros((LABELS, LABELS)), np.eye(LABELS) * 4.0)


def _normal(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def marginals(field: Field, t: Tokens, rounds: int = ROUNDS) -> np.ndarray:
    """Log marginals of the labels by loopy sum-product messages with damping."""
    theta = t.features @ field.node
    known = t.observed >= 0
    theta[known] = -30.0
    theta[known, t.observed[known]] = 0.0
    pairs = np.concatenate([t.chain, t.skip])
    if not len(pairs):
        return _normal(theta)
    is_skip = np.arange(len(pairs)) >= len(t.chain)
    source = np.concatenate([pairs[:, 0], pairs[:, 1]])
    target = np.concatenate([pairs[:, 1], pairs[:, 0]])
    forward = np.where(is_skip[:, None, None], field.skip, field.chain)
    potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(source), LABELS))
    for _ in range(rounds):
        belief = theta.copy()
        np.add.at(belief, target, message)
        inner = belief[source] - message[back]
        whole = inner[:, :, None] + potential
        top = whole.max(axis=1, keepdims=True)
        fresh = _normal(np.log(np.exp(whole - top).sum(axis=1)) + top[:, 0, :])
        change = np.abs(fresh - message).max()
        message = 0.5 * message + 0.5 * fresh
        if change < 1e-4:
            break
    belief = theta.copy()
    np.add.at(belief, target, message)
    return _normal(belief)


def find(field: Field, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added spans, as (start, kind, end) in order."""
    base = base_spans(text)
    if not base:
        return base, base
    t = tokens(text, base)
    open_ = t.supported & (t.observed < 0)
    if not open_.any():
        return base, base
    label = marginals(field, t).argmax(axis=1)
    added = [(t.start[i], int(label[i]), t.end[i]) for i in np.flatnonzero(open_ & (label != OTHER))]
    return base, sorted(base + added)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per token: feature bits, label, and the labels of its neighbours."""
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column("text").to_pylist():
            if not text or not _INTERESTING.search(text):
                continue
            t = tokens(text, base_spans(text))
            label = np.where(t.observed >= 0, t.observed, OTHER)
            left, right = np.full((2, len(label)), -1)
            for a, b in t.skip:
                if t.observed[b] < 0 and label[a] != OTHER:
                    label[b] = label[a]
            for a, b in t.skip[::-1]:
                if t.observed[a] < 0 and label[b] != OTHER:
                    label[a] = label[b]
            left[t.chain[:, 1]], right[t.chain[:, 0]] = label[t.chain[:, 0]], label[t.chain[:, 1]]
            twin = np.full(len(label), -1)
            twin[t.skip[:, 1]] = label[t.skip[:, 0]]
            twin[t.skip[:, 0]] = label[t.skip[:, 1]]
            bits = (t.features @ (1 << np.arange(FEATURES))).astype(np.int64)
            rows += zip(bits.tolist(), label.tolist(), left.tolist(), right.tolist(), twin.tolist())
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["bits", "label", "before", "after", "twin"]
        )


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = 300) -> Field:
    """Pseudo-likelihood fit on the ``sample`` documents of smallest hash that have a digit or an @."""
    texts = docs.where(F.col("text").rlike("[0-9@]")).select(
        F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")
    )
    # The texts' hashes are ordered, not the texts.
    cut = texts.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    start = default_field()
    if cut is None:
        return start
    rows = (
        texts.where(F.col("h") <= cut)
        .select("text")
        .mapInArrow(_examples, "bits long, label long, before long, after long, twin long")
        .groupBy("bits", "label", "before", "after", "twin")
        .count()
        .toPandas()
    )
    if rows.empty:
        return start
    features = (rows["bits"].to_numpy()[:, None] >> np.arange(FEATURES)) & 1
    label, weight = rows["label"].to_numpy(), rows["count"].to_numpy(float)
    around = [np.eye(LABELS + 1)[rows[c].to_numpy()][:, :LABELS] for c in ("before", "after", "twin")]
    node, chain, skip = start.node.copy(), start.chain.copy(), start.skip.copy()
    truth = np.eye(LABELS)[label]
    weight /= weight.sum()
    for _ in range(steps):
        scores = features @ node + around[0] @ chain + around[1] @ chain.T + around[2] @ skip
        gap = (truth - np.exp(_normal(scores))) * weight[:, None]
        # A weak pull to the start keeps what the sample does not show.
        node += 2.0 * (features.T @ gap - 1e-3 * (node - start.node))
        chain += 2.0 * (around[0].T @ gap + gap.T @ around[1] - 1e-3 * chain)
        pull = around[2].T @ gap
        skip += pull + pull.T - 2e-3 * (skip - start.skip)
    return Field(node, chain, skip)


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, for every row."""
    model = field or fit(docs)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = find(model, text) if text else ([], [])
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in range(OTHER)])
                digests.append(hashlib.sha256(_text_of(base).encode()).hexdigest())
                texts.append(_text_of(every))
            table = np.array(counts, np.int64).reshape(-1, OTHER)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(table[:, k]) for k in range(OTHER)],
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(scanned, f"doc_id {id_type}, {counts}, base_sha256 string, spans string")
