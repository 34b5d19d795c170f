"""Language identification as a mixture of languages, inferred per document.

Training counts hashed byte trigrams per language over a bounded sample of labelled
documents. A document is cut into short chunks; a chunk's likelihood under a language is
the product of its trigrams' probabilities. Expectation-maximisation estimates the
proportions of the languages in the document: each chunk shares itself out among the
languages by proportion times likelihood, and the shares average to new proportions.
Languages are then added in order of proportion as long as the likelihood, penalised by
``PENALTY * ln(chunks)`` per language, improves. The prediction is the language with the
largest proportion in the chosen set, and that proportion is the score.

Whole texts are read in steps of bounded size, vectorised over chunks and documents.

Defined cases: NULL text, and text without any letter, is ``und`` with score 0; so is
everything if there is no labelled document to learn from. NULL or repeated ``doc_id``s
give a row each (a NULL id is never learned from, and not held out). An empty table gives
an empty result. Only ``text`` decides a prediction; other columns are kept or ignored,
whatever their names. Equal proportions go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmart.llm.common import ranges, steps, string_bytes

UNKNOWN = "und"
BINS = 1 << 16
CHUNK = 32
# Labelled documents per language that the model is fitted on, those of smallest hash.
SAMPLE_PER_LANGUAGE = 4000
MAX_LANGUAGES = 500
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 3.0
# A trigram's bytes are each in three trigrams; the likelihood counts them once.
OVERLAP = 3.0


def _letters() -> np.ndarray:
    """Lower-cased letters and bytes of non-ASCII characters stay, anything else is a space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for first in (65, 97):
        out[first : first + 26] = np.arange(97, 123)
    return out


LETTERS = _letters()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # languages x (BINS + 1); the last column is for no trigram


def held_out(doc_id: str = "doc_id") -> Column:
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def trigrams(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bin of the trigram at every byte, with spaces behind each document; BINS where only spaces are."""
    x = LETTERS[raw].astype(np.uint32)
    second = np.append(x[1:], np.uint32(32))[: len(x)]
    third = np.append(x[2:], np.full(2, 32, np.uint32))[: len(x)]
    for back in (1, 2):
        last = starts[1:] - starts[0] - back
        last = last[last >= starts[:-1] - starts[0]]
        third[last] = 32
        if back == 1:
            second[last] = 32
    key = (x << np.uint32(16)) | (second << np.uint32(8)) | third
    blank = key == 0x202020
    key = (key * np.uint32(2654435761)) >> np.uint32(16)
    return np.where(blank, BINS, key.astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, starts = string_bytes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for a, b in steps(starts):
            base = starts[a]
            code = trigrams(raw[base : starts[b]], starts[a : b + 1])
            for row in range(a, b):
                own = code[starts[row] - base : starts[row + 1] - base]
                total = counts.setdefault(langs[row], np.zeros(BINS + 1, np.int64))
                total += np.bincount(own, minlength=BINS + 1)
    for lang, total in counts.items():
        used = np.flatnonzero(total[:BINS])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(total[used])],
            names=["lang", "bin", "n"],
        )


def fit(docs: DataFrame, training: Column | None = None, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``sample`` documents per language among the ``training`` rows with a label."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    labelled = labelled.where(~held_out() if training is None else training)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labelled.select("doc_id", "lang")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= sample)
        .select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
        .distinct()
    )
    languages = sorted(r["_lang"] for r in chosen.select("_lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    # At most MAX_LANGUAGES * sample ids.
    rows = labelled.join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))
    ).select("text", "lang")
    counted = (
        rows.mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    )
    table = counted.toArrow()
    counts = np.zeros((len(languages), BINS + 1))
    place = {lang: i for i, lang in enumerate(languages)}
    which = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[which, table.column("bin").to_numpy()] = table.column("n").to_numpy()
    total = counts.sum(axis=1, keepdims=True)
    logs = np.log((counts + SMOOTHING) / (total + SMOOTHING * BINS)) / OVERLAP
    logs[:, BINS] = 0
    return LanguageModel(tuple(languages), logs.astype(np.float32))


def _proportions(
    likelihood: np.ndarray, firsts: np.ndarray, doc: np.ndarray, weight: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages per document, and the documents' log-likelihood."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    chunks = np.add.reduceat(weight, firsts)
    for _ in range(ROUNDS):
        part = likelihood * share[doc]
        part *= (weight / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, firsts, axis=0) / chunks[:, None]
        share = np.maximum(share, 1e-9 * allowed)
    fit_ = np.log((likelihood * share[doc]).sum(axis=1)) * weight
    return share, np.add.reduceat(fit_, firsts)


def mixture(model: LanguageModel, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages for each document; a row of zeros without any trigram."""
    count, n = len(model.languages), len(starts) - 1
    out, known = np.zeros((n, count)), np.zeros(n, bool)
    if not len(raw) or not count:
        return out, known
    code = trigrams(raw, starts)
    lengths = np.diff(starts)
    pieces = (lengths + CHUNK - 1) // CHUNK
    doc = np.repeat(np.arange(n), pieces)
    first = np.repeat(starts[:-1] - starts[0], pieces) + ranges(np.zeros(n, np.int64), pieces) * CHUNK
    weight = np.add.reduceat((code < BINS).astype(np.float64), first)
    logs = np.stack([np.add.reduceat(row[code], first) for row in model.log_probability], axis=1)
    use = weight > 0
    doc, logs, weight = doc[use], logs[use].astype(np.float64), np.ones(int(use.sum()))
    if not len(doc):
        return out, known
    present, firsts, local = np.unique(doc, return_index=True, return_inverse=True)
    known[present] = True
    likelihood = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-30
    everything = np.ones((len(present), count))
    rough, _ = _proportions(likelihood, firsts, local, weight, everything)
    order = np.argsort(-rough, axis=1, kind="stable")
    penalty = PENALTY * np.log(np.add.reduceat(weight, firsts) + 1)
    alone = np.zeros_like(everything)
    alone[np.arange(len(present)), order[:, 0]] = 1
    best = alone.copy()
    best_value = (
        np.add.reduceat(np.log(likelihood[np.arange(len(local)), order[local, 0]]), firsts) - penalty
    )
    growing, allowed = np.arange(len(present)), alone
    for size in range(2, count + 1):
        if not len(growing):
            break
        allowed[growing, order[growing, size - 1]] = 1
        of = np.full(len(present), -1)
        of[growing] = np.arange(len(growing))
        rows = of[local] >= 0
        inner = of[local[rows]]
        share, value = _proportions(
            likelihood[rows], np.unique(inner, return_index=True)[1], inner, weight[rows], allowed[growing]
        )
        value = value - size * penalty[growing]
        better = value > best_value[growing]
        best[growing[better]], best_value[growing[better]] = share[better], value[better]
        growing = growing[better]
    out[present] = best
    return out, known


def _predict(model: LanguageModel, text: pa.Array) -> tuple[list[str], np.ndarray, list[str]]:
    raw, starts = string_bytes(text)
    names = np.array([*model.languages, UNKNOWN], object)
    labels, scores, sets = [], [], []
    for a, b in steps(starts):
        part = raw[starts[a] : starts[b]]
        share, known = mixture(model, part, starts[a : b + 1])
        ascii_letter = (LETTERS[part] >= 97) & (LETTERS[part] <= 122)
        upto = np.concatenate([[0], np.cumsum(ascii_letter)])
        inner = starts[a : b + 1] - starts[a]
        lettered = upto[inner[1:]] > upto[inner[:-1]]
        for row in np.flatnonzero(~lettered & (inner[1:] > inner[:-1])):
            lettered[row] = any(map(str.isalpha, text[a + int(row)].as_py() or ""))
        known &= lettered
        top = share.argmax(axis=1) if len(model.languages) else np.zeros(b - a, np.int64)
        score = np.where(known, share.max(axis=1, initial=0), 0.0)
        labels += list(np.where(known, names[top], UNKNOWN))
        scores.append(score)
        for row in range(b - a):
            found = np.flatnonzero(share[row] > 1e-6) if known[row] else []
            sets.append(",".join(f"{names[k]}:{share[row, k]:.3f}" for k in found))
    return labels, np.clip(np.concatenate(scores or [np.zeros(0)]), 0.0, 1.0), sets


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the chosen set with proportions)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores, sets = _predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(scores), pa.array(sets, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, languages string"
    )


def readable(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language is known, mixtures of known languages included."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, _, _ = _predict(model, batch.column("text"))
            fine = np.array([x != UNKNOWN for x in labels], bool)
            yield batch.filter(pa.array(fine))

    return docs.mapInArrow(keep, docs.schema)
