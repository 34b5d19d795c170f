"""SentencePiece encoding and decoding as a shortest path in weighted transducers.

A model is compiled once into three parts: the normaliser (space to the visible space
sign, with the leading one if the model asks for it), the pieces (a trie whose arcs read
characters and emit an id) and the byte fallback (a character that no piece covers is
read once and emits its UTF-8 bytes' ids). Composed with an input they form a lattice
from its start to its end. The encoding is its shortest path: weights add along a path,
the least one wins (the tropical semiring).

The weights depend on the model's kind. In a unigram model a piece costs its negative
score. In a merge (BPE) model all pieces cost nothing, but two pieces may follow each
other only if merging their joint text by the model's ranks gives just these two; any
other neighbourhood costs infinity. Merge results have that property for all neighbours,
and only one path of a text has it, so the path of finite weight is the merge result.

No piece continues over a space sign that follows another character, nor over a character
without a piece; compiling checks the former. So a text's lattice falls apart at these
places, and each distinct stretch is solved once per cache of bounded size.

Defined cases: NULL and empty texts have no tokens; repeated rows give a row each; an
empty table gives an empty result; other columns are ignored. Decoding restores the text,
except that a literal space sign (U+2581) comes back as a space; ``round_trip`` tells.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
# Stretches whose encoding a worker remembers, and neighbour verdicts.
CACHE = 200_000
PAIR_CACHE = 500_000
# Characters of an ending by which pieces are looked up.
TAIL = 4
# Field numbers of the model file.
TRAINER, NORMALIZER = 2, 3
MODEL_TYPE, CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 3, 2, 3, 4, 5
UNIGRAM, MERGES = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A compiled model; it travels as the model file's bytes (see ``compiled``)."""

    def __init__(self, serialized: bytes):
        import sentencepiece

        self.serialized = serialized
        reader = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        spec = dict(_fields(serialized))
        normalizer = dict(_fields(spec.get(NORMALIZER, b"")))
        self.kind = dict(_fields(spec.get(TRAINER, b""))).get(MODEL_TYPE, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        if normalizer.get(CHARSMAP) or normalizer.get(EXTRA_SPACES, 1) or not normalizer.get(ESCAPE_SPACES, 1):
            raise ValueError("only a normaliser that keeps all characters is supported")
        self.prefix = SPACE if normalizer.get(DUMMY_PREFIX, 1) else ""
        self.unknown = reader.unk_id()
        self.weight: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.output: list[bytes] = []
        for i in range(reader.get_piece_size()):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.output.append(bytes([value]))
            elif reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i):
                self.output.append(b"")
            else:
                self.ids[piece] = i
                self.weight[piece] = -reader.get_score(i)
                self.output.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        self.characters = {p for p in self.ids if len(p) == 1}
        self.lengths = [0] * reader.get_piece_size()
        self.texts = [""] * reader.get_piece_size()
        for p, i in self.ids.items():
            self.lengths[i], self.texts[i] = len(p), p
        # Per ending of up to four characters: size and id of the pieces a text with that ending
        # may end on, the longest first. Beyond four characters the id is not known yet (-1).
        longer: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > TAIL:
                longer.setdefault(p[-TAIL:], set()).add(len(p))
        self.endings: dict[str, tuple[tuple[int, int], ...]] = {}
        for end in {p[-k:] for p in self.ids for k in range(1, TAIL + 1)}:
            tails = [(k, self.ids[end[-k:]]) for k in range(len(end), 0, -1) if end[-k:] in self.ids]
            beyond = [(size, -1) for size in sorted(longer.get(end, ()), reverse=True)]
            self.endings[end] = (*beyond, *tails)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece continues over a space")
        newline = "" if any("\n" in p for p in self.ids) else "\n"
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}{newline}]+|{SPACE}+" + (f"|{newline}+" if newline else ""))
        self.solved: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}
        # By left id times the number of pieces, plus right id; left is -1 at the start.
        self.follows: dict[int, bool] = {}

    def __reduce__(self):
        return compiled, (self.serialized,)

    def merged(self, text: str) -> list[str]:
        """The merge result of a short text: the best-ranked neighbours are joined first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                weight = self.weight.get(parts[i] + parts[i + 1])
                if weight is not None and (best is None or weight < best):
                    best, at = weight, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two pieces' joint text merges into just them; left is -1 at the start."""
        key = left * len(self.texts) + right
        verdict = self.follows.get(key)
        if verdict is None:
            if len(self.follows) >= PAIR_CACHE:
                self.follows.clear()
            expected = [self.texts[i] for i in (left, right) if i >= 0]
            verdict = self.follows[key] = self.merged("".join(expected)) == expected
        return verdict

    def _fallback(self, character: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in character.encode("utf-8", "replace")]

    def _path(self, text: str) -> list[int]:
        """Shortest path through the lattice of a text all of whose characters are pieces."""
        last = self._merge_path(text) if self.kind == MERGES else self._cheapest_path(text)
        found, end = [], len(text)
        while end:
            found.append(last[end])
            end -= self.lengths[last[end]]
        return found[::-1]

    def _merge_path(self, text: str) -> list[int]:
        """The last piece of the path to every place: the only one that may follow its start's."""
        last = [-1] * (len(text) + 1)
        follows, ids, endings, count = self.follows, self.ids, self.endings, len(self.texts)
        for end in range(1, len(text) + 1):
            tail = text[max(0, end - TAIL) : end]
            pieces = endings.get(tail)
            while pieces is None:
                tail = tail[1:]
                pieces = endings.get(tail)
            for size, piece in pieces:
                start = end - size
                if piece < 0:
                    if start < 0:
                        continue
                    piece = ids.get(text[start:end], -1)
                    if piece < 0:
                        continue
                verdict = follows.get(last[start] * count + piece)
                if verdict is None:
                    verdict = self.may_follow(last[start], piece)
                if verdict:
                    last[end] = piece
                    break
        return last

    def _cheapest_path(self, text: str) -> list[int]:
        size = len(text)
        cost = [0.0] + [float("inf")] * size
        last = [-1] * (size + 1)
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                weight = self.weight.get(text[start:end])
                if weight is not None and cost[start] + weight < cost[end]:
                    cost[end], last[end] = cost[start] + weight, self.ids[text[start:end]]
        return last

    def stretch_ids(self, text: str) -> tuple[int, ...]:
        known = self.earlier.get(text)
        if known is None:
            ids: list[int] = []
            if self.characters.issuperset(text):
                ids = self._path(text)
            else:
                run = 0
                for i, character in enumerate(text):
                    if character not in self.characters:
                        ids += self._path(text[run:i]) + self._fallback(character)
                        run = i + 1
                ids += self._path(text[run:])
            known = tuple(ids)
        if len(text) <= 64:
            # Two generations: what was used since the last change of cache stays.
            if len(self.solved) >= CACHE:
                self.earlier = dict(self.solved)
                self.solved.clear()
            self.solved[text] = known
        return known

    def encode(self, text: str) -> array:
        out = array("i")
        if text:
            solved = self.solved
            for stretch in self.stretch.findall(self.prefix + text.replace(" ", SPACE)):
                out.extend(solved.get(stretch) or self.stretch_ids(stretch))
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.output.__getitem__, ids))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def compiled(serialized: bytes) -> PieceModel:
    """The process's model of these bytes; a worker keeps it, with its caches, from task to task."""
    return PieceModel(serialized)


@lru_cache(maxsize=4)
def load(path: str = MODEL_PATH) -> PieceModel:
    with open(path, "rb") as file:
        return compiled(file.read())


def encode(docs: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (whether the ids decode to the very text)."""
    model = model or load()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few rows at a time, so that long documents do not gather in memory.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, same = [], []
                for text in part.column("text").to_pylist():
                    ids = model.encode(text or "")
                    found.append(np.frombuffer(ids, np.int32))
                    same.append(model.decode(ids) == (text or ""))
                sizes = np.array([len(x) for x in found], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                        pa.array(sizes),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tokens, f"doc_id {id_type}, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    model = model or load()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"]
            )

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {id_type}, text string")
