"""Packing documents into sequences of a fixed length by patterns.

1. One pass turns every document into token ids, ends it with the separator and cuts what is
   longer than a sequence into whole sequences, the remainder first. The pieces are saved
   with their place among the pieces of their length in the task that made them.
2. Only the histogram of lengths, one number per possible length, comes to the driver. There
   patterns of few documents that fill a sequence are enumerated on a coarse grid of lengths;
   non-negative least squares fits how often each repeats, in tokens left over per grid cell;
   the repeats are rounded and carried out with lengths that fill a sequence to the last token.
   What is left is packed by best fit, longest first, for all equal sequences at once. The plan
   is a list of runs of equal sequences; their number depends on the sequence length, not on
   the number of documents.
3. Places become numbers among all pieces of a length by sums over tasks, and a piece's number
   gives its sequence and offset in the plan. Token ids are not shuffled for that unless there
   are more tasks than ``MOST_TASKS``.

Ids are those of the ``tokenizers`` library; strings of special tokens in a text are ordinary
text. Texts are split where the vocabulary's own splitting always ends a word, so a distinct
part is tokenised once as long as a worker remembers it; texts of any length are worked on in
parts, except for a single word without spaces.

Style: Arrow batches for the tokens and for looking up the plan, DataFrame jobs for the rest.

Defined cases: NULL text is empty; an empty text is its separator alone, one piece of length
1; repeated rows and ids are documents of their own; NULL ``doc_id`` stays NULL; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmart.llm.common import saved

LENGTH = 2048
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"
# Cells of the grid on which patterns are fitted, and documents of a pattern at most.
CELLS = 128
DOCUMENTS = 3
# Text parts a worker remembers, twice; longer ones are not remembered.
REMEMBERED = 320_000
LONG_PART = 100
# Characters of a long text that are encoded together, ids of pieces that leave a task together.
STEP_CHARS = 1 << 20
STEP_IDS = 1 << 20
# Tasks up to which their offsets, one number per length, are broadcast: 64 MB.
MOST_TASKS = 4_096

# A plain part is a word of Latin letters with the space before it, which is one word to the
# vocabulary, too, unless other letters follow. All other parts end before ASCII white space that
# follows something else; rarer white space stays inside, as libraries differ on what counts.
_PART = re.compile(
    r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]++(?![^\x00-\x7F])"
    r"|\s*\S+(?:[^\S \t-\r]\s*\S*)*|\s+"
)
_LATIN_END = "\u024f"
_UNSIGNED = "I"  # four bytes
_SPLIT = re.compile(r"(?<=\S)[ \t-\r]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder(dict):
    """Texts to little-endian 32-bit ids; a dictionary of the ids of the parts seen last.

    A plain part is one word to the vocabulary, so the library's model encodes it directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # The character that stands for each byte, as the library's own splitter writes it.
        one = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = "".join(map(chr, range(256)))
        written = one.pre_tokenize_str(letters)[0][0]
        self.symbol = {ord("\u0120"): "\u0120"}
        place = 0
        for code, letter in enumerate(letters):
            raw = letter.encode()
            for byte, symbol in zip(raw, written[place : place + len(raw)]):
                self.symbol[byte] = symbol
            place += len(raw)

    def _tokenise(self, part: str) -> bytes:
        word = part[1:] if part[0] == " " else part
        if word.isalpha() and max(word) <= _LATIN_END:
            if part.isascii():
                symbols = part.replace(" ", self.symbol[32])  # ASCII letters stand for themselves
            else:
                symbols = part.encode().decode("latin-1").translate(self.symbol)
            ids = [x.id for x in self.model.tokenize(symbols)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return array(_UNSIGNED, ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self._tokenise(part)
        if len(part) <= LONG_PART:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join([b"".join(map(self.__getitem__, _PART.findall(part))) for part in cut_text(text)])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_text(text: str) -> list[str]:
    """A long text in parts of about ``STEP_CHARS``, cut where the encoder splits anyway."""
    out, begin = [], 0
    while len(text) - begin > STEP_CHARS:
        place = _SPLIT.search(text, begin + STEP_CHARS)
        if place is None:
            break
        out.append(text[begin : place.start()])
        begin = place.start()
    return [*out, text[begin:]]


def token_pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (binary), and where it was made: task, place."""
    path = tokenizer or default_tokenizer()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids binary, task int, place long"
    separator = np.array([SEPARATOR], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids", "task", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        made = np.zeros(length + 1, np.int64)
        for batch in batches:
            rows: list[tuple[int, int, int, int, bytes, int]] = []
            held = 0

            def batch_of() -> pa.RecordBatch:
                row, piece, start, size, ids, place = zip(*rows)
                which = pa.array(row, pa.int64())
                columns = [
                    batch.column("doc_id").take(which),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(ids, pa.binary()),
                    batch.column("task").take(which),
                    pa.array(place, pa.int64()),
                ]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for row, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py() or "") + separator
                total = len(ids) // 4
                size, start, piece = total % length or length, 0, 0
                while start < total:
                    rows.append((row, piece, start, size, ids[4 * start : 4 * (start + size)], int(made[size])))
                    made[size] += 1
                    start, piece, size = start + size, piece + 1, length
                held += total
                if held >= STEP_IDS:
                    yield batch_of()
                    rows.clear()
                    held = 0
            if rows:
                yield batch_of()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("task"))
    return rows.mapInArrow(cut, schema)


# ---- the plan ------------------------------------------------------------------


def patterns(cells: int = CELLS, documents: int = DOCUMENTS) -> list[tuple[int, ...]]:
    """All ways to write ``cells`` as a sum of at most ``documents`` positive numbers, largest first."""

    def parts(total: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
        elif left:
            for first in range(min(total, most), -(-total // left) - 1, -1):
                for rest in parts(total - first, first, left - 1):
                    yield (first, *rest)

    return list(parts(cells, cells, documents))


def nonnegative_least_squares(matrix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The x >= 0 of least |matrix x - wanted|, by an active set of columns (normal equations)."""
    rows, columns = matrix.shape
    x = np.zeros(columns)
    scale = float(np.abs(wanted).max(initial=0)) or 1.0
    products, target = matrix.T @ matrix, matrix.T @ (wanted / scale)
    passive = np.zeros(columns, bool)
    for _ in range(4 * rows):
        gradient = target - products @ x
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-9:
            break
        passive[best] = True
        while passive.any():
            chosen = np.flatnonzero(passive)
            own = products[np.ix_(chosen, chosen)] + np.eye(len(chosen)) * 1e-12
            solution = np.linalg.solve(own, target[chosen])
            low = solution <= 1e-12
            if not low.any():
                x[:] = 0
                x[chosen] = solution
                break
            # Go towards the solution until the first of the columns in use is at zero.
            now = x[chosen]
            step = float((now[low] / (now[low] - solution[low] + 1e-300)).min())
            x[chosen] = np.maximum(now + min(max(step, 0.0), 1.0) * (solution - now), 0)
            gone = chosen[low & (x[chosen] <= 1e-12)]
            gone = gone if len(gone) else chosen[low][:1]
            x[gone], passive[gone] = 0, False
    return x * scale


@dataclass
class Run:
    """``count`` equal sequences: (length, how many) in order, and the room left in each."""

    count: int
    content: tuple[tuple[int, int], ...]
    room: int


def _fitted_runs(left: np.ndarray, length: int, cells: int, documents: int) -> list[Run]:
    """Sequences after the fitted patterns; takes their pieces from ``left``."""
    cells = min(cells, length)
    cell_of = -(-np.arange(length + 1) * cells // length)
    pieces = np.bincount(cell_of, weights=left, minlength=cells + 1)[1:]
    candidates = patterns(cells, documents)
    matrix = np.zeros((cells, len(candidates)))
    for j, pattern in enumerate(candidates):
        for cell in pattern:
            matrix[cell - 1, j] += 1
    tokens = np.arange(1, cells + 1) / cells  # a long piece left over costs more than a short one
    repeats = np.rint(nonnegative_least_squares(matrix * tokens[:, None], pieces * tokens)).astype(np.int64)
    last_of = np.flatnonzero(np.append(cell_of[1:] != cell_of[:-1], True))

    def exact(pattern: tuple[int, ...]) -> tuple[int, ...] | None:
        """Lengths in the pattern's cells that fill a sequence: the longest, but the last two by search."""
        taken: list[int] = []

        def has(size: int) -> bool:
            return left[size] > taken.count(size)

        for cell in pattern[:-2]:
            size = next((x for x in range(last_of[cell], last_of[cell - 1], -1) if has(x)), 0)
            if not size:
                return None
            taken.append(size)
        room = length - sum(taken)
        if len(pattern) == 1:
            return (room,) if has(room) else None
        for size in range(last_of[pattern[-2]], last_of[pattern[-2] - 1], -1):
            rest = room - size
            if rest > 0 and has(size) and left[rest] > taken.count(rest) + (rest == size):
                return (*taken, size, rest)
        return None

    runs = []
    for j in np.argsort(-repeats, kind="stable"):
        wanted = int(repeats[j])
        while wanted > 0 and (sizes := exact(candidates[j])):
            taken = Counter(sizes)
            count = min(wanted, *(int(left[s]) // n for s, n in taken.items()))
            for s, n in taken.items():
                left[s] -= n * count
            runs.append(Run(count, tuple(taken.items()), 0))
            wanted -= count
    return runs


def _best_fit(runs: list[Run], left: np.ndarray, length: int) -> list[Run]:
    """All pieces in ``left``, longest first, each into the fullest sequence that has room."""
    by_room: dict[int, list[Run]] = {}
    for run in runs:
        by_room.setdefault(run.room, []).append(run)
    rooms = np.zeros(length + 1, bool)
    rooms[list(by_room)] = True
    for size in range(length, 0, -1):
        rest = int(left[size])
        while rest:
            room = size + int(rooms[size:].argmax())
            if rooms[room]:
                run = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                run, room = Run(-(-rest // (length // size)), (), length), length
            each = room // size
            full = min(run.count, rest // each)
            parts = [(full, each)]
            if full < run.count:
                some = rest - full * each
                some = min(some, each - 1) if some else 0
                parts += [(1, some)] if some else []
                parts += [(run.count - full - bool(some), 0)]
            for count, pieces in parts:
                if count:
                    content = (*run.content, (size, pieces)) if pieces else run.content
                    new = Run(count, content, room - pieces * size)
                    by_room.setdefault(new.room, []).append(new)
                    rooms[new.room] = True
                    rest -= count * pieces
    return [run for same in by_room.values() for run in same]


@dataclass
class Plan:
    """Runs of pieces of one length, ordered by length: the k-th piece of all lengths is in the last run from ``first`` on."""

    before: np.ndarray  # pieces of smaller lengths, per length
    first: np.ndarray
    size: np.ndarray
    each: np.ndarray  # pieces of this length in a sequence
    sequence: np.ndarray  # of the run's first piece
    offset: np.ndarray
    sequences: int

    def place(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and their number among those of that length."""
        index = self.before[size] + number
        run = np.searchsorted(self.first, index, side="right") - 1
        within = index - self.first[run]
        sequence = self.sequence[run] + within // self.each[run]
        return sequence, self.offset[run] + within % self.each[run] * self.size[run]


def plan(histogram: np.ndarray, cells: int = CELLS, documents: int = DOCUMENTS) -> Plan:
    """Pack ``histogram[k]`` pieces of each length k."""
    length = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    runs = _best_fit(_fitted_runs(left, length, cells, documents), left, length) if left.any() else []
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for size, each in run.content:
            rows.append((size, run.count * each, each, sequence, offset))
            offset += size * each
        sequence += run.count
    rows.sort()
    size, count, each, first_sequence, offset = np.array(rows, np.int64).reshape(-1, 5).T
    pieces = np.cumsum(count) - count
    before = np.concatenate([[0], np.cumsum(histogram.astype(np.int64))])[:-1]
    before -= int(histogram[0])
    return Plan(before, pieces, size, each, first_sequence, offset, sequence)


# ---- packing -------------------------------------------------------------------


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of every document."""
    pieces = saved(token_pieces(docs, length, tokenizer), "pack-pieces")
    counted = saved(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    sums = counted.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(length + 1, np.int64)
    histogram[sums.column("length").to_numpy()] = sums.column("n").to_numpy()
    planned = plan(histogram)

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    @F.pandas_udf("array<long>")
    def dense(lengths: pd.Series, values: pd.Series) -> pd.Series:
        rows = []
        for at, value in zip(lengths, values):
            row = np.zeros(length + 1, np.int64)
            row[at] = value
            rows.append(row)
        return pd.Series(rows)

    # An array over all lengths per task, so that a look-up does not search.
    known = offsets.groupBy(F.col("task").alias("_task")).agg(F.collect_list(F.struct("length", "before")).alias("known"))
    per_task = saved(known.select("_task", dense("known.length", "known.before").alias("_before")), "pack-offsets")
    if per_task.count() <= MOST_TASKS:
        per_task = F.broadcast(per_task)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(size: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = planned.place(size.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    number = F.get("_before", F.col("length").cast("int")) + F.col("place")
    joined = pieces.join(per_task, F.col("task") == F.col("_task")).withColumn("number", number)
    return joined.select("*", placed("length", "number").alias("spot")).select(
        "doc_id", "piece", "start", "length", "ids", "spot.sequence_id", "spot.offset"
    )
