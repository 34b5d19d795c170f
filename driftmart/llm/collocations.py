"""Phrase collocations per language, mined with Misra-Gries summaries.

Phrases are runs of 1 to 5 words within a piece of text; all counting is per language.

1. *Survivors.* Each task hashes its n-grams, counts equal ones, and deals (hash, count) out by
   the leading bits of the hash. Every hash partition is a Misra-Gries summary merged from the
   tasks' counts. Its capacity exceeds its mass divided by the threshold, so what it takes off
   any count stays below the threshold and each n-gram that reaches it survives. A survivor's
   count plus all that was taken off is an upper bound; below the threshold it goes, too.
   First words and pairs are summarised, then longer n-grams whose pairs all survived: no
   frequent n-gram holds a rare pair.
2. *Exact counts.* A second pass over the texts counts the survivors by their own words.
   Survivors reach the tasks as a bit map over hashes with a fixed bound of size; a rare n-gram
   that meets a set bit is counted as well and dropped by its exact count. Within a task
   n-grams are one when two independent 64-bit hashes agree; between tasks, when words do.
   Tasks add up what they hold and send it by hash partition, where the exact sums are made.
3. *Scores.* Joins of the frequent n-grams with their parts, in exact decimal arithmetic.

Style: Arrow batches for hashing, counting and summaries; DataFrame joins for the scores.
A summary holds mass / threshold counters; the number of hash partitions follows the bytes of
text, up to ``MOST_PARTS``. Words of one text are worked on in steps of bounded size.

Defined cases: NULL or blank text has no words; NULL ``lang`` is ``und``; an empty language is
one of its own; repeated rows count again; an empty table or one without frequent phrases
gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmart.llm.common import mix64, random_words, saved, string_bytes
from driftmart.llm.words import WordHash, byte_class, word_steps

WORDS = 5
LEAST = 100
TOP = 2_000
PERCENT = 100
UNKNOWN = "und"
# Bytes that end a piece, and those that end a word.
_PIECE_END = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
_BLANK = _PIECE_END | byte_class((0x20, 0x20), (0x09, 0x09))
# Words that a task counts together.
FLUSH_WORDS = 1_000_000
# N-gram occurrences aimed at per hash partition, and bounds of the partitions and of the bit map.
PART_MASS = 1 << 23
MOST_PARTS = 1 << 16
BITS_PER_COUNTER = 16
MOST_BITS = 28
# Phrases that a task or a hash partition holds before it adds up equal ones.
HELD_PHRASES = 500_000
# Counters a summary takes in before it is cut to its capacity again.
LEAST_BUFFER = 1 << 20

_HASH, _CHECK = WordHash(121), WordHash(131)
_MIX = random_words(2, 141)


# ---- Misra-Gries ---------------------------------------------------------------


class Summary:
    """Counters of at most ``capacity`` keys; no count is too small by more than ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts.astype(np.int64)))
        self.held += len(keys)
        if self.held >= max(2 * self.capacity, LEAST_BUFFER):
            self.cut()

    def cut(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        order = np.argsort(keys)
        keys = keys[order]
        firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        keys, counts = keys[firsts], np.add.reduceat(counts[order], firsts) if len(firsts) else counts
        if len(keys) > self.capacity:
            place = len(counts) - self.capacity - 1
            taken = int(np.partition(counts, place)[place])
            self.error += taken
            counts = counts - taken
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def reaching(self, least: int) -> np.ndarray:
        """All keys whose true count can be ``least`` or more."""
        self.cut()
        return self.keys[self.counts + self.error >= least]


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences; equal places of the bytes together, which compresses well."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = (steps.view(np.uint8).reshape(-1, 8).T, counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in planes)


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(payload, np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint64), counts


# ---- words and n-grams of a task -----------------------------------------------


@dataclass
class Words:
    """Words in order: hashes, number of the language, whether a piece begins.

    Only where words are to be read again: second hashes, and where their bytes are.
    """

    seeds: np.ndarray  # by number of the language
    hashes: np.ndarray
    langs: np.ndarray
    begins: np.ndarray
    checks: np.ndarray
    first: np.ndarray
    length: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def word(self, i: int) -> bytes:
        return self.text[self.first[i] : self.first[i] + self.length[i]].tobytes()

    def tail(self, begin: int) -> Words:
        at = int(self.first[begin]) if begin < len(self.first) else len(self.text)
        arrays = (x[begin:].copy() for x in (self.hashes, self.langs, self.begins, self.checks))
        return Words(self.seeds, *arrays, self.first[begin:] - at, self.length[begin:].copy(), self.text[at:].copy())

    def orders(self, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, starts, hashes) for n = 1, 2, ..; from pairs on only where ``allowed`` for all pairs inside."""
        n = len(self)
        places = np.arange(n + 1, dtype=np.int32)
        next_begin = np.where(np.append(self.begins, True), places, np.int32(n))
        next_begin = np.minimum.accumulate(next_begin[::-1])[::-1][1:]
        places = places[:-1]
        ahead = next_begin - places
        hashed = mix64(self.hashes ^ self.seeds[self.langs])
        yield 1, places, hashed
        for size in range(2, WORDS + 1):
            going = ahead[places] >= size
            if allowed is not None:
                going[going] = allowed[places[going] + size - 2]
            places = places[going]
            hashed = mix64(hashed[going] * _MIX[0] + self.hashes[places + size - 1])
            yield size, places, hashed


def language_seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def task_words(
    batches: Iterator[pa.RecordBatch], names: list[str], checked: bool = False, totals: dict[str, int] | None = None
) -> Iterator[tuple[Words, int]]:
    """Runs of words, and how many of them are starts: the last few come again as starts of the next run.

    ``names`` collects the languages, ``totals`` the words of each; ``checked`` asks for all fields.
    """
    none64, none8 = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    number: dict[str, int] = {}
    seeds = none64
    parts = [Words(seeds, none64, np.zeros(0, np.int32), none8.astype(bool), none64, np.zeros(0, np.int64), np.zeros(0, np.int64), none8)]
    held = 0

    def joined() -> Words:
        at = np.cumsum([0, *(len(p.text) for p in parts)])
        columns = [(p.hashes, p.langs, p.begins, p.checks, p.first + a, p.length, p.text) for p, a in zip(parts, at)]
        parts.clear()
        return Words(seeds, *map(np.concatenate, zip(*columns)))

    for batch in batches:
        raw, starts = string_bytes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lang in set(langs) - number.keys():
            number[lang] = len(names)
            names.append(lang)
        seeds = np.array([language_seed(x) for x in names], np.uint64)
        lang_of = np.array([number[x] for x in langs], np.int32)
        row_before, broken = -1, True
        for text, first, length, row in word_steps(raw, starts, _BLANK):
            ends = np.zeros(len(text) + 1, np.int32)
            np.cumsum(_PIECE_END[text], out=ends[1:])
            if not len(first):
                broken |= bool(ends[-1])
                continue
            begins = np.ones(len(first), bool)
            begins[1:] = (row[1:] != row[:-1]) | (ends[first[1:]] != ends[first[:-1] + length[:-1]])
            begins[0] = row[0] != row_before or broken or bool(ends[first[0]])
            row_before, broken = int(row[-1]), bool(ends[-1] != ends[first[-1] + length[-1]])
            if totals is not None:
                for k, n in enumerate(np.bincount(lang_of[row]).tolist()):
                    if n:
                        totals[names[k]] = totals.get(names[k], 0) + n
            hashes = _HASH(text, first, length)
            own = (_CHECK(text, first, length), first, length, text) if checked else (none64, first[:0], length[:0], none8)
            parts.append(Words(seeds, hashes, lang_of[row], begins, *own))
            held += len(first)
            if held >= FLUSH_WORDS:
                words = joined()
                starts_here = len(words) - (WORDS - 1)
                parts.append(words.tail(starts_here))
                held = len(parts[0])
                yield words, starts_here
    words = joined()
    yield words, len(words)


@dataclass(frozen=True)
class BitMap:
    """Set bits by the leading bits of a hash."""

    bits: np.ndarray  # bytes

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 8
        place = (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


# ---- first pass: survivors -----------------------------------------------------


def _pairs_allowed(words: Words, pairs: BitMap) -> np.ndarray:
    """Per word, whether the pair that starts there survived."""
    out = np.zeros(len(words), bool)
    for size, places, hashed in words.orders():
        if size == 2:
            out[places] = pairs.holds(hashed)
            return out
    return out


def survivors(docs: DataFrame, low: int, high: int, parts: int, bits: int, least: int, pairs: BitMap | None) -> BitMap:
    """Bit map of the n-grams of ``low`` to ``high`` words that can occur ``least`` times."""
    shift = 64 - (parts.bit_length() - 1)
    fields = ["part", "turn", "mass", "payload"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(parts, np.int64)

        def rows(which: np.ndarray, turn: int, masses: np.ndarray, payloads: list[bytes | None]) -> pa.RecordBatch:
            columns = [pa.array(which, pa.int32()), pa.array(np.full(len(which), turn), pa.int32())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(masses, pa.int64()), pa.array(payloads, pa.binary())], names=fields
            )

        for words, starts in task_words(batches, []):
            allowed = None if pairs is None else _pairs_allowed(words, pairs)
            hashes = np.concatenate([h[p < starts] for n, p, h in words.orders(allowed) if low <= n <= high])
            del words
            hashes.sort()
            if not len(hashes):
                continue
            firsts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            counts = np.diff(np.append(firsts, len(hashes)))
            keys = hashes[firsts]
            of = (keys >> np.uint64(shift)).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
            which, cuts = np.unique(of, return_index=True)
            mass += np.bincount(of, weights=counts, minlength=parts).astype(np.int64)
            ends = np.append(cuts[1:], len(keys))
            payloads = [_packed(keys[a:b], counts[a:b]) for a, b in zip(cuts, ends)]
            yield rows(which, 1, np.zeros(len(which), np.int64), payloads)
        which = np.flatnonzero(mass)
        yield rows(which, 0, mass[which], [None] * len(which))

    each = (1 << bits) // parts // 8

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = -1, 0, None

        def done() -> pa.RecordBatch:
            keys = summary.reaching(least)
            if summary.error >= least:
                raise RuntimeError(f"a summary took {summary.error} off its counts")
            place = (keys >> np.uint64(64 - bits)).astype(np.int64) - part * each * 8
            flags = np.zeros(each * 8, np.uint8)
            flags[place] = 1
            packed = np.packbits(flags, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for k in range(batch.num_rows):
                which, turn = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if which != part:
                    if summary is not None:
                        yield done()
                    part, mass, summary = which, 0, None
                if turn == 0:
                    mass += batch.column(2)[k].as_py()
                else:
                    summary = summary or Summary(mass // least + 1)
                    summary.merge(*_unpacked(batch.column(3)[k].as_buffer()))
        if summary is not None:
            yield done()

    dealt = docs.mapInArrow(deal, "part int, turn int, mass long, payload binary")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "turn")
    found = ordered.mapInArrow(summarise, "part int, bits binary").toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, own in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        out[k * each : (k + 1) * each] = np.frombuffer(own, np.uint8)
    return BitMap(out)


# ---- second pass: exact counts -------------------------------------------------


def _added_up(tables: list[pa.Table]) -> pa.Table:
    """One row per language and phrase."""
    summed = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    return summed.rename_columns({"n_sum": "n"})


def _phrases(words: Words, starts: int, names: list[str], short: BitMap, long: BitMap) -> pa.Table:
    """lang, phrase, n of the n-grams of a run that the bit maps hold."""
    langs, phrases, counts = [], [], []
    for size, places, hashed in words.orders(_pairs_allowed(words, short)):
        use = (places < starts) & (short if size <= 2 else long).holds(hashed)
        places, hashed = places[use], hashed[use]
        if not len(places):
            continue
        second = words.checks[places]
        for k in range(1, size):
            second = mix64(second * _MIX[1] + words.checks[places + k])
        order = np.lexsort((second, hashed))
        places, hashed, second = places[order], hashed[order], second[order]
        firsts = np.flatnonzero(np.append(True, (hashed[1:] != hashed[:-1]) | (second[1:] != second[:-1])))
        for at in places[firsts].tolist():
            phrases.append(b" ".join([words.word(i) for i in range(at, at + size)]).decode())
        langs.append(words.langs[places[firsts]])
        counts.append(np.diff(np.append(firsts, len(places))))
    which = np.concatenate(langs) if langs else np.zeros(0, np.int32)
    return pa.table(
        {
            "lang": pa.array(names, pa.string()).take(pa.array(which)),
            "phrase": pa.array(phrases, pa.string()),
            "n": pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
        }
    )


def exact_counts(docs: DataFrame, parts: int, least: int, short: BitMap, long: BitMap) -> DataFrame:
    """lang, phrase, n of all n-grams that occur ``least`` times; the empty phrase counts a language's words.

    A task sends its counts as arrays, one row per language and hash partition of the phrases.
    """
    fields = ["part", "lang", "phrases", "counts"]

    def dealt(table: pa.Table) -> Iterator[pa.RecordBatch]:
        phrases, counts = (table.column(c).combine_chunks() for c in ("phrase", "n"))
        code = table.column("lang").combine_chunks().dictionary_encode()
        part = np.fromiter((zlib.crc32(x.encode()) for x in phrases.to_pylist()), np.int64, len(phrases)) % parts
        lang = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((lang, part))
        firsts = np.flatnonzero(np.append(True, (np.diff(part[order]) != 0) | (np.diff(lang[order]) != 0))[: len(order)])
        ends, taken = pa.array(np.append(firsts, len(order)), pa.int32()), pa.array(order)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[order[firsts]], pa.int32()),
                code.dictionary.take(pa.array(lang[order[firsts]])),
                pa.ListArray.from_arrays(ends, phrases.take(taken)),
                pa.ListArray.from_arrays(ends, counts.take(taken)),
            ],
            names=fields,
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        names: list[str] = []
        held: list[pa.Table] = []
        for words, starts in task_words(batches, names, True, totals):
            held.append(_phrases(words, starts, names, short, long))
            del words
            if sum(map(len, held)) > HELD_PHRASES:
                held = [_added_up(held)]
                if len(held[0]) > HELD_PHRASES // 2:
                    yield from dealt(held.pop())
        words_of = pa.table({"lang": pa.array(totals, pa.string()), "phrase": pa.array([""] * len(totals), pa.string()), "n": pa.array(totals.values(), pa.int64())})
        yield from dealt(_added_up([*held, words_of]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []

        def done() -> Iterator[pa.RecordBatch]:
            table = _added_up(held)
            wanted = pc.or_(pc.greater_equal(table.column("n"), least), pc.equal(table.column("phrase"), ""))
            yield from table.filter(wanted).combine_chunks().to_batches()

        for batch in batches:
            which = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and which[a] != part:
                    if held:
                        yield from done()
                    part, held = which[a], []
                rows = batch.slice(a, b - a)
                phrases, counts = rows.column("phrases"), rows.column("counts")
                lang = rows.column("lang").take(pc.list_parent_indices(phrases))
                held.append(pa.table({"lang": lang, "phrase": phrases.flatten(), "n": counts.flatten()}))
                if len(held) > 1 and sum(map(len, held)) > 2 * HELD_PHRASES + 2 * len(held[0]):
                    held = [_added_up(held)]
        if held:
            yield from done()

    counted = docs.mapInArrow(count, "part int, lang string, phrases array<string>, counts array<long>")
    ordered = counted.repartition(parts, "part").sortWithinPartitions("part")
    return ordered.mapInArrow(add, "lang string, phrase string, n long")


def frequent_ngrams(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all n-grams that occur ``least`` times, and (lang, n)."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    mass = size // 2 + 1  # about the words and pairs of so many bytes
    parts = 1 << min(max(math.ceil(math.log2(mass / PART_MASS)), 0), MOST_PARTS.bit_length() - 1)
    bits = max(math.ceil(math.log2(mass / least * BITS_PER_COUNTER + 1)), parts.bit_length() + 2)
    bits = min(bits, MOST_BITS)
    short = survivors(rows, 1, 2, parts, bits, least, None)
    long = survivors(rows, 3, WORDS, parts, bits, least, short)
    counted = saved(exact_counts(rows, parts, least, short, long), "phrases")
    totals = counted.where("phrase = ''").select("lang", "n")
    frequent = counted.where("phrase != ''").select("lang", "phrase", F.col("n").alias("a"))
    return frequent.withColumn("words", F.size(F.split("phrase", " "))), totals


# ---- scores --------------------------------------------------------------------


def _joined(words: str, first: str, size: str) -> F.Column:
    return F.expr(f"array_join(slice({words}, {first}, {size}), ' ')")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    frequent, totals = frequent_ngrams(docs, least)
    phrases = frequent.where("words >= 2").withColumn("w", F.split("phrase", " "))
    part = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias("_count"))

    def with_count(rows: DataFrame, column: str, count: str) -> DataFrame:
        same = (F.col("lang") == F.col("_lang")) & (F.col(column) == F.col("_part"))
        return rows.join(part, same).drop("_lang", "_part", column).withColumnRenamed("_count", count)

    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "lang", "phrase", "a", "k", _joined("w", "1", "k").alias("left"), _joined("w", "k + 1", "words - k").alias("right")
    )
    cuts = with_count(with_count(cuts, "left", "l"), "right", "r").join(totals, "lang")
    whole = {c: f"cast({c} AS decimal(19, 0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"({whole['a']} * {whole['n']} * 1000) div ({whole['l']} * {whole['r']})")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # A longer phrase around a candidate holds one that is longer by one word and at least as frequent.
    around = (
        phrases.where("words >= 3")
        .select("lang", F.col("a").alias("longer"), F.explode(F.array(_joined("w", "1", "words - 1"), _joined("w", "2", "words - 1"))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = lowest.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)
    )
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# The same rows in DuckDB SQL.
ORACLE = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM lists GROUP BY lang),
ngrams AS (
  SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)),
                                           lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest(range(1, 6)) AS size)),
frequent AS (
  SELECT lang, phrase, any_value(size) AS size, count(*)::HUGEINT AS a
  FROM ngrams GROUP BY lang, phrase HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE size >= 2),
cuts AS (SELECT lang, phrase, a, size, w, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, k, (1000 * c.a * n) // (l.a * r.a) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = s.lang AND 100 * d.a >= 100 * s.a AND d.phrase != s.phrase
      AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
