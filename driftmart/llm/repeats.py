"""Repeated passages: run-length BWT indexes with sampled runs, streamed matching statistics.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts in a document
with a smaller ``doc_id``. Strings are judged on the input and never cross documents.

1. Cut. Of the hashes of all ``GRAM``-byte strings in a window of ``LENGTH`` bytes the
   smallest is the window's minimizer: equal windows have equal minimizers. Neighbouring
   windows of one minimizer form a fragment, and fragments are dealt by minimizer, so that
   all occurrences of a window meet in one bucket. Where one step of a task holds equal
   fragments, those of greater documents are removed on the spot and only the first is
   dealt, so a passage in a third of all documents arrives once per step. At its edges
   fragments carry their documents' own text and stay distinct: where the fragments of one
   minimizer would fill a bucket, they are split and dealt by the minimizer with ``FINE``
   bytes around it, and where these would, as single windows by all their bytes. Equal
   windows share each of these keys, and the keys that are hot are counted first.
2. Screen. In a bucket, a fragment stays only if an occurrence of its minimizer together
   with the bytes on one side, half a window's worth, also occurs in another document: any
   equal window contains one of the two at its first occurrence. A fragment may hold its
   minimizer several times, and every occurrence is looked at. Of equal fragments all but the first document's are removed
   whole; of the first ones, a second screen with longer strings keeps those that may share
   a window with a different fragment.
3. Index. The bucket's distinct fragments are joined to a text in order of their first
   document; its Burrows-Wheeler transform is kept as runs, which repetitive text makes
   long, each with its place in the LF-mapping and, sampled at the run, the first document
   among all suffixes that share the run's next ``LENGTH`` bytes.
4. Match. All fragments are streamed backwards through the runs, one LF-step per byte. When
   at least ``LENGTH`` bytes have been read, the run's sample says whether that much also
   matches in a smaller document: matching statistics, of which only the comparison with
   ``LENGTH`` is wanted.
5. The matches' spans are grouped by document and cut out of its text.

Buckets hold about ``BUCKET_BYTES`` of text, their number follows the input's size.
Equality of fragments is decided by 64-bit hashes joined with their length and minimizer,
matches by the index.

Defined cases: NULL text is empty; a row with a NULL ``doc_id`` neither loses nor causes
anything; rows of one ``doc_id`` do not affect each other; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmart.llm.common import mix64, random_words, ranges, steps, string_bytes

LENGTH = 50
GRAM = 12
SPAN = LENGTH - GRAM + 1  # grams in a window, and windows in a fragment at most
# Bytes before and after the minimizer: a window holds at least one pair of each list.
ROUGH = ((19, 0), (0, 19))
FINE = ((0, 29), (10, 19), (20, 10), (29, 0))
BUCKET_BYTES = 1_800_000
DEAL_BYTES = 8 << 20
PACKING = 6
ENTRY_BYTES = 16  # of a fragment's row and place

_VALUE = random_words(256, 31)
_POWER = random_words(8, 32)
_BASE = random_words(1, 33)[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# The minimizer's offset in a window decides which of the FINE strings lies in the window.
_SIDE_LEFT = np.array([left for left, _ in FINE])
_SIDE_ENDS = _SIDE_LEFT[1:]


class Substrings:
    """Hashes of any substrings of a byte array, from sums over its prefixes."""

    def __init__(self, raw: np.ndarray):
        # In place, as these arrays are eight times as long as the text.
        self.upto = np.zeros(len(raw) + 1, np.uint64)
        sums = self.upto[1:]
        np.take(_VALUE, raw, out=sums)
        sums *= _powers(_BASE, len(raw))
        np.cumsum(sums, out=sums)
        self.back = _powers(_INVERSE, len(raw) + 1)

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        total = (self.upto[start + length] - self.upto[start]) * self.back[start]
        return mix64(total + np.asarray(length, np.uint64) * _POWER[4])


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.ones(max(count, 1), np.uint64)
    filled = 1
    while filled < count:
        more = min(filled, count - filled)
        out[filled : filled + more] = out[:more] * (out[filled - 1 : filled] * base)
        filled += more
    return out[:count]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte strings, put together from those of 4 and 8 bytes."""
    one = _VALUE[raw]
    two = one[:-1] * _POWER[0] + one[1:]
    four = two[:-2] * _POWER[1] + two[2:]
    eight = four[:-4] * _POWER[2] + four[4:]
    return mix64(eight[:-4] * _POWER[3] + four[8:])


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    least, size = hashes, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def fragments(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, number of windows, offset of the minimizer and its hash, of the rows' fragments."""
    size = np.diff(bounds) - LENGTH + 1
    size[size < 0] = 0
    if not size.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(raw)
    window = ranges(bounds[:-1], size)  # windows that lie in one row
    row = np.repeat(np.arange(len(size)), size)
    least = window_minima(hashes, SPAN)[window]
    new = np.flatnonzero(
        np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    )
    # Long runs of one minimizer, as in periodic text, are cut to SPAN windows.
    runs = np.diff(np.append(new, len(least)))
    pieces = -(-runs // SPAN)
    first = np.repeat(new, pieces) + ranges(np.zeros(len(new), np.int64), pieces) * SPAN
    windows = np.diff(np.append(first, len(least)))
    start, value = window[first], least[first]
    # The minimizer's first place in the fragment's first window.
    place = np.full(len(start), -1)
    for k in range(SPAN):
        place[(place < 0) & (hashes[start + k] == value)] = k
    return row[first], start, windows, place, value


def _classes(doc: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each fragment the first one of equal content in the smallest document."""
    order = np.lexsort((doc, same))
    new = np.ones(len(order), bool)
    new[1:] = same[order][1:] != same[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return head


def _split(
    level: int, text: np.ndarray, row: np.ndarray, at: np.ndarray, windows: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Parts of fragments whose key is hot, under longer keys that equal windows share.

    First the windows of one occurrence of the minimizer and one of the ``FINE`` sides, by
    the minimizer with these bytes; then single windows, by all their bytes.
    """
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    sizes = np.concatenate([[0], np.cumsum(windows + LENGTH - 1)])
    for a, b in steps(sizes):
        count = windows[a:b]
        length = count + LENGTH - 1
        begin = np.cumsum(length) - length
        content = text[ranges(at[a:b], length)]
        substrings = Substrings(content)
        spots = np.unique(_occurrences(substrings, content, begin, length, place[a:b])[1])
        window = ranges(begin, count)
        which = np.repeat(np.arange(b - a), count)
        spot = spots[np.searchsorted(spots, window)]  # each window's own first occurrence
        side = np.searchsorted(_SIDE_ENDS, spot - window, side="right")
        if level == 0:
            new = np.ones(len(window), bool)
            new[1:] = (which[1:] != which[:-1]) | (spot[1:] != spot[:-1]) | (side[1:] != side[:-1])
            first = np.flatnonzero(new)
        else:
            first = np.arange(len(window))
        own = np.diff(np.append(first, len(window)))
        window, which, spot, side = window[first], which[first], spot[first], side[first]
        if level == 0:
            key = substrings(spot - _SIDE_LEFT[side], FINE[0][1] + GRAM) + side.astype(np.uint64) * _POWER[5]
        else:
            key = substrings(window, LENGTH)
        key = mix64(key + _POWER[6 + level])
        same = substrings(window, own + LENGTH - 1) ^ key
        found = (row[a:b][which], at[a:b][which] + window - begin[which], own, spot - window, key, same)
        for k, x in enumerate(found):
            parts[k].append(x)
    return tuple(np.concatenate(x) for x in parts)


def _fragments_of_step(
    raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, hot: list[np.ndarray]
) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of one step's rows: fragments with keys that are not hot, those split ``len(hot)`` times, what is removed.

    Row, place in the step, windows, offset of the minimizer, key, and the index of the first
    fragment of equal content; of the removed row, place and length.
    """
    base = starts[0]
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for a, b in steps(starts):
        low = starts[a] - base
        text = raw[starts[a] : starts[b]]
        row, start, count, place, value = fragments(text, starts[a : b + 1] - starts[a])
        contents = Substrings(text)(start, count + LENGTH - 1) ^ value
        for k, x in enumerate((row + a, start + low, count, place, value, contents)):
            parts[k].append(x)
    row, at, windows, place, key, same = (np.concatenate(x) for x in parts)
    text = raw[base : starts[-1]]
    done: list[list[np.ndarray]] = [[] for _ in range(6)]
    lost: list[tuple[np.ndarray, ...]] = []
    total = 0
    for level in range(len(hot) + 1):
        doc = ids[row]
        head = _classes(doc, same)
        gone = doc > doc[head]
        lost.append((row[gone], at[gone], windows[gone] + LENGTH - 1))
        again = ~gone & np.isin(key, hot[level]) if level < len(hot) else np.zeros(len(row), bool)
        stays = ~gone & ~again
        # All that stays of one content stays together, so its head stays, too.
        number = np.cumsum(stays) - 1
        last = (row[stays], at[stays], windows[stays], place[stays], key[stays], number[head[stays]] + total)
        total += len(last[0])
        for k, x in enumerate(last):
            done[k].append(x)
        if not again.any():
            if level < len(hot):
                last = tuple(x[:0] for x in last)
            break
        row, at, windows, place, key, same = _split(level, text, row[again], at[again], windows[again], place[again])
    gone = tuple(np.concatenate([x[k] for x in lost]) for k in range(3))
    return tuple(np.concatenate(x) for x in done), last, gone


def _united(row: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the rows with those that overlap put together."""
    order = np.lexsort((at, row))
    row, at, end = row[order], at[order], (at + length)[order]
    reach = np.maximum.accumulate(end)  # rows lie one behind the other
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return row[first], at[first], reach[last] - at[first]


def _deal(
    buckets: int, raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, keys: np.ndarray, hot: list[np.ndarray]
) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed fragments) of one step's rows; what the step itself removes has a bucket below 0."""
    (row, at, windows, place, value, head), _, gone = _fragments_of_step(raw, starts, ids, hot)
    text = raw[starts[0] : starts[-1]]
    row_start = starts - starts[0]
    packer = zstandard.ZstdCompressor(level=PACKING)

    def pack(local: np.ndarray, own: np.ndarray, lost: tuple[np.ndarray, ...]) -> bytes:
        used, local = np.unique(local, return_inverse=True)
        kept, removed = local[: len(own)], local[len(own) :]
        first = own[head[own] == own]
        number = np.searchsorted(first, head[own]) if len(own) else own
        payload = (
            ids[used],
            keys[used],
            np.diff(kept, prepend=0).astype(np.uint32),
            (at[own] - row_start[row[own]]).astype(np.uint32),
            np.diff(number, prepend=0).astype(np.uint32),
            windows[first].astype(np.uint8),
            place[first].astype(np.uint8),
            text[ranges(at[first], windows[first] + LENGTH - 1)],
            removed.astype(np.uint32),
            (lost[1] - row_start[lost[0]]).astype(np.uint32),
            lost[2].astype(np.uint32),
        )
        return packer.compress(pickle.dumps([x.tobytes() for x in payload]))

    none = np.zeros(0, np.int64)
    if len(gone[0]):
        gone = _united(*gone)
        spread = int(mix64(ids[gone[0][:1]].astype(np.uint64))[0] % np.uint64(buckets))
        yield -1 - spread, pack(gone[0], none, gone)
    bucket = (value % np.uint64(buckets)).astype(np.int64)
    # In order of place; the first of equal fragments keep their numbers' order within a bucket.
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(by_bucket))):
        own = by_bucket[a:b]
        yield int(bucket[own[0]]), pack(row[own], own, (none, none, none))


def _heavy(raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, hot: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys, after ``len(hot)`` splits, with at least this share of the step's bytes, and their bytes in buckets."""
    _, _, windows, _, key, head = _fragments_of_step(raw, starts, ids, hot)[1]
    first = np.zeros(len(head), bool)
    first[np.unique(head, return_index=True)[1]] = True
    key, which = np.unique(key, return_inverse=True)
    size = np.bincount(which, np.where(first, windows + LENGTH - 1, 0) + ENTRY_BYTES).astype(np.int64)
    heavy = size >= share * float(starts[-1] - starts[0])
    return key[heavy], size[heavy]


_TYPES = (
    np.int64,
    np.int64,
    np.uint32,
    np.uint32,
    np.uint32,
    np.uint8,
    np.uint8,
    np.uint8,
    np.uint32,
    np.uint32,
    np.uint32,
)


def run_index(symbols: np.ndarray, rest: np.ndarray, owner: np.ndarray):
    """Run starts, LF of run starts, and first owner of each run, of a text of ended strings.

    ``symbols``: bytes + 1, and 0 at each string's end. ``rest``: distance to that end.
    ``owner``: document of each place. Equal suffixes are in order of place.
    """
    n = len(symbols)
    place = np.arange(n)
    wide = np.concatenate([symbols, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | np.where(rest >= j, wide[j : j + n], 0)
    rank = np.unique(key, return_inverse=True)[1]
    size, longest = 7, int(rest.max()) + 1
    same = None
    while size < longest:
        if size == 28:
            # Equal first 28 symbols here and LENGTH - 28 further on: equal windows.
            later = np.minimum(place + LENGTH - 28, n - 1)
            same = np.where(rest >= LENGTH, rank * (n + 1) + rank[later], -1 - place)
        later = np.where(rest >= size, rank[np.minimum(place + size, n - 1)] + 1, 0)
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1]
        size *= 2
    order = np.lexsort((place, rank))
    before = symbols[order - 1]
    same = same[order]
    bound = np.concatenate([[True], same[1:] != same[:-1]])
    first = np.minimum.reduceat(owner[order], np.flatnonzero(bound))[np.cumsum(bound) - 1]
    heads = np.flatnonzero(bound | np.concatenate([[True], before[1:] != before[:-1]]))
    letter, run = before[heads], np.diff(np.append(heads, n))
    smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=257))])[letter]
    by_letter = np.argsort(letter, kind="stable")
    upto = np.cumsum(run[by_letter]) - run[by_letter]
    starts = np.concatenate([[True], letter[by_letter][1:] != letter[by_letter][:-1]])
    within = upto - upto[np.maximum.accumulate(np.where(starts, np.arange(len(upto)), 0))]
    lf = np.empty(len(heads), np.int64)
    lf[by_letter] = within
    return heads, lf + smaller, first[heads]


def repeated_windows(content: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each string (rows) and window (columns): whether it also lies in a string of a smaller owner.

    Strings come in order of owner.
    """
    count = len(length)
    ends = np.cumsum(length + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = content.astype(np.int64) + 1
    string = np.repeat(np.arange(count), length + 1)
    rest = ends[string] - np.arange(len(symbols))
    heads, lf, first = run_index(symbols, rest, owner[string])
    out = np.zeros((count, int(length.max()) - LENGTH + 1), bool)
    live = np.arange(count)
    row = np.arange(count)  # the ends sort first, in order
    for read in range(int(length.max()) + 1):
        run = np.searchsorted(heads, row, side="right") - 1
        if read >= LENGTH:
            hit = first[run] < owner[live]
            out[live[hit], length[live[hit]] - read] = True
        more = length[live] > read
        row, run, live = row[more], run[more], live[more]
        row = lf[run] + row - heads[run]
    return out


def _spans(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """doc_id, text key, start and length of what one bucket removes."""
    unpack = zstandard.ZstdDecompressor()
    columns: list[list[np.ndarray]] = [[] for _ in _TYPES]
    docs = contents = 0
    for payload in payloads:
        part = [np.frombuffer(x, t) for x, t in zip(pickle.loads(unpack.decompress(payload)), _TYPES)]
        part[2] = np.cumsum(part[2], dtype=np.uint32) + np.uint32(docs)
        part[4] = np.cumsum(part[4], dtype=np.uint32) + np.uint32(contents)
        part[8] = part[8] + np.uint32(docs)
        for k, x in enumerate(part):
            columns[k].append(x)
        docs += len(part[0])
        contents += len(part[5])
    ids, keys, local, at, entry, windows, place, content, lost, lost_at, lost_length = (np.concatenate(x) for x in columns)
    local, at, entry, windows, place = (x.astype(np.int64) for x in (local, at, entry, windows, place))
    out = [(lost.astype(np.int64), lost_at.astype(np.int64), lost_length.astype(np.int64))]
    length = windows + LENGTH - 1
    begin = np.cumsum(length) - length
    doc = np.empty(len(windows), np.int64)
    doc[entry] = ids[local]  # the entries of one content are of one document
    substrings = Substrings(content)
    which, spot = _occurrences(substrings, content, begin, length, place)
    keep = _screen(substrings, begin, length, which, spot, doc, ROUGH)
    number = np.cumsum(keep) - 1
    stays = keep[entry]
    local, at, entry = local[stays], at[stays], number[entry[stays]]
    length, begin, place, doc = (x[keep] for x in (length, begin, place, doc))
    if len(length):
        same = substrings(begin, length)
        order = np.lexsort((doc, same))
        new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        heads = order[new]  # the first document's fragment of each class
        member = np.empty(len(order), np.int64)
        member[order] = np.cumsum(new) - 1
        copies = doc > doc[heads][member]
        copied = copies[entry]
        out.append((local[copied], at[copied], length[entry[copied]]))
        # Only heads that may share a window with another document's head need the index.
        which, spot = _occurrences(substrings, content, begin[heads], length[heads], place[heads])
        fine = _screen(substrings, begin[heads], length[heads], which, spot, doc[heads], FINE)
        indexed = np.flatnonzero(fine)
        indexed = indexed[np.lexsort((heads[indexed], doc[heads[indexed]]))]
        number = np.full(len(heads), -1)
        number[indexed] = np.arange(len(indexed))
        own = np.flatnonzero((~copies & fine[member])[entry])
        if len(own):
            h = heads[indexed]
            hit = repeated_windows(content[ranges(begin[h], length[h])], length[h], doc[h])
            row, column = np.nonzero(hit[number[member[entry[own]]]])
            begins = np.ones(len(row), bool)
            begins[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1] + 1)
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(row))[: len(first)] - 1
            which = own[row[first]]
            out.append((local[which], at[which] + column[first], column[last] - column[first] + LENGTH))
    which, start, size = (np.concatenate([x[k] for x in out]) for k in range(3))
    return ids[which], keys[which], start, size


def _occurrences(
    substrings: Substrings, content: np.ndarray, begin: np.ndarray, length: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Fragment and place in ``content`` of every occurrence of the fragments' minimizers."""
    first = begin + place
    byte, value = content[first], substrings(first, GRAM)
    which, spots = [np.arange(len(begin))], [first]
    for k in range(1, int(length.max(initial=0))):
        index = np.flatnonzero(place + k + GRAM <= length)
        index = index[content[first[index] + k] == byte[index]]
        index = index[substrings(first[index] + k, GRAM) == value[index]]
        which.append(index)
        spots.append(first[index] + k)
    return np.concatenate(which), np.concatenate(spots)


def _screen(
    substrings: Substrings,
    begin: np.ndarray,
    length: np.ndarray,
    which: np.ndarray,
    spot: np.ndarray,
    doc: np.ndarray,
    sides: tuple[tuple[int, int], ...],
) -> np.ndarray:
    """Fragments of which an occurrence of the minimizer, with bytes on one of these sides, is in another document, too."""
    keep = np.zeros(len(begin), bool)
    for left, right in sides:
        at, size = spot - left, left + GRAM + right
        inside = np.flatnonzero((at >= begin[which]) & (at + size <= begin[which] + length[which]))
        if not len(inside):
            continue
        index, value = which[inside], substrings(at[inside], size)
        order = np.lexsort((doc[index], value))
        index, value = index[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        last = np.append(new[1:], len(value)) - 1
        shared = doc[index[new]] != doc[index[last]]
        keep[index[np.repeat(shared, last - new + 1)]] = True
    return keep


def text_key(docs: DataFrame) -> Column:
    """What tells rows of one ``doc_id`` apart: nothing where ids are unique, else their texts."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")


def _hot_keys(rows: DataFrame, size: int, bucket_bytes: int) -> list[np.ndarray]:
    """Sorted keys whose fragments would fill a bucket or more, of minimizers and of parts after one split.

    A step leaves out keys below its share of a bucket, less than a bucket's bytes in all, so
    that every key with two buckets' bytes is among the result.
    """
    hot: list[np.ndarray] = []
    if size <= bucket_bytes:
        return hot
    for _ in range(2):

        def count(batches: Iterator[pa.RecordBatch], hot: list[np.ndarray] = hot[:]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, starts = string_bytes(batch.column("text"))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for a, b in steps(starts, DEAL_BYTES):
                    key, heavy = _heavy(raw, starts[a : b + 1], ids[a:b], hot, bucket_bytes / size)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(heavy)], names=["key", "bytes"])

        sums = rows.mapInArrow(count, "key long, bytes long").groupBy("key").agg(F.sum("bytes").alias("bytes"))
        found = [r[0] for r in sums.where(F.col("bytes") >= bucket_bytes).select("key").collect()]
        if not found:
            break
        hot.append(np.sort(np.array(found, np.int64).view(np.uint64)))
    return hot


def dealt(docs: DataFrame, key: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """bucket, payload: packed fragments of a step's rows."""
    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    hot = _hot_keys(rows, size, bucket_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = string_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            for a, b in steps(starts, DEAL_BYTES):
                found = list(_deal(buckets, raw, starts[a : b + 1], ids[a:b], keys[a:b], hot))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())],
                    names=["bucket", "payload"],
                )

    return rows.withColumn("text_key", key).mapInArrow(deal, "bucket long, payload binary")


def removed_spans(docs: DataFrame, key: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text_key, start, length of removed bytes; spans of a row may overlap."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [x for batch in batches for x in batch.column("payload").to_pylist()]
        ids, keys, start, size = _spans(payloads)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(keys), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
            names=["doc_id", "text_key", "start", "length"],
        )

    return (
        dealt(docs, key, bucket_bytes)
        .groupBy("bucket")
        .applyInArrow(match, "doc_id long, text_key long, start int, length int")
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress((x or "").encode("utf-8", "surrogatepass")) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(packed, pa.binary())],
            names=["doc_id", "text_key", "packed"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for packed, spans in zip(batch.column("packed"), batch.column("spans")):
            raw = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
            change = np.zeros(len(raw) + 1, np.int64)
            if spans.is_valid:
                start = spans.values.field(0).to_numpy().astype(np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + spans.values.field(1).to_numpy(), -1)
            gone = np.cumsum(change)[:-1] > 0
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = hashlib.sha256(raw[~gone].tobytes()).hexdigest()
            out.append((len(raw), int(gone.sum()), runs, kept))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[pa.array(c, pa.int64()) for c in columns[:3]],
                pa.array(columns[3], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def without_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    key = text_key(docs)
    spans = removed_spans(docs, key, bucket_bytes)
    cuts = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("start", "length")).alias("spans")
    )
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), key.alias("text_key")
    )
    # Texts move packed, half as many bytes; a merge join at every size.
    packed = rows.mapInArrow(_pack, "doc_id long, text_key long, packed binary")
    joined = packed.join(
        cuts.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left"
    )
    return joined.select("doc_id", "packed", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
