"""Words of Arrow texts as byte ranges, and checksums of them, for whole columns at a time.

All separators are ASCII, so that UTF-8 texts can be cut byte by byte. A step works on at
most ``limit`` bytes however long a text is: texts are cut between words, and callers carry
what they need of the last word into the next step. Only a single word is never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from driftmart.llm.common import STEP_BYTES, mix64, random_words, ranges

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Table that is true for the bytes in the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


def _cut(raw: np.ndarray, starts: np.ndarray, blank: np.ndarray, begin: int, limit: int) -> int:
    """Where the step from ``begin`` ends: behind a blank byte, or where a text ends."""
    end = min(begin + limit, int(starts[-1]))
    if end == starts[-1]:
        return end
    blanks = np.flatnonzero(blank[raw[begin:end]])
    row = int(starts[np.searchsorted(starts, end, side="right") - 1])
    best = max(row, begin + int(blanks[-1]) + 1 if len(blanks) else begin)
    if best > begin:
        return best
    stop = int(starts[np.searchsorted(starts, end, side="right")])  # one word fills the step
    while end < stop:
        blanks = np.flatnonzero(blank[raw[end : min(end + limit, stop)]])
        if len(blanks):
            return end + int(blanks[0]) + 1
        end = min(end + limit, stop)
    return stop


def word_steps(
    raw: np.ndarray, starts: np.ndarray, blank: np.ndarray, limit: int = STEP_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per step: lower-cased bytes, and of each word first byte, length (in the step) and row.

    ``blank`` tells separators among lower-cased bytes.
    """
    blank = blank[LOWER]
    begin = int(starts[0])
    while begin < starts[-1]:
        end = _cut(raw, starts, blank, begin, limit)
        text = LOWER[raw[begin:end]]
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = ~blank[text]
        opening, closing = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        rows = starts[(starts > begin) & (starts < end)] - begin  # a word never goes on into the next text
        opening[rows] = inside[1:-1][rows]
        closing[rows - 1] = inside[1:-1][rows - 1]
        first = np.flatnonzero(opening)
        length = np.flatnonzero(closing) + 1 - first
        yield text, first, length, np.searchsorted(starts, first + begin, side="right") - 1
        begin = end


# CRC-32 is linear: without its constants, the checksum of a text is the XOR of what each
# byte contributes, which depends on the byte and the number of bytes behind it only.
SHORT = 64
_POLYNOMIAL = np.uint32(0xEDB88320)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ _POLYNOMIAL, step >> np.uint32(1))
    shift = np.empty((SHORT + 1, 4, 256), np.uint32)  # four bytes of a checksum moved on by so many bytes
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for d in range(SHORT):
        shift[d + 1] = step[shift[d] & np.uint32(255)] ^ (shift[d] >> np.uint32(8))
    share = np.empty((SHORT, 256), np.uint32)  # a byte with so many bytes behind it
    share[0] = step
    for d in range(SHORT - 1):
        share[d + 1] = step[share[d] & np.uint32(255)] ^ (share[d] >> np.uint32(8))
    constant = np.array([zlib.crc32(bytes(n)) for n in range(2 * SHORT + 2)], np.uint32)
    return share.ravel(), shift.ravel(), constant


_SHARE, _SHIFT, _CONSTANT = _tables()


def _moved(state: np.ndarray, by: np.ndarray) -> np.ndarray:
    place = by.astype(np.int64) * 1024
    out = _SHIFT[place + (state & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ _SHIFT[place + 256 * k + ((state >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def crc_of_words_and_pairs(
    text: np.ndarray, first: np.ndarray, length: np.ndarray, row: np.ndarray, carry: tuple[int, int] | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int] | None]:
    """CRC-32 of every word, of every word pair joined by a space, and the pair's row.

    ``carry`` is what the step before returned last: the row of its last word and, with a space behind it,
    its checksum.
    """
    n = len(first)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), carry
    short = length <= SHORT
    plain = np.zeros(n, np.uint32)  # without constants
    if short.any():
        size = length[short]
        place = ranges(first[short], size)
        behind = np.repeat(first[short] + size, size) - place - 1
        plain[short] = np.bitwise_xor.reduceat(_SHARE[behind * 256 + text[place]], np.cumsum(size) - size)
    inside = np.where(short, length, 0)
    crc = plain ^ _CONSTANT[inside]
    one = np.ones(n, np.int64)
    spaced = _moved(plain, one) ^ _SHARE[32]
    with_space = spaced ^ _CONSTANT[inside + 1]
    for i in np.flatnonzero(~short):
        word = text[first[i] : first[i] + length[i]].tobytes()
        crc[i] = zlib.crc32(word)
        with_space[i] = zlib.crc32(b" ", int(crc[i]))

    second = np.flatnonzero(row[1:] == row[:-1]) + 1
    pair = _moved(spaced[second - 1], inside[second]) ^ plain[second]
    pair ^= _CONSTANT[inside[second - 1] + 1 + inside[second]]
    for k in np.flatnonzero(~(short[second] & short[second - 1])):
        i = second[k]
        pair[k] = zlib.crc32(text[first[i] : first[i] + length[i]].tobytes(), int(with_space[i - 1]))
    pair_row = row[second]
    if carry is not None and carry[0] == row[0]:
        word = text[first[0] : first[0] + length[0]].tobytes()
        pair = np.append(pair, np.uint32(zlib.crc32(word, carry[1])))
        pair_row = np.append(pair_row, row[0])
    return crc, pair, pair_row, (int(row[-1]), int(with_space[-1]))


class WordHash:
    """64-bit hashes of words; different seeds give independent ones."""

    def __init__(self, seed: int):
        self.byte = random_words(256, seed)
        self.base = random_words(1, seed + 1)[0]
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, count: int) -> None:
        def powers(base: int) -> np.ndarray:
            factors = np.full(count, base, np.uint64)
            factors[0] = 1
            return np.cumprod(factors, dtype=np.uint64)

        self.powers = powers(int(self.base))
        self.inverse = powers(pow(int(self.base), -1, 1 << 64))

    def __call__(self, text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        if len(text) > len(self.powers):
            self._grow(max(len(text), STEP_BYTES))
        upto = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.byte[text] * self.powers[: len(text)], out=upto[1:])
        value = (upto[first + length] - upto[first]) * self.inverse[first]
        return mix64(value + length.astype(np.uint64))
