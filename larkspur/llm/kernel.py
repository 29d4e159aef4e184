"""Vectorised text primitives over UTF-8 bytes, shared by the operators that leave the JVM.

A text column arrives as Arrow buffers; everything here works on the bytes of many documents at once.
Separators are ASCII, so a word of the byte string is a word of the text. Hashes are polynomials
modulo 2**64 over a random byte table, finished by a mixer; callers that need certainty compare the
bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes handled at once, so that temporary arrays stay small for a text of any length
BLOCK = 4 << 20  # bytes of whole documents handled at once

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as blocks are alike in size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1024)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 2**64))
            done += step
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(chars: str, high: bool) -> np.ndarray:
    """True for the ASCII bytes in chars, and for all others above 0x7F if high."""
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    t[128:] = high
    return t


#: words that white space ends, [^\x20\x09-\x0D]+
SPACED = ~byte_class(" \t\n\x0b\x0c\r", False)
#: words of lower-cased letters and digits, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = byte_class("abcdefghijklmnopqrstuvwxyz0123456789", True)
#: words of letters of any script
LETTERS = byte_class("abcdefghijklmnopqrstuvwxyz", True)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together (one longer document makes a range)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a block: start and end in its bytes, hash, and where each document's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, hashes: bool = True):
        """data must already be lower-cased where words are to match without case."""
        n, pos = len(data), 0
        starts, ends, hs = [], [], []
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        while pos < n:
            size = SEGMENT
            while True:
                end = min(n, pos + size)
                m = table[data[pos:end]]
                if end < n and m[-1] and table[data[end]]:
                    back = int(np.argmax(~m[::-1]))
                    if not back:  # one word fills the segment
                        size *= 2
                        continue
                    end -= back
                    m = m[: end - pos]
                break
            lo, hi = np.searchsorted(inner, [pos, end])
            cut = inner[lo:hi] - pos
            before = np.empty(len(m), bool)
            before[0], before[1:] = False, m[:-1]  # a segment never begins within a word
            before[cut] = False
            after = np.empty(len(m), bool)
            after[-1], after[:-1] = False, m[1:]
            after[cut[cut > 0] - 1] = False
            s = np.flatnonzero(m & ~before)
            e = np.flatnonzero(m & ~after) + 1
            if hashes:
                total = np.empty(len(m) + 1, np.uint64)
                total[0] = 0
                np.cumsum(BYTE_CODE[data[pos:end]] * powers(BASE, len(m)), out=total[1:])
                h = (total[e] - total[s]) * powers(BASE_INV, len(m) + 1)[s]
                h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                hs.append(mix(h))
            starts.append(s + pos)
            ends.append(e + pos)
            pos = end
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hash = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        self.off = np.searchsorted(self.start, off)  # per document, one more than there are

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.count)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values of h, in order; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + h[k : len(h) - n + 1 + k]
    return mix(out ^ np.uint64(n))


def rows_of(off: np.ndarray, n: int) -> np.ndarray:
    """Positions i for which i .. i+n-1 lie in one document, given each document's first position."""
    count = np.diff(off) - n + 1
    ok = count > 0
    first, count = off[:-1][ok], count[ok]
    if not len(first):
        return np.zeros(0, np.int64)
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(len(shift)) + shift


#: classes of code points
OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
#: fixed values: Unicode's White_Space property
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_class_of: np.ndarray | None = None


def class_table() -> np.ndarray:
    """The class of every code point, from Python's own Unicode data; made once per process."""
    global _class_of
    if _class_of is None:
        import unicodedata

        by = {"L": LETTER, "N": NUMBER, "M": MARK}
        _class_of = np.array([by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        _class_of[list(WHITE_SPACE)] = SPACE
    return _class_of


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters above 0x7F: position of the first byte, number of bytes, code point."""
    at = np.flatnonzero(data >= 0xC0)
    b = data[at].astype(np.int32)
    n = np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4))
    cp = np.where(n == 2, b & 0x1F, np.where(n == 3, b & 0x0F, b & 0x07))
    for k in (1, 2, 3):
        more = n > k
        cp[more] = (cp[more] << 6) | (data[at[more] + k] & 0x3F)
    return at, n, cp


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = class_table()
    c = table[:256][data]  # bytes above 0x7F are set below
    at, n, cp = code_points(data)
    kind = table[cp]
    for k in range(4):
        more = n > k
        c[at[more] + k] = kind[more]
    return c


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value of h (equal for equal values), and where each number first stands."""
    codes = pa.array(h).dictionary_encode().indices.to_numpy()
    first = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, pad: int = 0, fill: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The slices data[start:start+size] one after another, each with pad bytes around it; offsets of the results."""
    off = np.concatenate([[0], np.cumsum(size + 2 * pad)])
    out = np.full(off[-1], fill, data.dtype)
    total = int(size.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(off[:-1] + pad, size) + inside] = data[np.repeat(start, size) + inside]
    return out, off
