"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every byte that a string of `LENGTH` bytes covers goes, if that string also starts in a document
with a smaller doc_id. Suffixes need only be ordered through LENGTH bytes for that: suffixes that
are equal so far are exactly the repeated windows. The order is by digits, the most significant
first, and a digit is spent only on groups that the ones before left with several documents:

1. The first pass is over the window's anchor, the KMER bytes at the place that a mod-minimizer picks
   by content, so equal windows have equal anchors at equal places. Neighbouring windows share an
   anchor; about one position in fifteen is one. Anchors in one document only are dropped; a hash of
   the anchor deals the others to buckets, where a false match costs work and decides nothing.
2. In a bucket the suffixes that begin with an anchor are sorted by digits of eight of their bytes,
   the most significant first, through the end of the longest window; a digit is looked at only for
   suffixes that all digits before left with others. What precedes an anchor is sorted the same way,
   read backwards. Suffixes equal through so many bytes on either side are the repeated windows for
   that place of the anchor, byte for byte, and each group's smallest doc_id decides.

Documents are dealt into chunks by a hash of the whole row. A chunk gathers its anchors, one entry
for each distinct one, before anything is shuffled, and asks buckets of the hash range about them;
so an anchor of very many documents costs one entry a chunk, not one a document. Occurrences with
equal surroundings within a chunk go on as one. An anchor that more than `HOT` rows of some
chunk, or more than `HOT` chunks have, goes by whole windows instead, each under a 128-bit digest, spread
over all buckets with a minimum taken first in each chunk. Answers go back to the chunks, which meet
their texts again. Chunks and buckets have a fixed size, so their number grows with the input, and
memory does not.

Defined cases: a null text is empty; texts shorter than LENGTH bytes lose nothing; a null doc_id is
larger than any other and is matched by all smaller ones only; rows that share a doc_id (ties) don't
remove each other's passages; rows that repeat entirely are worked on once, whatever their number,
and each gets its result; a text of any length is one document, taken whole; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .store import written

LENGTH = 50
KMER = 29
STEP = LENGTH - KMER + 1  # places of an anchor in a window
TMER = 7
SIDE = LENGTH - KMER
CHUNK = 6 << 20  # bytes of text in a chunk
BUCKET = 16 << 20  # bytes of text whose anchors share a bucket
HOT = 512
BASE_2 = 0xD1342543DE82EF95
SEGMENT = 1 << 19
ENTRY = KMER + 2 * SIDE + 2  # the anchor, what surrounds it, and how much there is of that
LAST = np.int64(2**63 - 1)  # stands for a null doc_id
MESSAGE = "chunk int, bucket int, kind int, a binary, b binary"


def anchors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all windows of LENGTH bytes within documents."""
    n = len(data)
    picked = np.zeros(n, bool)
    for a in range(0, n, SEGMENT):
        part = data[a : min(n, a + SEGMENT + LENGTH - 1)]
        count = len(part) - LENGTH + 1
        if count <= 0:
            break
        two = part.astype(np.uint64)
        two = two[:-1] | (two[1:] << np.uint64(8))
        four = two[:-2] | (two[2:] << np.uint64(16))
        h = K.mix(four[:-3] ^ (four[3:] << np.uint64(24)))  # of TMER bytes
        low = np.uint64((1 << 20) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= LENGTH - TMER + 1:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        rest = LENGTH - TMER + 1 - width
        m = np.minimum(m[: len(m) - rest], m[rest:])[:count]
        ok = np.ones(count, bool)
        lo, hi = np.searchsorted(off, [a + 1, a + len(part)])
        for e in (off[lo:hi] - a).tolist():
            ok[max(0, e - LENGTH + 1) : e] = False
        i = np.flatnonzero(ok)
        x = (m[i] & low).astype(np.int64)
        picked[a + i + (x - i) % STEP] = True
    return np.flatnonzero(picked)


def _poly(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of data[start:start+size] for each start."""
    out = np.zeros(len(start), np.uint64)
    for a in range(0, len(data), SEGMENT):
        lo, hi = np.searchsorted(start, [a, a + SEGMENT])
        if lo == hi:
            continue
        part = data[a : a + SEGMENT + size]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(K.BYTE_CODE[part] * K.powers(K.BASE, len(part)), out=total[1:])
        s = start[lo:hi] - a
        out[lo:hi] = K.mix((total[s + size] - total[s]) * K.powers(K.BASE_INV, len(part) + 1)[s])
    return out


class Chunk:
    """The texts of a chunk in an order of their own, and their anchors."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        data, off = K.utf8(table.column("text"))
        self.rows = len(ids)
        self.times = table.column("times").to_pylist()
        self.ids = ids
        self.doc = np.array([LAST if i is None else i for i in ids], np.int64)
        self.data, self.off = data, off
        self.at = anchors(data, off)
        self.of = np.searchsorted(off, self.at, "right") - 1
        self.hash = _poly(data, self.at, KMER)

    def sides(self, pick: np.ndarray) -> np.ndarray:
        """[anchor, SIDE left, SIDE right, bytes there are left, right] of the anchors in pick."""
        p, d = self.at[pick], self.of[pick]
        left = np.minimum(SIDE, p - self.off[d])
        right = np.minimum(SIDE, self.off[d + 1] - p - KMER)
        out = np.zeros((len(p), 2 * SIDE + 2), np.uint8)
        for k in range(SIDE):  # nearest first on either side
            ok = left > k
            out[ok, k] = self.data[p[ok] - 1 - k]
            ok = right > k
            out[ok, SIDE + k] = self.data[p[ok] + KMER + k]
        out[:, 2 * SIDE], out[:, 2 * SIDE + 1] = left, right
        return out


def _places(h: np.ndarray, sides: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place of the anchor in a window: the place, rows that have such a window, and a 128-bit digest of the window."""
    n = len(h)
    out: list[list] = [[] for _ in range(SIDE + 1)]
    for base in (K.BASE, BASE_2):
        left = np.zeros((SIDE + 1, n), np.uint64)
        right = np.zeros((SIDE + 1, n), np.uint64)
        for k in range(SIDE):
            left[k + 1] = left[k] * np.uint64(base) + K.BYTE_CODE[sides[:, k]]
            right[k + 1] = right[k] * np.uint64(base) + K.BYTE_CODE[sides[:, SIDE + k]]
        for o in range(SIDE + 1):
            rows = np.flatnonzero((sides[:, 2 * SIDE] >= o) & (sides[:, 2 * SIDE + 1] >= SIDE - o))
            out[o].append(K.mix(K.mix(h[rows] ^ left[o][rows]) + right[SIDE - o][rows] * np.uint64(base) + np.uint64(o)))
    for o in range(SIDE + 1):
        rows = np.flatnonzero((sides[:, 2 * SIDE] >= o) & (sides[:, 2 * SIDE + 1] >= SIDE - o))
        yield o, rows, np.stack(out[o], 1)


def _numbered(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of pairs in order, and the number of each row's."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ranked = pairs[order]
    new = np.concatenate([np.ones(min(1, len(ranked)), bool), (ranked[1:] != ranked[:-1]).any(1)])
    code = np.empty(len(pairs), np.int64)
    code[order] = np.cumsum(new) - 1
    return ranked[new], code


def refine(group: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """How many bytes of raw are looked at, and the groups of rows that agree on group and on these bytes; from none to all.

    By digits of eight bytes, the most significant first. Rows alone in their group are not looked at
    again; what follows one digit orders the rows within what the digits before left equal.
    """
    n, width = raw.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = raw
    digits = wide.view(">u8").astype(np.uint64)
    group = group.copy()
    yield 0, group
    for d in range(digits.shape[1]):
        size = np.bincount(group, minlength=1)
        live = np.flatnonzero(size[group] > 1)
        order = live[np.lexsort((digits[live, d], group[live]))]
        g, x = group[order], digits[order, d]
        apart = g[1:] != g[:-1]
        differ = x[1:] ^ x[:-1]
        for k in range(min(8, width - 8 * d)):  # the digit's bytes one after another, in this one order
            new = np.concatenate([np.ones(min(1, len(order)), bool), apart | (differ >> np.uint64(56 - 8 * k) != 0)])
            group = group.copy()
            group[order] = len(size) + np.cumsum(new) - 1
            yield 8 * d + k + 1, group
        _, group = np.unique(group, return_inverse=True)


def _six(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _message(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["chunk", "bucket", "kind", "a", "b"])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _split(order_key: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Ranges of a sorted key that fall into each bucket."""
    b = _bucket(order_key, buckets).astype(np.int64)
    bounds = np.searchsorted(b, np.arange(buckets + 1))
    return [(k, int(bounds[k]), int(bounds[k + 1])) for k in range(buckets) if bounds[k + 1] > bounds[k]]


def _first_digit(chunk_id: int, table: pa.Table, buckets: int, hot_from: int) -> pa.Table:
    """One entry for each distinct anchor; whether several documents of the chunk have it, and whether very many do."""
    c = Chunk(table)
    order = np.argsort(c.hash, kind="stable")
    h, doc = c.hash[order], c.doc[c.of[order]]
    if not len(h):
        return _message([])
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    hot = np.diff(np.concatenate([first, [len(h)]])) > hot_from
    h = h[first]
    return _message([(chunk_id, b, 0, _six(h[i:j] >> np.uint64(16)), np.packbits(many[i:j]).tobytes() + np.packbits(hot[i:j]).tobytes()) for b, i, j in _split(h, buckets)])


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n] == 1


def _shared(bucket: int, table: pa.Table, hot_from: int) -> pa.Table:
    """To each chunk, those of its anchors that several documents have, and which of them very many have."""
    chunks, raw, flags = (table.column(c).to_pylist() for c in ("chunk", "a", "b"))
    parts = [_from_six(x) for x in raw]
    every = np.sort(np.concatenate(parts))
    twice = every[1:][every[1:] == every[:-1]]
    wide = every[hot_from:][every[hot_from:] == every[:-hot_from]] if len(every) > hot_from else every[:0]  # in more than hot_from chunks
    many = [p[_bits(f[: len(f) // 2], len(p))] for p, f in zip(parts, flags, strict=True)]
    hot = np.unique(np.concatenate([wide, *(p[_bits(f[len(f) // 2 :], len(p))] for p, f in zip(parts, flags, strict=True))]))
    found = np.unique(np.concatenate([twice, *many]))
    rows = []
    for c, p in zip(chunks, parts, strict=True):
        hit = p[_in(found, p)]
        if len(hit):
            rows.append((c, bucket, 0, _six(hit), np.packbits(_in(hot, hit)).tobytes()))
    return _message(rows)


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


class Second:
    """What a chunk knows of its shared anchors: distinct surroundings, and windows of anchors with very many."""

    def __init__(self, c: Chunk, answers: pa.Table):
        kinds, raw, bits = (answers.column(x).to_pylist() for x in ("kind", "a", "b"))
        parts = [(_from_six(a), _bits(b, len(a) // 6)) for k, a, b in zip(kinds, raw, bits, strict=True) if k == 0]
        shared = np.concatenate([np.zeros(0, np.uint64), *(p for p, _ in parts)])
        hot = np.sort(shared[np.concatenate([np.zeros(0, bool), *(x for _, x in parts)])])
        code = c.hash >> np.uint64(16)
        self.pick = np.flatnonzero(_in(np.sort(shared), code))
        self.h = c.hash[self.pick]
        self.doc = c.doc[c.of[self.pick]]
        self.sides = c.sides(self.pick)
        self.raw = np.concatenate([c.data[c.at[self.pick][:, None] + np.arange(KMER)], self.sides], 1) if len(self.pick) else np.zeros((0, ENTRY), np.uint8)
        wide = np.zeros((len(self.pick), -(-ENTRY // 8) * 8), np.uint8)
        wide[:, :ENTRY] = self.raw
        words = wide.view(np.uint64)
        key = self.h.copy()
        for k in range(words.shape[1]):
            key = K.mix(key * np.uint64(K.BASE) + words[:, k])
        # surroundings in order of the anchor's hash, then of their own: the same whatever the order of the rows
        order = np.lexsort((self.doc, key, self.h))
        first = np.flatnonzero(np.concatenate([[True], (self.raw[order][1:] != self.raw[order][:-1]).any(1)])) if len(order) else np.zeros(0, np.int64)
        self.rep = order[first]  # of each surroundings, the occurrence with the smallest doc_id
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
        h = self.h[self.rep]
        is_hot = _in(hot, h >> np.uint64(16))
        self.cold, self.hot = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)

    def windows(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Distinct windows of hot anchors, sorted, with their smallest doc_id here; by place: surroundings and number of the window."""
        rep = self.rep[self.hot]
        found = [(o, rows, w) for o, rows, w in _places(self.h[rep], self.sides[rep])]
        every = np.concatenate([np.zeros((0, 2), np.uint64), *(w for _, _, w in found)])
        doc = np.concatenate([np.zeros(0, np.int64), *(self.doc[rep][rows] for _, rows, _ in found)])
        key, code = _numbered(every)
        low = np.full(len(key), LAST)
        np.minimum.at(low, code, doc)
        bounds = np.cumsum([0, *(len(w) for _, _, w in found)])
        return key, low, [(o, self.hot[rows], code[a:b]) for (o, rows, _), a, b in zip(found, bounds, bounds[1:], strict=False)]


def _second_digit(chunk_id: int, table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """kind 1: surroundings with their smallest doc_id; kind 2: whole windows with theirs, of anchors that very many have."""
    s = Second(Chunk(table), answers)
    h, doc, raw = s.h[s.rep][s.cold], s.doc[s.rep][s.cold], s.raw[s.rep][s.cold]
    rows = [(chunk_id, b, 1, doc[i:j].tobytes(), raw[i:j].tobytes()) for b, i, j in _split(h, buckets)]
    key, low, _ = s.windows()
    rows += [(chunk_id, buckets + b, 2, key[i:j].tobytes(), low[i:j].tobytes()) for b, i, j in _split(key[:, 0], buckets)]
    return _message(rows)


def _repeated(bucket: int, table: pa.Table) -> pa.Table:
    """To each chunk: for its surroundings, the places whose windows start in a smaller document; for each of its windows, whether it does."""
    chunks, kinds, a, b = (table.column(c).to_pylist() for c in ("chunk", "kind", "a", "b"))
    if kinds[0] == 2:
        key = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in a]
        doc = [np.frombuffer(x, np.int64) for x in b]
        every, code = _numbered(np.concatenate(key))
        low = np.full(len(every), LAST)
        np.minimum.at(low, code, np.concatenate(doc))
        bounds = np.cumsum([0, *map(len, key)])
        return _message([(c, bucket, 2, np.packbits(low[code[i:j]] < d).tobytes(), b"") for c, d, i, j in zip(chunks, doc, bounds, bounds[1:], strict=False)])
    size = [len(x) // 8 for x in a]
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in a])
    raw = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, ENTRY) for x in b])
    left, right = raw[:, KMER : KMER + SIDE], raw[:, KMER + SIDE : KMER + 2 * SIDE]
    far_left, far_right = raw[:, ENTRY - 2], raw[:, ENTRY - 1]
    for _, anchor in refine(np.zeros(len(doc), np.int64), raw[:, :KMER]):
        pass
    _, anchor = np.unique(anchor, return_inverse=True)
    after = [g.astype(np.int32) for _, g in refine(anchor, right)]
    mask = np.zeros(len(doc), np.uint32)
    for o, before in refine(anchor, left):
        rows = np.flatnonzero((far_left >= o) & (far_right >= SIDE - o))
        if len(rows):
            code, first = K.distinct((before[rows].astype(np.uint64) << np.uint64(32)) | after[SIDE - o][rows].astype(np.uint64))
            low = np.full(len(first), LAST)
            np.minimum.at(low, code, doc[rows])
            mask[rows] |= (low[code] < doc[rows]).astype(np.uint32) << np.uint32(o)
    bounds = np.cumsum([0, *size])
    return _message([(c, bucket, 1, mask[i:j].tobytes(), b"") for c, i, j in zip(chunks, bounds, bounds[1:], strict=False)])


def covered(c: Chunk, answers: pa.Table, buckets: int) -> np.ndarray:
    """Whether each byte of the chunk's texts is to go."""
    s = Second(c, answers)
    if not len(s.pick):
        return np.zeros(len(c.data), bool)
    of = {(k, b): a for k, b, a in zip(*(answers.column(x).to_pylist() for x in ("kind", "bucket", "a")), strict=True) if k}
    mask = np.zeros(len(s.rep), np.uint32)
    for b, i, j in _split(s.h[s.rep][s.cold], buckets):
        mask[s.cold[i:j]] = np.frombuffer(of[1, b], np.uint32)
    key, low, places = s.windows()
    gone = np.zeros(len(key), bool)
    for b, i, j in _split(key[:, 0], buckets):
        gone[i:j] = _bits(of[2, buckets + b], j - i)
    doc = s.doc[s.rep]
    for o, rows, code in places:
        mask[rows] |= (gone[code] | (low[code] < doc[rows])).astype(np.uint32) << np.uint32(o)
    # occurrences in larger documents than the one that stands for their surroundings go whole
    mine = np.where(s.doc > doc[s.group], np.uint32(2 ** (SIDE + 1) - 1), mask[s.group])
    left, right = s.sides[:, 2 * SIDE], s.sides[:, 2 * SIDE + 1]
    edge = np.zeros(len(c.data) + 1, np.int32)
    for o in range(SIDE + 1):
        hit = ((mine >> np.uint32(o)) & np.uint32(1)).astype(bool) & (left >= o) & (right >= SIDE - o)
        start = c.at[s.pick[hit]] - o
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text binary, times long"


def _finish(table: pa.Table, answers: pa.Table, buckets: int, text: bool) -> pa.Table:
    c = Chunk(table)
    gone = covered(c, answers, buckets)
    out: list[tuple] = []
    for d in range(c.rows):
        a, b = int(c.off[d]), int(c.off[d + 1])
        mine = gone[a:b]
        if mine.any():
            edge = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
            spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
            kept = c.data[a:b][~mine].tobytes()
        else:
            spans, kept = [], c.data[a:b].tobytes()
        out.append((c.ids[d], b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans], kept if text else None, c.times[d]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.int64())
    cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text", "times")])


def removed(docs: DataFrame, text: bool = False, chunk: int = CHUNK, per_bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """A row for each row of docs: what goes, where (byte ranges), a digest of what stays, and with text=True what stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(1).cast("long").alias("times"))
    several = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_several")), "op1-several")
    repeated = not several.isEmpty()
    if repeated:  # rows of one id and text are one row and its number
        mine = docs.doc_id.eqNullSafe(several._several)
        once = docs.join(several, mine, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("times"))
        docs = written(docs.join(several, mine, "left_anti").unionByName(once), "op1-once")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    chunks, buckets = max(1, -(-size // chunk)), max(1, -(-size // per_bucket))
    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    dealt = docs.withColumn("chunk", deal)
    by_chunk = dealt.groupBy("chunk")

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return _first_digit(key[0].as_py(), table, buckets, hot)

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        return _shared(key[0].as_py(), table, hot)

    def second(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return _second_digit(key[0].as_py(), table, answers, buckets) if len(table) and len(answers) else _message([])

    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        return _repeated(key[0].as_py(), table)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _finish(table, answers, buckets, text)

    one = by_chunk.applyInArrow(first, MESSAGE).groupBy("bucket").applyInArrow(shared, MESSAGE)
    two = by_chunk.cogroup(one.groupBy("chunk")).applyInArrow(second, MESSAGE).groupBy("bucket").applyInArrow(repeated, MESSAGE)
    found = by_chunk.cogroup(one.unionByName(two).groupBy("chunk")).applyInArrow(finish, RESULT)
    if repeated:
        found = found.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_each")
    return found.drop("times")


def digest(docs: DataFrame) -> DataFrame:
    return removed(docs.select("doc_id", "text")).drop("kept_text")


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """What digest() must give, by the plainest means; for tests."""
    first: dict[bytes, int] = {}
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - LENGTH + 1):
            w = t[p : p + LENGTH]
            first[w] = min(first.get(w, i), i)
    out = []
    for (real, _), (i, t) in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - LENGTH + 1):
            if first[t[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((real, len(t), sum(gone), sum(1 for p in range(len(t)) if gone[p] and (not p or not gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return out
