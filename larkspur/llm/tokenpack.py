"""Token ids packed best-fit-decreasing into matrices, with segment lengths and position resets.

Texts are cut into the tokenizer's pieces (a byte-level BPE's usual word pattern) over the bytes of
many documents at once; each distinct piece is encoded once per task and looked up afterwards. Each
document ends with the end-of-text id. A document longer than a row of the matrix is split
losslessly into full rows and a rest; pieces are placed longest first into the fullest row that
still has room for them, which a segment tree over residual capacities finds in logarithmic time.

Each task packs as it reads, in groups of about `group_tokens` tokens, so nothing is shuffled and
memory is bounded whatever the partition. A row holds `capacity` ids, padded with the end-of-text
id; `cu_seqlens` are its cumulative segment lengths (the last one is where padding starts), and
`resets` the places where positions return to 0: each segment's first, and the padding's if any. Parts of one document carry their number; unpack() restores the
documents from any order of rows.

Defined cases: a null or empty text is the end-of-text id alone; a null doc_id is listed as null;
repeated rows are packed each for itself; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .store import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
GROUP_TOKENS = 4_000_000
CACHE = 1_000_000  # distinct pieces that a task remembers before it starts anew
#: fixed values: the contractions that the piece pattern names
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SCHEMA = "doc_ids array<long>, parts array<int>, cu_seqlens array<int>, resets array<int>, ids binary"


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Ids of whole texts, a block of documents at a time; remembers the pieces it has seen."""

    def __init__(self, vocabulary: dict[bytes, int]):
        import tiktoken

        self.vocabulary = vocabulary
        self.bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary, special_tokens={})
        self.end = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if self.end < 1 << 16 else np.uint32
        self.known: dict[bytes, list[int]] = {}

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece: its own, if it is in the vocabulary, else by merges over its characters."""
        whole = self.vocabulary.get(raw)
        return [whole] if whole is not None else self.bpe.encode_ordinary(raw.decode())

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, each with its end; offsets."""
        start = piece_starts(data, off)
        size = np.diff(np.concatenate([start, [len(data)]]))
        docs = len(off) - 1
        if not len(start):
            return np.full(docs, self.end, self.dtype), np.arange(docs + 1)
        code, first = same_pieces(data, start, size)
        if len(self.known) > CACHE:
            self.known.clear()
        raw, known = data.tobytes(), self.known
        lists = []
        for a, n in zip(start[first].tolist(), size[first].tolist(), strict=True):
            piece = raw[a : a + n]
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self.piece(piece)
            lists.append(ids)
        many = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), self.dtype, int(many.sum()))
        begin = np.cumsum(many) - many
        n = many[code]
        stop = np.concatenate([[0], np.cumsum(n)])
        at = np.searchsorted(start, off)  # first piece of each document
        # the end id of document d goes after the ids of its pieces
        doc_off = stop[at] + np.arange(docs + 1)
        out = np.full(int(stop[-1]) + docs, self.end, self.dtype)
        shift = np.repeat(np.repeat(np.arange(docs), np.diff(at)), n)
        out[np.arange(int(stop[-1])) + shift] = flat[np.repeat(begin[code] - stop[:-1], n) + np.arange(int(stop[-1]))]
        return out, doc_off


def same_pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each piece, equal for equal bytes, and where each number first stands; hashes propose, bytes decide."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(K.BYTE_CODE[data] * K.powers(K.BASE, len(data)), out=total[1:])
    h = (total[start + size] - total[start]) * K.powers(K.BASE_INV, len(data) + 1)[start]
    code, first = K.distinct(K.mix(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    like = first[code]
    same = size == size[like]
    at = np.arange(int(size.sum())) - np.repeat(start, size)  # the pieces cover the data in order
    there = np.repeat(np.where(same, start[like], start), size) + at
    if not (same.all() and (data[there] == data).all()):  # two pieces with one hash: number them by their bytes
        raw = data.tobytes()
        names: dict[bytes, int] = {}
        code = np.array([names.setdefault(raw[a : a + n], len(names)) for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        first = np.unique(code, return_index=True)[1]
    return code, first


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = K.classes(data)
    kind[kind == K.MARK] = K.OTHER
    head = (data & 0xC0) != 0x80  # first bytes of characters
    first_of_doc = np.zeros(n + 1, bool)
    first_of_doc[off] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | first_of_doc[1:n]
    run = np.flatnonzero(change)
    stop = np.concatenate([run[1:], [n]])
    white = kind[run] == K.SPACE
    begins = np.zeros(n + 1, bool)
    begins[run] = True
    # of a white run that something follows in its document, the last character stands apart ...
    more = white & ~first_of_doc[stop]
    last = stop[more] - 1
    for _ in range(3):
        last = np.where(head[last], last, last - 1)
    begins[last] = True
    # ... and joins what follows if it is a blank
    blank = data[last] == 32
    begins[stop[more][blank]] = False
    # a lone apostrophe that no blank precedes takes the letters of a contraction
    lone = run[(data[run] == 39) & (stop - run == 1) & (stop < n)]
    lone = lone[begins[lone] & ~first_of_doc[lone + 1]]
    taken = np.zeros(len(lone), np.int64)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    ends = np.concatenate([np.flatnonzero(first_of_doc[1:]) + 1])
    room = ends[np.searchsorted(ends, lone, "right")] - lone if len(lone) else taken
    for c in CONTRACTIONS:
        ok = (room >= len(c)) & (taken == 0)
        for k, ch in enumerate(c.encode()):
            ok &= padded[np.minimum(lone + k, n)] == ch
        taken[ok] = len(c)
    cut = taken > 0
    begins[lone[cut] + 1] = False
    after = lone[cut] + taken[cut]
    begins[after] = True
    begins[lone] = True
    return np.flatnonzero(begins[:n])


class Tree:
    """A segment tree over residual capacities: which residuals some open row has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.has = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, residual: int, row: int) -> None:
        self.rows[residual].append(row)
        i = residual + self.leaves
        while i and not self.has[i]:
            self.has[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (residual, row) of the least residual that is at least size."""
        i = size + self.leaves
        has = self.has
        if not has[i]:
            while i > 1 and (i & 1 or not has[i + 1]):  # up, to the nearest right sibling that has something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if has[2 * i] else 2 * i + 1
        residual = i - self.leaves
        row = self.rows[residual].pop()
        if not self.rows[residual]:
            has[i] = 0
            i >>= 1
            while i and not (has[2 * i] or has[2 * i + 1]):
                has[i] = 0
                i >>= 1
        return residual, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers; equal sizes in their given order."""
    tree = Tree(capacity)
    rows: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        residual, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(k)
        if residual > sizes[k]:
            tree.add(residual - sizes[k], row)
    return rows


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per row of the matrix: doc_ids and parts of its segments, cu_seqlens, ids (little-endian, 2 or 4 bytes each)."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        held: list[tuple[int | None, int, np.ndarray]] = []
        total = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = K.utf8(batch.column(1))
            for i, j in K.blocks(off):
                tokens, begin = encoder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                bounds = begin.tolist()
                for d in range(j - i):
                    for part, a in enumerate(range(bounds[d], bounds[d + 1], capacity)):
                        held.append((ids[i + d], part, tokens[a : min(a + capacity, bounds[d + 1])]))
                total += len(tokens)
                if total >= group_tokens:
                    yield _rows(held, capacity, encoder)
                    held, total = [], 0
        if held:
            yield _rows(held, capacity, encoder)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _rows(held: list, capacity: int, encoder: Encoder) -> pa.RecordBatch:
    rows = best_fit_decreasing([len(x[2]) for x in held], capacity)
    matrix = np.full((len(rows), capacity), encoder.end, np.dtype(encoder.dtype).newbyteorder("<"))
    doc_ids, parts, cumulative, resets = [], [], [], []
    for r, members in enumerate(rows):
        at = 0
        bounds = [0]
        for k in members:
            piece = held[k][2]
            matrix[r, at : at + len(piece)] = piece
            at += len(piece)
            bounds.append(at)
        doc_ids.append([held[k][0] for k in members])
        parts.append([held[k][1] for k in members])
        cumulative.append(bounds)
        resets.append(bounds if at < capacity else bounds[:-1])
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.list_(pa.int64())), pa.array(parts, ints), pa.array(cumulative, ints), pa.array(resets, ints), pa.array([m.tobytes() for m in matrix], pa.binary())], ["doc_ids", "parts", "cu_seqlens", "resets", "ids"])


def positions(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Position ids of a row: from 0 within each segment, and 0 in the padding."""
    out = np.zeros(capacity, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def write(packed_rows: DataFrame, path: str) -> None:
    """Write the matrix rows, with their cumulative lengths and position resets, as Parquet."""
    packed_rows.write.mode("overwrite").parquet(path)


def unpack(rows: list, dtype: type = np.uint16) -> dict:
    """doc_id to ids (the end id included), from collected rows; for tests and small reads."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype)
        for d, p, a, b in zip(r["doc_ids"], r["parts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(d, {})[p] = ids[a:b]
    return {d: np.concatenate([x[k] for k in sorted(x)]) for d, x in parts.items()}
