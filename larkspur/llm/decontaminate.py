"""Benchmark decontamination: windows of test items looked up in whole training texts.

A benchmark item gives windows of `n` consecutive normalised words (an item of fewer words, but not
none, is one window). The windows' hashes are broadcast while the item words stay within
`most_words`, checked before anything is shipped; beyond that the windows of both sides meet in a
shuffle join instead. Every hash hit on the broadcast path is verified on the words themselves; the
join compares two independent hashes.

Defined cases: a null or empty text has no words, no hits and is clean; a null or empty item has no
window; an item with a null item_id hits like any other but is not among the items; repeated items count once for each distinct item_id; repeated document rows give one result
row each; empty tables give no hits or no rows. Columns of docs whose names hits() itself adds must be set apart first, as removed() and digest() do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .store import bounded_batches

FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
BITS = 22
MOST_WORDS = 200_000  # about 150 MB in each Python worker


class Windows:
    """The benchmark's windows: sorted hashes for lookup, texts and item numbers for verification."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.items: list[str] = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        by: dict[int, dict[int, dict[bytes, set[int]]]] = {}
        for item, text in items:
            data = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            w = K.Words(data, np.array([0, len(data)]), K.ALNUM)
            if not len(w.hash):
                continue
            size = min(n, len(w.hash))
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
            own = {number[str(item)]} if item is not None else set()  # an item without an id hits but is not named
            for k, h in enumerate(K.windows(w.hash, size).tolist()):
                by.setdefault(size, {}).setdefault(h, {}).setdefault(b" ".join(words[k : k + size]), set()).update(own)
        self.by = {size: (np.array(sorted(d), np.uint64), d) for size, d in by.items()}
        self.bloom = {}
        for size, (hashes, _) in self.by.items():
            self.bloom[size] = np.zeros(1 << BITS, bool)
            self.bloom[size][hashes >> np.uint64(64 - BITS)] = True


def scan(data: np.ndarray, off: np.ndarray, found: Windows) -> tuple[np.ndarray, np.ndarray, list[set[int]], np.ndarray, K.Words]:
    """Per document: words, hit words, items; per word: whether a window covers it."""
    low = K.LOWER[data]
    w = K.Words(low, off, K.ALNUM)
    docs = len(off) - 1
    cover = np.zeros(len(w.hash) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(docs)]
    for size, (hashes, texts) in found.by.items():
        at = K.rows_of(w.off, size)
        if not len(at):
            continue
        h = K.windows(w.hash, size)[at]
        maybe = np.flatnonzero(found.bloom[size][h >> np.uint64(64 - BITS)])
        h = h[maybe]
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        sure = hashes[place] == h
        at, h = at[maybe][sure], h[sure]
        doc = np.searchsorted(w.off, at, "right") - 1
        raw = low.tobytes() if len(at) else b""
        for p, x, d in zip(at.tolist(), h.tolist(), doc.tolist(), strict=True):
            key = b" ".join([raw[s:e] for s, e in zip(w.start[p : p + size].tolist(), w.end[p : p + size].tolist(), strict=True)])
            owners = texts[x].get(key)
            if owners is not None:
                items[d] |= owners
                cover[p] += 1
                cover[p + size] -= 1
    hit = np.cumsum(cover)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    return w.count, total[w.off[1:]] - total[w.off[:-1]], items, hit, w


def _spans(hit: np.ndarray, w: K.Words, off: np.ndarray, d: int) -> list[dict]:
    """Byte ranges of the runs of hit words of document d, in its own text."""
    mine = hit[w.off[d] : w.off[d + 1]].astype(np.int8)
    edge = np.diff(np.concatenate([[0], mine, [0]]))
    first, last = np.flatnonzero(edge == 1) + w.off[d], np.flatnonzero(edge == -1) - 1 + w.off[d]
    return [{"start": int(w.start[a] - off[d]), "end": int(w.end[b] - off[d])} for a, b in zip(first, last, strict=True)]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, most_words: int = MOST_WORDS) -> DataFrame:
    """docs' rows with n_words, n_hit, items (string item_ids, sorted) and spans (byte ranges hit)."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    if (size.b or 0) // 2 + size.n <= most_words:  # a word and what parts it from the next are two bytes at least
        return _broadcast(docs, items, n)
    return _joined(docs, items, n)


def _broadcast(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], n))
    schema = f"{_ddl(docs)}, {FIELDS}"
    names = docs.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shipped.value
        for batch in batches:
            data, off = K.utf8(batch.column(names.index("text")))
            for i, j in K.blocks(off):
                own = off[i : j + 1] - off[i]
                words, hit_words, owners, hit, w = scan(data[off[i] : off[j]], own, found)
                lists = [sorted(found.items[k] for k in x) for x in owners]
                spans = [_spans(hit, w, own, d) if n_hit else [] for d, n_hit in enumerate(hit_words.tolist())]
                extra = [pa.array(words, pa.int64()), pa.array(hit_words, pa.int64()), pa.array(lists, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*names, "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(look, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _exploded(df: DataFrame, key: list[str], lengths: list[int], whole_below: int) -> DataFrame:
    """key, number of words, and for each window its first word, length, two hashes, byte ranges of its words.

    whole_below: texts of fewer words give one window of all their words; 0: windows of every length in lengths.
    """
    names = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(names.index("text")))
            for i, j in K.blocks(off, K.BLOCK // 4):
                own = off[i : j + 1] - off[i]
                w = K.Words(K.LOWER[data[off[i] : off[j]]], own, K.ALNUM)
                other = K.mix(w.hash ^ np.uint64(0x5851F42D4C957F2D))
                for size in lengths:
                    at = K.rows_of(w.off, size)
                    doc = np.searchsorted(w.off, at, "right") - 1
                    if whole_below:
                        keep = (size == whole_below) | (w.count[doc] == size)
                        at, doc = at[keep], doc[keep]
                    if not len(at):
                        continue
                    cols = [batch.column(names.index(k)).take(pa.array(doc + i)) for k in key]
                    more = [pa.array(at - w.off[doc]), pa.array(np.full(len(at), size, np.int64)), pa.array(K.windows(w.hash, size)[at].view(np.int64)), pa.array(K.windows(other, size)[at].view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*cols, *more], [*key, "at", "size", "h1", "h2"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in key)
    return df.mapInArrow(cut, f"{kinds}, at long, size long, h1 long, h2 long")


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same for a benchmark too large to broadcast: both sides' windows meet by hash."""
    tests = _exploded(items, ["item_id"], list(range(1, n + 1)), n).select("item_id", "size", "h1", "h2").distinct()
    lengths = sorted(r.size_ for r in tests.select(F.col("size").alias("size_")).distinct().collect())
    keyed = docs.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.select("_key", "text").dropDuplicates(["_key"])
    met = _exploded(texts, ["_key"], lengths, 0).join(tests, ["size", "h1", "h2"]).groupBy("_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.collect_set(F.struct("at", "size")).alias("_at"))
    wide = keyed.join(met, "_key", "left")
    names = wide.columns
    kept = docs.columns

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(names.index("text")))
            out: list[list] = [[], [], [], []]
            for d in range(len(batch)):
                own = np.array([0, off[d + 1] - off[d]])
                w = K.Words(K.LOWER[data[off[d] : off[d + 1]]], own, K.ALNUM, hashes=False)
                mark = np.zeros(len(w.start) + 1, np.int64)
                for x in batch.column(names.index("_at"))[d].as_py() or []:
                    mark[x["at"]] += 1
                    mark[x["at"] + x["size"]] -= 1
                hit = np.cumsum(mark)[:-1] > 0
                for k, v in enumerate((len(w.start), int(hit.sum()), batch.column(names.index("items"))[d].as_py() or [], _spans(hit, w, own, 0))):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], [*kept, "n_words", "n_hit", "items", "spans"])

    return wide.mapInArrow(cover, f"{_ddl(docs)}, {FIELDS}")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    """At least a twentieth of the words, and at least one, are hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def removed(docs: DataFrame, benchmark: DataFrame, spans: bool = False, n: int = 13) -> DataFrame:
    """docs without contaminated documents; with spans=True all documents, less the hit passages of contaminated ones."""
    columns = docs.columns
    rest = [c for c in columns if c != "text"]  # kept apart, as their names may be those of the fields added
    found = hits(docs.select("text", F.struct(*rest).alias("_rest")), benchmark, n)
    back = [F.col("text") if c == "text" else F.col(f"_rest.{c}") for c in columns]
    if not spans:
        return found.where(~is_contaminated()).select(*back)

    @F.pandas_udf("string")
    def without(text, spans_, bad):  # noqa: ANN001, ANN202
        out = text.copy()
        for k in range(len(text)):
            if bad.iloc[k] and text.iloc[k] is not None:
                raw, at, left = text.iloc[k].encode(), 0, []
                for s in spans_.iloc[k]:
                    left.append(raw[at : s["start"]])
                    at = s["end"]
                out.iloc[k] = b"".join([*left, raw[at:]]).decode()
        return out

    return found.withColumn("text", without("text", "spans", is_contaminated())).select(*back)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = hits(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def brute(items: list[tuple], texts: list[str | None], n: int = 13) -> list[tuple[int, int, int, str, bool]]:
    """What digest() must give, by the plainest means; for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tests = [(str(i), word.findall((t or "").translate(low))) for i, t in items]
    out = []
    for t in texts:
        ws, hit, who = word.findall((t or "").translate(low)), set(), set()
        for i, iw in tests:
            size = min(n, len(iw))
            cuts = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if size else set()
            for p in range(len(ws) - size + 1 if size else 0):
                if tuple(ws[p : p + size]) in cuts:
                    hit |= set(range(p, p + size))
                    who.add(i)
        out.append((len(ws), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out
