"""Conflict-constrained best-fit packing.

Pieces go, longest first, into the tightest bin that has room and holds neither their source nor
their duplicate cluster. Bins are kept in order of residual capacity with a bitmap of sources and
one of clusters; the search begins at the successor of the piece's length and walks on until a
compatible bin is found, else opens one. A document longer than a bin is split losslessly into
full pieces and a rest, which conflict with each other by source.

Rows are dealt at random (by a hash of the whole row, so that no source, cluster or id gathers
anywhere) over shards of about `per_shard` documents; each shard is packed on its own. Copies that
land in different shards can't meet, so the constraint holds everywhere, and memory is bounded
whatever the input. `size` is any positive measure; the query takes words.

Defined cases: null and empty texts have size 0 and appear in no bin; a null source or cluster
conflicts with nothing; a null doc_id is packed and listed as null; repeated rows are packed each
for itself (they share a cluster, so never a bin); an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exactdedup import normalised

CAPACITY = 2048
PER_SHARD = 4096
SCHEMA = "shard long, bin long, used long, capacity long, doc_ids array<long>, parts array<long>, starts array<long>, sizes array<long>, sources array<string>"


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[int]]:
    """Bins as lists of piece numbers. A piece: size, source bit or 0, cluster bit or 0 (each a power of two)."""
    order = sorted(range(len(pieces)), key=lambda k: -pieces[k][0])
    room: list[tuple[int, int]] = []  # (residual, bin), ascending
    bins: list[list[int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    for k in order:
        size, source, cluster = pieces[k]
        at = bisect_left(room, (size, -1))
        while at < len(room) and (sources[room[at][1]] & source or clusters[room[at][1]] & cluster):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            sources.append(0)
            clusters.append(0)
        bins[b].append(k)
        sources[b] |= source
        clusters[b] |= cluster
        if left > size:  # a full bin needs no further look
            insort(room, (left - size, b))
    return bins


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def packed(docs: DataFrame, size: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per bin: its documents in the order packed, the part of each (0 unless split), where it starts, its size."""
    size = words() if size is None else size
    cluster = F.xxhash64(normalised()) if cluster is None else cluster
    rows = docs.count()
    shards = max(1, -(-rows // per_shard))
    narrow = docs.select(
        F.pmod(F.xxhash64("doc_id", "source", "text"), F.lit(shards)).alias("shard"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), cluster.alias("cluster"), size.cast("long").alias("size"),
    ).where("size > 0")

    def one(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["cluster"] or 0, r["size"], r["source"] is None, r["cluster"] is None) for b in batches for r in b.to_pylist())
        times = Counter(r[3] for r in rows)
        source_bit: dict[str, int] = {}
        cluster_bit: dict[int, int] = {}
        pieces, of = [], []
        for no_id, doc, source, cl, size_, no_source, no_cluster in rows:
            s = 0 if no_source else source_bit.setdefault(source, 1 << len(source_bit))
            c = 0 if no_cluster or times[cl] < 2 else cluster_bit.setdefault(cl, 1 << len(cluster_bit))
            for part, at in enumerate(range(0, size_, capacity)):
                pieces.append((min(capacity, size_ - at), s, c))
                of.append((None if no_id else doc, part, None if no_source else source))
        out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
        for b, members in enumerate(pack(pieces, capacity)):
            sizes = [pieces[k][0] for k in members]
            starts = [sum(sizes[:i]) for i in range(len(sizes))]
            for name, v in zip(out, (shard, b, sum(sizes), capacity, [of[k][0] for k in members], [of[k][1] for k in members], starts, sizes, [of[k][2] for k in members]), strict=True):
                out[name].append(v)
        longs = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), longs, longs, longs, longs, pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return narrow.groupBy("shard").applyInArrow(one, SCHEMA)
