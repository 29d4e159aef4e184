"""Cosine distances of dense vectors, a tile of one block against another at a time.

Every pair of a block is compared: vectors are dealt over tiles by a hash of their id, and each pair of tiles
is one group, in which a matrix product finds the pairs that may be near; only those are summed exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import forest

TILE, TILES = 2048, 64  # vectors of a tile; tiles of a block at most, as each vector is sent to each of them
ROWS = 512  # rows of a tile multiplied at once


def below(most: float, digits: int) -> float:
    """The least distance that rounds, half up, to more than most, a number of at most so many digits."""
    return float(Decimal(repr(float(most))) + Decimal(5).scaleb(-digits - 1))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles; nulls and what a shorter list lacks count as 0, for they add nothing to a sum."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _near(m: np.ndarray, first: np.ndarray, second: np.ndarray, limit: float, same: bool):
    """i, j, distance < limit, for i of first and j of second (both rows of m); the sums run in the order of the elements."""
    square = np.zeros(len(m))
    for k in range(m.shape[1]):
        square += m[:, k] * m[:, k]
    norm = np.sqrt(square)
    with np.errstate(all="ignore"):
        unit = m / norm[:, None]
        other = unit[second].T.copy()
        for at in range(0, len(first), ROWS):
            rows = first[at : at + ROWS]
            x, y = np.nonzero(unit[rows] @ other > 1 - limit - 1e-9)
            if same:
                x, y = x[keep := at + x < y], y[keep]
            i, j = rows[x], second[y]
            dot = np.zeros(len(i))
            for k in range(m.shape[1]):
                dot += m[i, k] * m[j, k]
            distance = 1 - dot / (norm[i] * norm[j])
            yield i[keep := distance < limit], j[keep], distance[keep]


def _tiled(vectors: DataFrame, block: str, uid: str, vector: str, one: Callable, kind: str) -> DataFrame:
    v = vectors.select(F.col(block).alias("_block"), F.col(uid).alias("_id"), F.col(vector).alias("_e")).where("_block is not null and _id is not null and size(_e) > 0")
    sizes = v.groupBy("_block").agg(F.least(F.lit(TILES), F.ceil(F.count("*") / TILE)).cast("int").alias("_n"))
    mine = v.join(F.broadcast(sizes), "_block").withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    met = mine.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_lo", F.least("_tile", "_other")).withColumn("_hi", F.greatest("_tile", "_other"))
    return met.select("_block", "_lo", "_hi", "_tile", "_id", "_e").groupBy("_block", "_lo", "_hi").applyInArrow(one, kind)


def _group(limit: float, a: str, b: str, links: bool) -> Callable:
    def one(t: pa.Table) -> pa.Table:
        m, ids, tile = _matrix(t["_e"]), t["_id"].combine_chunks(), t["_tile"].to_numpy()
        same = t["_lo"][0].as_py() == t["_hi"][0].as_py()
        first, second = np.nonzero(tile == t["_lo"][0].as_py())[0], np.nonzero(tile == t["_hi"][0].as_py())[0]
        name = ids.to_numpy(zero_copy_only=False)
        found, root = [], np.arange(len(m))
        for i, j, d in _near(m, first, second, limit, same):
            keep = name[i] != name[j]
            i, j, d = i[keep], j[keep], d[keep]
            if links:
                root = forest(len(m), np.concatenate([i, np.arange(len(m))]), np.concatenate([j, root]))
            else:
                turned = name[i] > name[j]
                found.append((np.where(turned, j, i), np.where(turned, i, j), d))
        if links:
            i = np.nonzero(root < np.arange(len(m)))[0]
            return pa.table({a: ids.take(pa.array(i)), b: ids.take(pa.array(root[i]))})
        i, j, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.float64 if k == 2 else np.int64) for k in range(3))
        return pa.table({a: ids.take(pa.array(i)), b: ids.take(pa.array(j)), "distance": pa.array(d)})

    return one


def pairs(vectors: DataFrame, most: float, block: str = "label", uid: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """a, b, distance: all pairs of one block whose cosine distance, rounded to so many digits, is at most `most`, a < b."""
    kind = dict(vectors.dtypes)[uid]
    return _tiled(vectors, block, uid, vector, _group(below(most, digits), "a", "b", False), f"a {kind}, b {kind}, distance double").withColumn("distance", F.round("distance", digits))


def links(vectors: DataFrame, most: float, block: str = "label", uid: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """a, b: of those pairs no more than keep together what they hold together, so that components are the same."""
    kind = dict(vectors.dtypes)[uid]
    return _tiled(vectors, block, uid, vector, _group(below(most, digits), "a", "b", True), f"a {kind}, b {kind}")
