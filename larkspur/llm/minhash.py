"""Near-duplicate documents by min-max hashing over word shingles.

Each permutation of the shingle hashes gives two values, its minimum and its maximum, so half the
permutations give a signature of the same length; both estimate the Jaccard similarity without
bias. `bands` bands of `rows` values bring documents together; what shares a band is verified on
the full shingle sets.

Documents with equal shingle sets are one class (by a 128-bit digest and the size of the set), and
only one representative of each goes on. In each bucket the members are verified against the
smallest one, a star, not a clique. Links give components (see operators.graph). What buckets join
is a family; where a family has several components, pairs across them are verified too, unless
exact bounds rule them out: shingles that no other candidate has can't be common, which bounds the
size of any partner, and bitmaps of the sets bound their difference from below. This repeats until no pair is left. Nothing is capped.

At the threshold 0.85 the chance that a linked pair shares none of the 25 bands of 4 is about 1e-8, and one of
0.3 shares some with 18 %.

Defined cases: null and empty texts and those without words have no shingles, link with nothing and
are their own components; a text of fewer than `size` words has one shingle, the whole sequence;
rows that share a doc_id are one document; a null doc_id joins the class of its set, and is its
own (null) component otherwise; a text of any length is shingled whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import kernel as K
from .store import bounded_batches, written

SIZE = 3
BANDS = 25
ROWS = 4
PERCENT = 85
BITMAP = 16  # words of 64 bits
MOST_IDS = 2_000_000  # ids that may be broadcast to pick candidates' texts; beyond it a shuffle join does
_rng = np.random.default_rng(71)
TURN = _rng.integers(1, 2**63, 64, dtype=np.uint64)
SPREAD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles, document after document; offsets."""
    w = K.Words(K.LOWER[data], off, K.SPACED)
    count = w.count
    at = K.rows_of(w.off, size)
    h = [K.windows(w.hash, size)[at]] if len(at) else []
    doc = [np.searchsorted(w.off, at, "right") - 1]
    for n in range(1, size):  # the whole text as one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            h.append(K.windows(w.hash, n)[w.off[short]])
            doc.append(short)
    h, doc = np.concatenate(h) if h else np.zeros(0, np.uint64), np.concatenate(doc)
    order = np.argsort(doc, kind="stable") if size > 1 else slice(None)
    h, doc = h[order], doc[order]
    _, first = K.distinct(K.mix(h + doc.astype(np.uint64) * np.uint64(K.BASE)))
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(off)))


def signatures(h: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[document, band] keys; only for documents that have shingles."""
    some = np.flatnonzero(np.diff(off) > 0)
    begin = off[some]
    values = np.empty((len(some), bands * rows), np.uint64)
    for k in range((bands * rows + 1) // 2):
        turned = (h ^ TURN[k]) * SPREAD[k]
        turned ^= turned >> np.uint64(32)
        values[:, 2 * k] = np.minimum.reduceat(turned, begin)
        if 2 * k + 1 < bands * rows:
            values[:, 2 * k + 1] = np.maximum.reduceat(turned, begin)
    # a band takes values of different permutations
    values = values[:, np.argsort(np.arange(bands * rows) % 2, kind="stable")].reshape(len(some), bands, rows)
    key = np.full((len(some), bands), np.uint64(0))
    for r in range(rows):
        key = K.mix(key * np.uint64(K.BASE) + values[:, :, r])
    return K.mix(key + np.arange(bands, dtype=np.uint64))


def sketch(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, the digest of the set (g1, g2), and the band keys (empty without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for i, j in K.blocks(off):
                h, o = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                n = np.diff(o)
                some = n > 0
                g = np.zeros((2, j - i), np.uint64)
                if some.any():
                    g[0, some] = np.add.reduceat(K.mix(h), o[:-1][some])
                    g[1, some] = np.add.reduceat(K.mix(h ^ np.uint64(0x2545F4914F6CDD1D)), o[:-1][some])
                    keys = signatures(h, o, bands, rows).view(np.int64)
                else:
                    keys = np.zeros((0, bands), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(g[0].view(np.int64)), pa.array(g[1].view(np.int64)), lists], ["doc_id", "n_shingles", "g1", "g2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, g1 long, g2 long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id and the sorted shingle hashes of the documents in ids, one row each."""
    few = ids.count() <= MOST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for i, j in K.blocks(off):
                h, o = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                raw = [np.sort(h[a:b]).tobytes() for a, b in zip(o, o[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(raw, pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with common, the size of the intersection of their sets, and union."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(y) < len(x):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common.append(int((y[at] == x).sum()))
                union.append(len(x) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "union"])

    return both.mapInArrow(run, "a long, b long, common long, union long")


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    bounded_batches(docs.sparkSession)
    a = written(sketch(docs, size, bands, rows), "op7-sketch")
    classes = written(a.where("n_shingles > 0").groupBy("g1", "g2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min_by("bands", F.xxhash64("bands")).alias("bands")).where("id is not null"), "op7-classes")
    members = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("many")).where("many > 1")
    met = members.join(buckets.select("key", "pivot"), "key")  # band keys differ from band to band
    star = written(met.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "op7-pairs")
    ids = written(star.select(F.col("a").alias("id")).union(star.select("b")).distinct(), "op7-ids")
    sets = written(_sets(docs, ids, size).groupBy("id").agg(F.first("shingles").alias("shingles")), "op7-sets")
    done = written(_verified(star, sets), "op7-star")
    label = _labels(done, percent)
    family = None
    while True:
        if family is None:
            family = written(connected_components(star, cut=_cut).withColumnRenamed("component", "family"), "op7-family")
            family = written(family.join(_own(sets, family, label), family.node == F.col("id")).select("id", "family", "n", "m", "bits"), "op7-members")
        cross = _cross(family.join(label, family.id == label.node, "left").withColumn("component", F.coalesce("component", "id")), percent)
        cross = written(cross.join(done.select("a", "b"), ["a", "b"], "left_anti"), "op7-cross")
        if cross.isEmpty():
            break
        done = written(done.unionByName(_verified(cross, sets)), "op7-done")
        label = _labels(done, percent)
    of_class = classes.select("g1", "g2", "n_shingles", "id").join(label, classes.id == label.node, "left").select("g1", "g2", "n_shingles", F.coalesce("component", "id").alias("component"))
    shaped = a.select("doc_id", "n_shingles", "g1", "g2")
    linked = shaped.where("n_shingles > 0").join(of_class, ["g1", "g2", "n_shingles"], "left")
    out = linked.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.unionByName(shaped.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _cut(df: DataFrame) -> DataFrame:
    return written(df, "op7-cc")


def _labels(done: DataFrame, percent: int) -> DataFrame:
    links = done.where(F.col("common") * 100 >= F.col("union") * percent).select("a", "b")
    return written(connected_components(links, cut=_cut), "op7-label")


def _own(sets: DataFrame, family: DataFrame, label: DataFrame) -> DataFrame:
    """Of candidates in families of several components: id, n, m (shingles that some other candidate has too), bits.

    Each shingle flips one of 64 * BITMAP bits, so two sets differ in at least as many shingles as their bits do.
    """
    named = family.join(label.withColumnRenamed("node", "id"), family.node == F.col("id"), "left").select(family.node, "family", F.coalesce("component", family.node).alias("component"))
    several = named.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family")
    wanted = named.join(several, "family", "left_semi").select(F.col("node").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int64)), pa.array(h)], ["id", "h"])

    chosen = sets.join(wanted, "id", "left_semi")
    single = chosen.mapInArrow(run, "id long, h long").groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("u"))

    def parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column(1)]
            odd = [np.packbits(np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=64 * BITMAP) & 1).view(np.int64) for h in sets_]
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, BITMAP * len(odd) + 1, BITMAP, dtype=np.int32)), pa.array(np.concatenate(odd) if odd else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets_], pa.int64()), bits], ["id", "n", "bits"])

    size = chosen.mapInArrow(parity, "id long, n long, bits array<long>")
    return size.join(single, "id", "left").select("id", "n", "bits", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m"))


def _cross(named: DataFrame, percent: int) -> DataFrame:
    """Pairs across components of a family that sizes and shingles of their own don't rule out, each once.

    A link needs (100 + p) * common >= p * (n_x + n_y), and common is at most the m of either; so the other's
    size is at most reach = floor((100 + p) * m / p) - n. Of two linked documents the smaller thus reaches its
    own size (it is light), and the larger still reaches the smaller. Across components at most one is in the
    family's largest, so only the others look for partners, in bins of size narrow enough to make few false hits.
    Linked sets differ in at most (100 - p) / (100 + p) of n_x + n_y shingles, which their bits must allow.
    """
    p = percent
    reach = F.floor((100 + p) * F.col("m") / p).cast("long") - F.col("n")
    named = named.withColumn("reach", reach).withColumn("least", F.ceil(F.col("n") * p / 100).cast("long")).where("reach >= least")
    sizes = named.groupBy("family", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("family").agg(F.max_by("component", F.struct("k", -F.col("component"))).alias("largest"), F.count("*").alias("parts")).where("parts > 1").select("family", "largest")
    named = written(named.join(largest, "family"), "op7-named")
    bin_ = lambda c: F.floor(F.log(c) * 64).cast("long")
    y = named.where("component <> largest").select("family", F.col("id").alias("y"), F.col("component").alias("c_y"), F.col("n").alias("n_y"), F.col("reach").alias("r_y"), "least", F.col("bits").alias("b_y"))
    x = named.select("family", F.col("id").alias("x"), F.col("component").alias("c_x"), F.col("n").alias("n_x"), F.col("reach").alias("r_x"), F.col("bits").alias("b_x"), bin_(F.col("n")).alias("bin"))

    def met(low, high, among: DataFrame, of: DataFrame) -> DataFrame:  # noqa: ANN001
        spread = of.withColumn("lo", low).withColumn("hi", high).where("lo <= hi").withColumn("bin", F.explode(F.sequence(bin_(F.col("lo")), bin_(F.col("hi")))))
        differ = sum((F.bit_count(F.get("b_x", F.lit(k)).bitwiseXOR(F.get("b_y", F.lit(k)))) for k in range(BITMAP)), F.lit(0))
        close = differ * (100 + p) <= (F.col("n_x") + F.col("n_y")) * (100 - p)
        return spread.join(among, ["family", "bin"]).where(F.expr("c_x <> c_y and n_x between lo and hi and n_y <= r_x") & close).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))

    below = met(F.col("least"), F.least("n_y", "r_y"), x.where("r_x >= n_x"), y)
    above = met(F.col("n_y"), F.least("r_y", F.floor(F.col("n_y") * 100 / p).cast("long")), x, y.where("r_y >= n_y"))
    return below.unionByName(above).distinct()


NO_ID = 1 << 62  # ids from here on stand for rows whose doc_id is null or on several rows


def _identified(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with `_id`, one for each row: its doc_id, or where that is null or on several rows, a large number by the row's hash."""
    several = written(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").select(F.col("doc_id").alias("_several"), F.lit(True).alias("_odd")), "op7-odd")
    own = F.col("doc_id").cast("long")
    if several.isEmpty():
        return docs.withColumn("_id", own), False
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(*docs.columns), 2)
    met = docs.join(several, docs.doc_id.eqNullSafe(several._several), "left")
    return met.withColumn("_id", F.when(F.col("_odd"), stand_in).otherwise(own)).drop("_several", "_odd"), True


def deduplicated(docs: DataFrame, **kwargs: int) -> DataFrame:
    """docs with one row of each component, the smallest doc_id's where all have one.

    Each row counts for itself, whether its doc_id is null or on several rows; of rows that repeat entirely one stays.
    """
    rows, odd = _identified(docs)
    gone = components(rows.select(F.col("_id").alias("doc_id"), "text"), **kwargs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = rows.join(gone, rows._id == gone._gone, "left_anti")
    if not odd:
        return left.drop("_id")
    repeated = left.where(F.col("_id") >= NO_ID).groupBy("_id").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return left.where(F.col("_id") < NO_ID).drop("_id").unionByName(repeated)


def digest(docs: DataFrame) -> DataFrame:
    return components(docs.select("doc_id", "text"))
