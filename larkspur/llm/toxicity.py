"""Toxicity by class-conditional Kneser-Ney models.

For each class an interpolated Kneser-Ney model over words. Every count is a continuation count (of
different preceding words), so that a passage copied many times counts once. Pairs back off to the
class's words, these to the class's stems (leading bytes), and those to counts that the classes
share: the words of both together, and a uniform share for words never seen. The classes keep
estimates of their own for the expressions whose counts differ (`LEAST`, `G_LEAST`, `FACTOR`); the
mass of all others goes to the shared counts, the same on either side, so they move a text's score
only as far as the classes' whole shares differ. With own estimates for every expression the
chance differences of rare words, and those of the languages' shares in the classes, outweigh a few
toxic words in a long text (figures in the README).

The mean per word of the two log-likelihoods' difference is the evidence; a logistic curve fitted on
labelled rows kept out of the counts turns it into a score.

Fitted on as many labelled rows of each class, the first by a hash of the id, of which each class has
at most `fit_rows` and together at most `fit_bytes` of text (never the held-out fifth). These two
documented bounds are the only ones, and bound the model: a word and a pair take two bytes of the
sample at least. Every word of every whole text, of any length, is scored.

Defined cases: an empty or null text has evidence 0; null labels are not learned; a document with
several labels counts as toxic if one of them says so; of several rows with a labelled id the one
whose text sorts last is learned from; equal hashes of ids are taken in the order of the ids; without
a labelled row of each class every score is 0; repeated rows get equal scores; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .store import bounded_batches, written

FIT_ROWS = 10_000  # of each class
FIT_BYTES = 128 << 20
# an estimate of its own: so many occurrences, so large a G statistic of the class difference, and rates that differ by this factor
LEAST, G_LEAST, FACTOR = 4, 9.0, 4.0
STEM = 5  # leading bytes of a word
START = np.uint64(0x5EED5EED5EED5EED)  # stands before a text's first word


@dataclass
class Model:
    word: np.ndarray  # sorted hashes of all words
    unigram: np.ndarray  # [word, class] probability by words, stems and shared counts
    stem: np.ndarray  # sorted hashes
    of_stem: np.ndarray  # [stem, class] probability of a word never seen, by its stem
    unseen: np.ndarray  # [class] probability of a word never seen whose stem is not listed
    context: np.ndarray  # sorted hashes of words that listed pairs begin with
    back: np.ndarray  # [context, class] weight of the words after this word
    pair: np.ndarray  # sorted hashes
    bigram: np.ndarray  # [pair, class] discounted probability
    slope: float = 1.0
    shift: float = 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the hash before each, the hash of the pair, and that of the stem."""
    low = K.LOWER[data]
    w = K.Words(low, off, K.ALNUM)
    before = np.empty_like(w.hash)
    before[1:] = w.hash[:-1]
    before[w.off[:-1][w.count > 0]] = START
    stem = np.zeros_like(w.hash)
    size = w.end - w.start
    for k in range(STEM):
        more = size > k
        stem[more] = stem[more] * np.uint64(257) + low[w.start[more] + k] + np.uint64(1)
    return w, before, K.mix(before * np.uint64(K.BASE) + w.hash), K.mix(stem)


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int) -> DataFrame:
    """text and toxic of the labelled, not held-out rows to learn from; fold 0 is for the curve."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    key = F.xxhash64("doc_id")
    has = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    fit_rows = min(fit_rows, has.get(0, 0), has.get(1, 0))  # as many of each class, so that frequent words compare
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(key, "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.max("text").alias("text"))
    first = Window.partitionBy("toxic").orderBy(key, "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of two classes, fit_rows rows each
    return rows.withColumn("bytes", F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(first)).where(F.col("bytes") * 2 <= fit_bytes).select("text", "toxic", "fold")


def _counts(sample: DataFrame) -> DataFrame:
    """Word pairs with their words, stem, and by class the number of different words that precede them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            data, off = K.utf8(batch.column(0))
            for i, j in K.blocks(off):
                w, before, pair, stem = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(pair):
                    continue
                c = toxic[i:j][w.doc()]
                first = np.full_like(pair, START)
                first[1:] = pair[:-1]
                first[w.off[:-1][w.count > 0]] = START
                triple = K.mix(first + w.hash * np.uint64(K.BASE) + c.astype(np.uint64))
                _, at = K.distinct(triple)
                cols = [c[at].astype(np.int32)] + [x[at].view(np.int64) for x in (triple, pair, before, w.hash, stem)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["toxic", "triple", "pair", "v", "w", "stem"])

    raw = sample.select("text", "toxic").mapInArrow(count, "toxic int, triple long, pair long, v long, w long, stem long")
    once = raw.groupBy("triple").agg(*[F.first(c).alias(c) for c in ("toxic", "pair", "v", "w", "stem")])
    return once.groupBy("pair").agg(*[F.first(c).alias(c) for c in ("v", "w", "stem")], F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))


def _discount(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Kneser and Ney's estimate from the numbers of entries seen once and twice."""
    return np.where(one + two > 0, np.clip(one / np.maximum(one + 2 * two, 1), 0.05, 0.95), 0.5)


def _differs(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Entries seen often enough whose class counts a G test and the ratio of rates tell from the classes' sizes."""
    total = n.sum(1)
    expect = total[:, None] * size / size.sum()
    g = 2 * np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(expect, 1e-300)), 0.0).sum(1)
    ratio = (n[:, 1] + 0.5) * size[0] / ((n[:, 0] + 0.5) * size[1])
    return (total >= LEAST) & (g >= G_LEAST) & ((ratio > FACTOR) | (ratio < 1 / FACTOR))


def _own(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have estimates of their own, and [entry, class] their discounted shares (0 for the others)."""
    size = n.sum(0)
    listed = _differs(n, size)
    return listed, np.where(listed[:, None], np.maximum(n - _discount((n == 1).sum(0), (n == 2).sum(0)), 0) / size, 0.0)


def _arrays(df: DataFrame, *keys: str) -> list[np.ndarray]:
    """The key columns as hashes, and [row, class] counts."""
    t = df.select(*keys, "n0", "n1").toArrow()
    return [*(t.column(k).to_numpy().view(np.uint64) for k in keys), np.stack([t.column(c).to_numpy().astype(float) for c in ("n0", "n1")], 1)]


def interpolated(pairs: DataFrame) -> Model | None:
    """The model of pairs (pair, v, w, stem, n0, n1); only words and the pairs that differ leave the cluster."""
    seen = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("n0", "n1")]
    word, of_word, words = _arrays(pairs.groupBy("w").agg(F.first("stem").alias("stem"), *seen), "w", "stem")
    if not words.sum(0).all():
        return None
    order = np.argsort(word)
    word, of_word, words = word[order], of_word[order], words[order]
    # what the classes share: the words of both together, and a uniform share that one word never seen has too
    both = words.sum(1)
    d = float(_discount((both == 1).sum(), (both == 2).sum()))
    uniform = d * len(word) / both.sum() / (len(word) + 1)
    shared = (both - d) / both.sum() + uniform
    stems, of = np.unique(of_word, return_inverse=True)
    ends = np.stack([np.bincount(of, words[:, c], len(stems)) for c in (0, 1)], 1)
    listed, own = _own(ends)
    stems, own = stems[listed], own[listed]
    at, ok = _find(stems, of_word)
    kinds = np.bincount(at[ok], minlength=len(stems))  # words of each listed stem, and one never seen
    by_stem = own / (kinds[:, None] + 1.0)
    rest = 1 - own.sum(0)
    lower = rest * shared[:, None] + (np.where(ok[:, None], by_stem[at], 0.0) if len(stems) else 0.0)
    _, own = _own(words)
    rest_of_words = 1 - own.sum(0)
    unigram = own + rest_of_words * lower
    unseen = rest_of_words * rest * uniform
    of_stem = rest_of_words * by_stem + unseen
    # pairs: discounted shares of what follows their first word
    once = [F.sum((F.col(c) == k).cast("long")).alias(f"{c}_{k}") for k in (1, 2) for c in ("n0", "n1")]
    sums = pairs.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *once).first()
    size = np.array([sums["n0"], sums["n1"]], float)
    total = F.col("n0") + F.col("n1")
    ratio = (F.col("n1") + 0.5) * size[0] / ((F.col("n0") + 0.5) * size[1])
    some = pairs.where((total >= LEAST) & ((ratio > FACTOR) | (ratio < 1 / FACTOR)))
    pair, v, n = _arrays(some, "pair", "v")
    listed = _differs(n, size)
    pair, v, n = pair[listed], v[listed], n[listed]
    heads = pairs.sparkSession.createDataFrame([(int(x),) for x in np.unique(v).view(np.int64)], "v long")
    context, follows = _arrays(pairs.join(F.broadcast(heads), "v", "left_semi").groupBy("v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "v")
    order = np.argsort(context)
    context, follows = context[order], follows[order]
    after = np.searchsorted(context, v)
    discount = _discount(np.array([sums["n0_1"], sums["n1_1"]], float), np.array([sums["n0_2"], sums["n1_2"]], float))
    bigram = np.maximum(n - discount, 0) / np.maximum(follows[after], 1)
    back = np.ones_like(follows)
    np.subtract.at(back, after, bigram)
    order = np.argsort(pair)
    return Model(word, unigram, stems, of_stem, unseen, context, back, pair[order], bigram[order])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model | None:
    bounded_batches(docs.sparkSession)
    sample = written(_sample(docs, labels, fit_rows, fit_bytes), "op3-sample")
    model = interpolated(written(_counts(sample.where("fold > 0")), "op3-pairs"))
    if model is not None:
        _curve(model, sample.where("fold = 0"))
    return model


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def evidence(m: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per document: mean over its words of log P(word | toxic) - log P(word | ordinary)."""
    docs = len(off) - 1
    w, before, pair, stem = _tokens(data, off)
    if not len(w.hash):
        return np.zeros(docs)
    code, first = K.distinct(pair)  # a pair's probability is worked out once a block

    def of(keys: np.ndarray, values: np.ndarray, x: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        at, ok = _find(keys, x[first])
        return np.where(ok[:, None], values[at], other) if len(keys) else np.broadcast_to(other, (len(first), 2))

    p = of(m.word, m.unigram, w.hash, of(m.stem, m.of_stem, stem, m.unseen))
    p = np.log(of(m.pair, m.bigram, pair, 0.0) + of(m.context, m.back, before, 1.0) * p)
    gain = np.bincount(w.doc(), (p[:, 1] - p[:, 0])[code], docs)
    return gain / np.maximum(w.count, 1)


def _curve(model: Model, rows: DataFrame) -> None:
    """Fit slope and shift on rows that the counts have not seen."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(0))
            for i, j in K.blocks(off):
                yield pa.RecordBatch.from_arrays([pa.array(evidence(shipped.value, data[off[i] : off[j]], off[i : j + 1] - off[i])), batch.column(1).slice(i, j - i)], ["x", "y"])

    got = rows.select("text", "toxic").mapInArrow(look, "x double, y int").toArrow()
    model.slope, model.shift = logistic(got.column("x").to_numpy(), got.column("y").to_numpy())


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, classes weighing equally, with a little shrinkage."""
    if len(x) < 4 or not 0 < y.sum() < len(y):
        return 50.0, 0.0
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - 0.01 * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) and evidence for every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("evidence"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for i, j in K.blocks(off):
                x = evidence(m, data[off[i] : off[j]], off[i : j + 1] - off[i])
                score = 1 / (1 + np.exp(-np.clip(m.slope * x + m.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array(x)], ["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, score double, evidence double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = predict(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
