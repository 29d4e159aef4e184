"""Language-model scoring with a probabilistic suffix tree.

A text is the words of its lower-cased (A-Z) text, each followed by a blank, and an end symbol; the
tree models the bytes of that sequence. Contexts of up to `depth` symbols are retained if they were
seen `least` times in training and their next-symbol counts diverge from those of the context that
is one symbol shorter (a likelihood-ratio test); retained contexts keep their suffixes. A context's
distribution is its counts plus `weight` times its suffix's distribution, down to the symbols' own
frequencies, so it sums to one and nothing has probability zero. Each symbol is scored in the state
of its longest retained suffix; a text's score is the sum over its symbols, by the tree alone.

Counts cover every training row, and name the strings of held-out rows with a count of zero. Each
task counts its own symbol strings and words before the shuffle. The tree stays distributed: one
table for each depth, tested from the longest contexts to the shortest and smoothed the other way,
until every string of `depth` + 1 symbols that occurs has its probability. The `strings` most
frequent strings and the `head` most frequent words at most are broadcast; the rest meet their
probabilities and counts in joins by value, each text's distinct ones once, so which way a string
goes changes the cost and not the score.

grow() and score() are the same tree held whole in one process, for comparison.

Defined cases: a null or empty text is the end token alone; a null doc_id is a training row; rows
that repeat count, and are scored, each for itself; texts of any length are counted and scored
whole; strings as frequent as one another are broadcast together or not at all; without training
rows every symbol is equally likely; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .store import bounded_batches, written

DEPTH = 5
LEAST = 2  # training occurrences of a context
CUT = 8.0  # log-likelihood ratio from which a context is retained
HEAD = 500_000
STRINGS = 2_000_000
WEIGHT = 6.0
END = 10  # the end symbol; no word holds it
PART = 1 << 19  # bytes of whole documents handled at once
KEPT = 1 << 20  # distinct strings that a task holds before it hands them on


@dataclass
class Tree:
    contexts: list[np.ndarray]  # by depth, sorted; the nearest symbol in the highest byte
    back: list[np.ndarray]  # log10 of the weight of the shorter context
    entries: list[np.ndarray]  # by depth, sorted: context and next symbol
    logp: list[np.ndarray]
    root: np.ndarray  # log10 probability of each symbol


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def stream(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """Symbols of all documents, each after `depth` end symbols; where each document's begin (one more than there are)."""
    low = K.LOWER[data]
    w = K.Words(low, off, K.SPACED)
    size = w.end - w.start + 1
    docs = len(off) - 1
    before = np.concatenate([[0], np.cumsum(size)])
    begin = before[w.off] + np.arange(docs + 1) * (depth + 1)
    out = np.full(int(before[-1]) + docs * (depth + 1), END, np.uint8)
    doc = w.doc()
    place = before[:-1] + doc * (depth + 1) + depth
    inside = size - 1
    total = int(inside.sum())
    step = np.arange(total) - np.repeat(np.cumsum(inside) - inside, inside)
    out[np.repeat(place, inside) + step] = low[np.repeat(w.start, inside) + step]
    out[place + inside] = 32
    return out, begin, w


def keys(s: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """Of each symbol (padding left out): context, nearest first, then the symbol, in one number."""
    key = s[depth:].astype(np.uint64)
    for d in range(1, depth + 1):
        far = s[depth - d : len(s) - d].astype(np.uint64)
        far <<= np.uint64(8 * (depth + 1 - d))
        key |= far
    own = np.ones(len(key), bool)
    own[(begin[1:-1, None] + np.arange(-depth, 0)).ravel()] = False  # the padding of all documents but the first
    return key[own[: len(key)]]


def symbol_docs(begin: np.ndarray, depth: int) -> np.ndarray:
    """The document of each symbol."""
    return np.repeat(np.arange(len(begin) - 1), np.diff(begin) - depth)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([x[0] for x in held])
    n = np.concatenate([x[1] for x in held])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n


def counts(docs: DataFrame, depth: int, learn: Column | None = None) -> DataFrame:
    """kind 0: symbol strings, 1: word hashes, 2: the end token; key and n, summed over rows to learn from (all, unless given).

    m is the count over all rows: symbol strings that only other rows hold have n = 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: [], 3: []}  # 3: symbol strings of other rows
        rows = 0

        def out(kind: int) -> pa.RecordBatch:
            k, n = _merge(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind % 3, np.int32)), pa.array(k.view(np.int64)), pa.array(n * (kind != 3), pa.int64()), pa.array(n, pa.int64())], ["kind", "key", "n", "m"])

        for batch in batches:
            learned = pc.fill_null(batch.column(1), False)
            for part, learn in ((batch.filter(learned), True), (batch.filter(pc.invert(learned)), False)):
                data, off = K.utf8(part.column(0))
                rows += len(part) * learn
                for i, j in K.blocks(off, PART):
                    s, begin, w = stream(data[off[i] : off[j]], off[i : j + 1] - off[i], depth)
                    for kind, k in ((0, keys(s, begin, depth)), (1, w.hash)) if learn else ((3, keys(s, begin, depth)),):
                        k = np.sort(k)
                        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
                        held[kind].append((k[first], np.diff(np.concatenate([first, [len(k)]])).astype(np.int32)))
                        if sum(len(x[0]) for x in held[kind]) > KEPT:
                            held[kind] = [_merge(held[kind])]
                            if len(held[kind][0][0]) > 3 * KEPT // 4:
                                yield out(kind)
        for kind in held:
            if held[kind]:
                yield out(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([rows], pa.int64()), pa.array([rows], pa.int64())], ["kind", "key", "n", "m"])

    rows = docs.select("text", (F.lit(True) if learn is None else learn).alias("learn"))
    return rows.mapInArrow(count, "kind int, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _context(key: str = "key") -> Column:
    return F.shiftrightunsigned(key, 8)


def _shorter(key: str = "key") -> Column:
    """The string without the symbol that is farthest back."""
    return F.shiftleft(F.shiftrightunsigned(key, 16), 8).bitwiseOR(F.col(key).bitwiseAND(F.lit(255)))


def probabilities(strings: DataFrame, depth: int = DEPTH, least: int = LEAST, weight: float = WEIGHT) -> DataFrame:
    """key, m and logp: log10 probability of each symbol string (key, n, m) in its longest retained state; the tree is never gathered."""
    # by depth, with `up`: how often the string without its farthest symbol was seen, a row of the level below
    levels = [strings.select("key", "n")]
    for d in range(depth, 0, -1):
        levels[0] = written(levels[0].withColumn("short", _shorter()).withColumn("up", F.sum("n").over(Window.partitionBy("short"))), f"op2-depth{d}")
        levels.insert(0, levels[0].select(F.col("short").alias("key"), F.col("up").alias("n")).distinct())
    kept: list[DataFrame] = []  # by depth, from the longest: retained contexts and how often they were seen
    for d in range(depth, 0, -1):
        n = F.col("n")
        size = levels[d].groupBy(_context().alias("c")).agg(F.sum("n").alias("size"), F.sum(F.when(n > 0, n * F.log(n / F.col("up"))).otherwise(0.0)).alias("t"))
        size = size.withColumn("up", F.sum("size").over(Window.partitionBy(_context("c")))).where(F.col("size") >= max(1, least))
        passes = F.col("t") - F.col("size") * F.log(F.col("size") / F.col("up")) >= CUT
        if kept:
            longer = kept[0].select(_context("c").alias("c"), F.lit(True).alias("longer")).distinct()
            size = size.join(longer, "c", "left")
            passes = passes | F.col("longer").isNotNull()
        kept.insert(0, written(size.where(passes).select("c", "size"), f"op2-kept{d}"))
    total = levels[0].agg(F.sum("n")).first()[0] or 0
    p = levels[0].select("key", ((F.col("n") + 0.5) / float(total + 128)).alias("p"))
    for d in range(1, depth + 1):
        level = (levels[d] if d < depth else strings.select("key", "n", "m").withColumn("short", _shorter())).withColumn("c", _context())
        level = level.join(p.withColumnRenamed("key", "short"), "short").join(kept[d - 1], "c", "left")
        own = F.when(F.col("size").isNull(), F.col("p")).otherwise((F.col("n") + weight * F.col("p")) / (F.col("size") + weight))
        p = written(level.select("key", *["m"] * (d == depth), (F.log10(own) if d == depth else own).alias("logp" if d == depth else "p")), f"op2-smooth{d}")
    return p


def grow(strings: DataFrame, total: int, depth: int = DEPTH, least: float = 0.0, weight: float = WEIGHT) -> Tree:
    """The tree, from the counts of symbol strings (key, n): contexts seen twice and in a share `least` of all symbols are candidates."""
    level = strings.select((F.col("key").bitwiseAND(F.lit(255))).alias("s"), F.shiftright("key", 8).alias("c"), "n")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(depth, -1, -1):
        if d < depth:
            level = level.select("s", F.shiftright("c", 8).alias("c"), "n").groupBy("c", "s").agg(F.sum("n").alias("n"))
        level = written(level, f"op2-depth{d}")
        often = level.groupBy("c").agg(F.sum("n").alias("all")).where(F.col("all") >= max(2, least * total)).select("c")
        t = (level.join(often, "c", "left_semi") if d else level).toArrow()
        c, s, n = (t.column(x).to_numpy() for x in ("c", "s", "n"))
        order = np.lexsort((s, c))
        found.insert(0, (c[order].astype(np.uint64), s[order].astype(np.uint64), n[order].astype(float)))
    _, s, n = found[0]
    p = np.full(256, 0.5)
    p[s.astype(np.int64)] += n
    root = p / p.sum()
    # Test each context against the one that is a symbol shorter, by raw counts; keep suffixes of what is kept.
    groups = []
    for c, s, n in found:
        ctx, first = np.unique(c, return_index=True)
        groups.append((ctx, first, np.add.reduceat(n, first) if len(n) else n))
    keep: list[np.ndarray] = [np.ones(len(groups[0][0]), bool)]
    for d in range(1, depth + 1):
        c, s, n = found[d]
        ctx, first, size = groups[d]
        if not len(ctx):
            keep.append(np.zeros(0, bool))
            continue
        pc, ps, pn = found[d - 1]
        up = np.searchsorted((pc << np.uint64(8)) | ps, ((c >> np.uint64(8)) << np.uint64(8)) | s)
        of = np.repeat(np.arange(len(ctx)), np.diff(np.concatenate([first, [len(c)]])))
        parent = np.searchsorted(groups[d - 1][0], ctx >> np.uint64(8))
        gain = n * np.log((n / size[of]) / (pn[up] / groups[d - 1][2][parent][of]))
        keep.append(np.add.reduceat(gain, first) >= CUT)
    for d in range(depth, 1, -1):
        if len(keep[d]):
            keep[d - 1][np.searchsorted(groups[d - 1][0], groups[d][0][keep[d]] >> np.uint64(8))] = True
    tree = Tree([], [], [], [], np.log10(root))
    full = [np.zeros((1, 256))]  # per depth, the smoothed distributions of retained contexts
    full[0][0] = root
    order = [np.zeros(1, np.uint64)]
    for d in range(1, depth + 1):
        c, s, n = found[d]
        ctx, first, size = groups[d]
        kept = np.flatnonzero(keep[d])
        of = np.repeat(np.arange(len(ctx)), np.diff(np.concatenate([first, [len(c)]]))) if len(ctx) else np.zeros(0, np.int64)
        row = np.full(len(ctx), -1)
        row[kept] = np.arange(len(kept))
        mine = row[of] >= 0
        parent = np.searchsorted(order[d - 1], ctx[kept] >> np.uint64(8)) if d > 1 else np.zeros(len(kept), np.int64)
        dist = (full[d - 1][parent] * (weight / (size[kept] + weight))[:, None])
        dist[row[of][mine], s[mine].astype(np.int64)] += n[mine] / (size[kept] + weight)[row[of][mine]]
        tree.contexts.append(ctx[kept])
        tree.back.append(np.log10(weight / (size[kept] + weight)))
        tree.entries.append((c[mine] << np.uint64(8)) | s[mine])
        tree.logp.append(np.log10(dist[row[of][mine], s[mine].astype(np.int64)]))
        full.append(dist)
        order.append(ctx[kept])
    return tree


def score(tree: Tree, key: np.ndarray) -> np.ndarray:
    """log10 probability of each distinct symbol string of `key` (sorted), in its longest retained state."""
    depth = len(tree.contexts)
    out = np.zeros(len(key))
    open_ = np.arange(len(key))
    symbol = key & np.uint64(255)
    for d in range(depth, 0, -1):
        ctx = key[open_] >> np.uint64(8 * (depth + 1 - d))
        have = tree.contexts[d - 1]
        if not len(have):
            continue
        at = np.minimum(np.searchsorted(have, ctx), len(have) - 1)
        state = have[at] == ctx
        entry = (ctx << np.uint64(8)) | symbol[open_]
        e = np.minimum(np.searchsorted(tree.entries[d - 1], entry), len(tree.entries[d - 1]) - 1)
        seen = state & (tree.entries[d - 1][e] == entry)
        out[open_[seen]] += tree.logp[d - 1][e[seen]]
        unseen = state & ~seen
        out[open_[unseen]] += tree.back[d - 1][at[unseen]]
        open_ = open_[~seen]
    out[open_] += tree.root[symbol[open_].astype(np.int64)]
    return out


def token_scores(tree: Tree, data: np.ndarray, off: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """The words; log10 probability of each word with its blank; of each document's end."""
    depth = len(tree.contexts)
    s, begin, w = stream(data, off, depth)
    key = keys(s, begin, depth)
    code, first = K.distinct(key)
    u = key[first]
    order = np.argsort(u)
    p = np.empty(len(u))
    p[order] = score(tree, u[order])
    docs = np.arange(len(off) - 1)
    word, end = np.arange(len(w.hash)) + w.doc(), w.off[1:] + docs
    size = np.ones(len(w.hash) + len(docs), np.int64)
    size[word] += w.end - w.start
    total = np.add.reduceat(p[code], np.cumsum(size) - size) if len(size) else np.zeros(0)
    return w, total[word], total[end]


def _floor(table: DataFrame, count: str, most: int) -> int:
    """The least count that at most `most` rows of the table reach; counts over 4096 go by powers of two."""
    n = F.col(count)
    step = F.when(n <= 4096, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long"))
    total, floor = 0, None
    for r in sorted(table.groupBy(step.alias("n")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        total += r.rows
        if total > most:
            return floor if floor is not None else 2 * r.n
        floor = r.n
    return 1


def scores(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, head: int = HEAD, strings: int = STRINGS) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text)."""
    if not 0 < depth <= 6:
        raise ValueError("a string of depth + 1 bytes and a document's number in its block share 64 bits")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id"), F.col("text"))
    found = written(counts(docs, depth, ~held_out(F.col("doc_id"))), "op2-counts")
    sums = {r["kind"]: r for r in found.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("v")).collect()}
    get = lambda k, c: int(sums[k][c]) if k in sums else 0
    ends = get(2, "n")
    tokens, types = get(1, "n") + ends, get(1, "v") + (ends > 0)
    tree = probabilities(found.where("kind = 0").select("key", "n", "m"), depth, least)
    words = found.where("kind = 1 and n > 0").select("key", "n")
    floor, bound = _floor(words, "n", head), _floor(tree, "m", strings)

    def table(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        t = df.select("key", value).toArrow()
        key = t.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        return key[order], t.column(value).to_numpy()[order]

    shipped = docs.sparkSession.sparkContext.broadcast((table(tree.where(f"m >= {bound}"), "logp"), table(words.where(f"n >= {floor}"), "n")))
    base = np.log10(ends + 1.0)

    def look(have: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the table, and its value or 0."""
        if not len(have[0]) or not len(key):
            return np.zeros(len(key), bool), np.zeros(len(key), have[1].dtype)
        at = np.minimum(np.searchsorted(have[0], key), len(have[0]) - 1)
        known = have[0][at] == key
        return known, np.where(known, have[1][at], 0)

    def lists(doc: np.ndarray, key: np.ndarray, times: np.ndarray, docs: int) -> pa.Array:
        """Of each document, its distinct keys and how often it has them."""
        order = np.argsort(doc, kind="stable")
        pairs = pa.StructArray.from_arrays([pa.array(key[order].view(np.int64)), pa.array(times[order], pa.int64())], ["key", "times"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(docs + 1)).astype(np.int32)), pairs)

    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of equal values of x begin, and their lengths."""
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        return first, np.diff(np.concatenate([first, [len(x)]]))

    def some(off: np.ndarray) -> Iterator[tuple[int, int]]:
        """Blocks of at most 256 documents, whose numbers fit a byte beside a string's key."""
        for i, j in K.blocks(off, PART):
            for k in range(i, j, 256):
                yield k, min(j, k + 256)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings_, words_ = shipped.value
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for i, j in some(off):
                s, begin, w = stream(data[off[i] : off[j]], off[i : j + 1] - off[i], depth)
                key = keys(s, begin, depth) << np.uint64(8)
                key |= symbol_docs(begin, depth).astype(np.uint64)
                del s
                key.sort()
                first, times = runs(key)  # each document's distinct strings, by string
                key = key[first]
                owner = (key & np.uint64(255)).astype(np.int64)
                key >>= np.uint64(8)
                first, alike = runs(key)
                met, logp = (np.repeat(x, alike) for x in look(strings_, key[first]))
                cols = [w.count + 1, np.full(j - i, ends > 0, np.int64), np.full(j - i, base), np.bincount(owner, logp * times, j - i)]
                lost = np.flatnonzero(~met)
                missing = lists(owner[lost], key[lost], times[lost], j - i)
                doc = w.doc()
                known, n = look(words_, w.hash)
                cols[1] += np.bincount(doc[known], minlength=j - i)
                cols[2] += np.bincount(doc[known], np.log10(n[known] + 1.0), j - i)
                order = np.lexsort((w.hash[~known], doc[~known]))
                rare, doc = w.hash[~known][order], doc[~known][order]
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([first, [len(rare)]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c) for c in cols), lists(doc[first], rare[first], times, j - i), missing], ["doc_id", "n_tokens", "known", "log_c", "score", "words", "strings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    open_ = "array<struct<key:long,times:long>>"
    every = docs.mapInArrow(whole, f"doc_id {kind}, n_tokens long, known long, log_c double, score double, words {open_}, strings {open_}")
    every = written(every.withColumn("row", F.monotonically_increasing_id()), "op2-scored")
    # what the broadcast did not settle: a row for each distinct word and string of a text
    nothing = F.lit(0.0)
    late = every.select("row", F.inline("words")).join(words.where(f"n < {floor}"), "key").select("row", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("n") + 1.0)).alias("log_c"), nothing.alias("score"))
    late = late.unionByName(every.select("row", F.inline("strings")).join(tree.where(f"m < {bound}").select("key", "logp"), "key").select("row", F.lit(0).cast("long").alias("known"), nothing.alias("log_c"), (F.col("times") * F.col("logp")).alias("score")))
    late = late.groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("known", "log_c", "score")))
    joined = every.drop("words", "strings").join(late, "row", "left")
    total = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("known", "log_c", "score")}
    return joined.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", total["known"].alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (total["log_c"] - F.col("n_tokens") * float(np.log10(tokens + types + 1))).alias("base_score"), total["score"].alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return scores(docs.select("doc_id", "text"))
