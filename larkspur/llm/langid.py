"""Language identification of mixed-language text, word by word.

Each word's script narrows the candidates to languages that were seen to use it; hashed byte
trigrams of the word (with its ends marked) score the candidates; a Viterbi pass over the words with
a penalty for switching labels spans. A text's language is the one that most of its letters are
labelled with, and its score the share of letters so labelled.

Fitted on rows with a language, about `fit_rows` at most of each language, by a hash of the row; a
language with fewer rows is learned from all of them. Counts are summed in the cluster, and the
model is one number per language and bucket, so its size does not depend on the data. Labels cover every word of every whole text.

Defined cases: a null text or one without letters is `und` with score 0; without any learned
language every text is `und`; letters of a script that no language was seen to use weigh against
the score; null languages are not learned; repeated rows give repeated results; equal scores go to
the language that sorts first; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .store import bounded_batches

BUCKETS = 1 << 16
FIT_ROWS = 8_000  # of each language
PENALTY = 8.0
UNKNOWN = "und"
#: fixed values: first code points of script ranges, and the script that begins there
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
)
NAMES = sorted({s for _, s in SCRIPTS})
_FIRST = np.array([c for c, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS], np.int64)
LATIN = NAMES.index("latin")


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # [bucket, language], float32
    uses: np.ndarray  # [script, language], bool


def words(data: np.ndarray, off: np.ndarray) -> tuple[K.Words, np.ndarray]:
    """Words of letters and marks, and their bytes with all else blank."""
    kind = K.classes(data)
    low = np.where((kind == K.LETTER) | (kind == K.MARK), K.LOWER[data], np.uint8(32))
    return K.Words(low, off, K.SPACED), low


def features(w: K.Words, low: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words `first`: trigram buckets, where each word's begin, and scripts."""
    size = w.end[first] - w.start[first]
    raw, off = K.gather(low, w.start[first], size, pad=1)
    wide = raw.astype(np.uint32)
    tri = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(raw) > 2 else np.zeros(0, np.uint32)
    bucket = (tri * np.uint32(2654435761)) >> np.uint32(16)
    inner = np.ones(len(raw), bool)
    inner[off[1:] - 1] = inner[off[1:] - 2] = False  # a trigram for each byte of the word, centred on it
    begin = np.concatenate([[0], np.cumsum(size)])
    script = np.full(len(first), LATIN, np.int64)
    at, _, cp = K.code_points(raw)
    if len(at):
        owner = np.searchsorted(off, at, "right") - 1
        s = _SCRIPT[np.searchsorted(_FIRST, cp, "right") - 1]
        foreign = s != LATIN
        script[owner[foreign][::-1]] = s[foreign][::-1]  # the first that is not Latin
    return bucket[inner[: len(bucket)]], begin, script


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, learn: Column | None = None) -> Model:
    """Learn from rows with a language for which `learn` holds (all but the held-out third, unless given)."""
    bounded_batches(docs.sparkSession)
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # of each language as many rows as fit_rows allows, by a 62-bit hash, so that none gets lost at any size
    bounds = F.create_map(*[F.lit(x) for lang, n in have.items() for x in (lang, min(1 << 62, (fit_rows << 62) // n))]) if have else F.create_map(F.lit(""), F.lit(0))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) < F.element_at(bounds, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, off = K.utf8(batch.column(1))
            for i, j in K.blocks(off):
                own = off[i : j + 1] - off[i]
                w, low = words(data[off[i] : off[j]], own)
                if not len(w.start):
                    continue
                bucket, begin, script = features(w, low, np.arange(len(w.start)))
                doc = w.doc()
                names, code = np.unique(langs[i:j], return_inverse=True)
                of = code[doc]
                for k, lang in enumerate(names):
                    n = total.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    mine = of == k
                    n[:BUCKETS] += np.bincount(bucket[np.repeat(mine, np.diff(begin))], minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(script[mine], minlength=len(NAMES))
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    n = np.zeros((BUCKETS + len(NAMES), len(languages)))
    n[counts.column("bucket").to_numpy(), [languages.index(x) for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    tri, use = n[:BUCKETS], n[BUCKETS:]
    scores = np.log((tri + 0.5) / (tri.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(languages, scores, use >= 0.05 * use.sum(0))


def word_scores(model: Model, w: K.Words, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[word, language] log scores, candidates of the word's script only; whether it has any candidate."""
    code, first = K.distinct(w.hash)
    bucket, begin, script = features(w, low, first)
    total = np.zeros((len(bucket) + 1, len(model.languages)), np.float64)
    np.cumsum(model.scores[bucket], axis=0, dtype=np.float64, out=total[1:])
    s = total[begin[1:]] - total[begin[:-1]]
    may = model.uses[script]
    known = may.any(1)
    s = np.where(may, s, s.min(1, keepdims=True) - 20.0)
    s[~known] = 0.0
    s -= s.max(1, keepdims=True)
    return s[code], known[code]


def viterbi(s: np.ndarray, off: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: the sum of scores less the penalty at each change within a document."""
    n, k = s.shape
    label = np.zeros(n, np.int64)
    docs = np.flatnonzero(np.diff(off) > 0)
    if k < 2 or not len(docs):
        return label
    begin, size = off[docs], np.diff(off)[docs]
    best = np.add.reduceat(s, begin, axis=0).argmax(1)
    label[:] = np.repeat(best, size)
    # j runs of other labels cost at least j - 1 penalties (j, if the best label keeps a word), so where no run
    # gains over half a penalty by any other label, no change can pay and the constant path is best.
    hard = np.zeros(len(docs), bool)
    flat = s[np.arange(n), label]
    far = 2.0 * float(np.abs(s).sum(0).max()) + 1.0  # sets each document below the one before
    lower = np.repeat(np.arange(len(docs)) * far, size)
    for other in range(k):
        gain = np.cumsum(s[:, other] - flat)
        before = gain - (s[:, other] - flat)
        base = np.repeat(before[begin], size)
        low = np.minimum.accumulate(before - base - lower)
        hard |= np.maximum.reduceat(gain - base - lower - low, begin) > penalty / 2
    todo = np.flatnonzero(hard)
    if len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]
        _paths(s, begin[todo], size[todo], penalty, label)
    return label


def _paths(s: np.ndarray, begin: np.ndarray, size: np.ndarray, penalty: float, label: np.ndarray) -> None:
    """Viterbi over many documents at once, longest first; sets label."""
    k = s.shape[1]
    own = np.concatenate([[0], np.cumsum(size)])
    left = np.zeros((own[-1], k), bool)
    origin = np.zeros(own[-1], np.int16)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # documents of at least t words
    v = s[begin].copy()
    end = np.zeros((len(begin), k))
    for t in range(1, size[0]):
        a = alive[t]
        if a < len(v):
            end[a : len(v)] = v[a:]
            v = v[:a]
        m = v.argmax(1)
        jump = v[np.arange(a), m] - penalty
        switch = jump[:, None] > v
        v = np.where(switch, jump[:, None], v) + s[begin[:a] + t]
        left[own[:a] + t] = switch
        origin[own[:a] + t] = m
    end[: len(v)] = v
    state = end.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        a = alive[t]
        label[begin[:a] + t] = state[:a]
        moved = left[own[:a] + t, state[:a]]
        state[:a] = np.where(moved, origin[own[:a] + t], state[:a])


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """docs' rows with lang_pred and score, and with spans: array<struct<start,end,lang>> over the text's bytes. These replace columns of their names."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", *["spans"] * spans)
    names = docs.columns
    span = "array<struct<start:long,end:long,lang:string>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double" + f", spans {span}" * spans

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            data, off = K.utf8(batch.column(names.index("text")))
            for i, j in K.blocks(off):
                own = off[i : j + 1] - off[i]
                pred, score, runs = _label(m, data[off[i] : off[j]], own, penalty, spans)
                extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    extra.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *extra], [*names, "lang_pred", "score", *["spans"] * spans])

    return docs.mapInArrow(label, schema)


def _label(m: Model, data: np.ndarray, off: np.ndarray, penalty: float, spans: bool) -> tuple[list, np.ndarray, list]:
    docs = len(off) - 1
    score = np.zeros(docs)
    pred: list = [UNKNOWN] * docs
    runs: list = [[] for _ in range(docs)]
    w, low = words(data, off)
    if not len(w.start) or not m.languages:
        return pred, score, runs
    s, known = word_scores(m, w, low)
    path = viterbi(s, w.off, penalty)
    size = (w.end - w.start).astype(float)
    doc = w.doc()
    k = len(m.languages)
    mass = np.bincount(doc * k + path, size * known, docs * k).reshape(docs, k)
    total = np.bincount(doc, size, docs)
    best = mass.argmax(1)
    some = total > 0
    score[some] = mass[np.arange(docs), best][some] / total[some]
    pred = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
    if spans:
        change = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]))
        for a, b in zip(change, np.concatenate([change[1:], [len(path)]]), strict=True):
            d = doc[a]
            runs[d].append({"start": int(w.start[a] - off[d]), "end": int(w.end[b - 1] - off[d]), "lang": m.languages[path[a]]})
    return pred, score, runs


def digest(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those in no known language: none at all, or for under a fifth of their letters."""
    columns = docs.columns
    rest = [c for c in columns if c != "text"]
    found = predict(docs.select("text", F.struct(*rest).alias("_rest")), fit(docs))
    back = [F.col("text") if c == "text" else F.col(f"_rest.{c}") for c in columns]
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.2)).select(*back)
