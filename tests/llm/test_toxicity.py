"""The toxicity model against plain dictionaries."""

import collections
import math
import random
import re

import pytest
from test_models import LOW, buffers

from larkspur.llm import toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def own(n):
    """Discounted shares by class of the entries that the classes differ in; n: entry to its two counts."""
    size = [sum(x[c] for x in n.values()) for c in (0, 1)]
    d = []
    for c in (0, 1):
        one, two = (sum(x[c] == k for x in n.values()) for k in (1, 2))
        d.append(min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5)
    out = {}
    for key, x in n.items():
        total = sum(x)
        g = 2 * sum(x[c] * math.log(x[c] * sum(size) / (total * size[c])) for c in (0, 1) if x[c])
        ratio = (x[1] + 0.5) * size[0] / ((x[0] + 0.5) * size[1])
        if total >= 4 and g >= 9 and not 0.25 <= ratio <= 4:
            out[key] = [max(x[c] - d[c], 0) for c in (0, 1)]
    return out, size, d


def brute(train, texts):
    """Evidence of each text, by the definition."""
    # the pair before a text's second word holds the text's beginning
    triples = set()
    for c, t in train:
        ws = WORD.findall(t.translate(LOW))
        for i, w in enumerate(ws):
            before = "^" if i < 1 else ws[i - 1]
            first = ("^",) if i < 1 else (("^" if i < 2 else ws[i - 2]), ws[i - 1])
            triples.add((c, first, before, w))
    pairs, words, stems = (collections.defaultdict(lambda: [0, 0]) for _ in range(3))
    for c, _, b, w in triples:
        pairs[b, w][c] += 1
    stem_of = lambda w: w.encode()[: toxicity.STEM]
    for (_, w), n in pairs.items():
        for c in (0, 1):
            words[w][c] += n[c] > 0
            stems[stem_of(w)][c] += n[c] > 0
    both = {w: sum(n) for w, n in words.items()}
    one, two = (sum(x == k for x in both.values()) for k in (1, 2))
    d = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    size = sum(both.values())
    uniform = d * len(both) / size / (len(both) + 1)
    own_stem, stem_size, _ = own(stems)
    own_word, word_size, _ = own(words)
    own_pair, _, _ = own(pairs)
    kinds = collections.Counter(stem_of(w) for w in words)
    follows = collections.defaultdict(lambda: [0, 0])
    for (b, _), n in pairs.items():
        for c in (0, 1):
            follows[b][c] += n[c]

    def p(b, w, c):
        rest_stem = 1 - sum(x[c] for x in own_stem.values()) / stem_size[c]
        rest_word = 1 - sum(x[c] for x in own_word.values()) / word_size[c]
        low = rest_stem * ((both[w] - d) / size + uniform if w in both else uniform)
        if stem_of(w) in own_stem:
            low += own_stem[stem_of(w)][c] / stem_size[c] / (kinds[stem_of(w)] + 1)
        one = rest_word * low + (own_word[w][c] / word_size[c] if w in own_word else 0)
        f = max(follows[b][c], 1)
        listed = sum(x[c] for (v, _), x in own_pair.items() if v == b) / f
        return (own_pair[b, w][c] / f if (b, w) in own_pair else 0) + (1 - listed) * one

    out = []
    for t in texts:
        ws = WORD.findall(t.translate(LOW))
        gain = [math.log(p(b, w, 1) / p(b, w, 0)) for b, w in zip(["^", *ws], ws)]
        out.append(sum(gain) / len(gain) if gain else 0.0)
    return out


def test_evidence_matches_brute_force(spark):
    r = random.Random(4)
    ordinary = [f"w{k}" for k in range(60)]
    rude = ["vile1", "vilest", "grim scum", "scum"]
    train = [(c, " ".join(r.choice(rude) if c and r.random() < 0.2 else r.choice(ordinary) for _ in range(r.randint(0, 60)))) for c in [0, 1] * 40]
    df = spark.createDataFrame([(t, c) for c, t in train], "text string, toxic int")
    model = toxicity.interpolated(toxicity._counts(df))
    assert len(model.stem) and len(model.pair)
    texts = [t for _, t in train] + ["", "w1 scum unknown vile9 w2", "Nothing known", "É w3 vile1 vile1"]
    assert toxicity.evidence(model, *buffers(texts)).tolist() == pytest.approx(brute(train, texts), abs=1e-9)


def test_planted_expressions_are_found_and_ordinary_texts_left_alone(spark):
    r = random.Random(9)
    text = lambda bad: " ".join("horrid" if bad and r.random() < 0.1 else f"w{r.randint(0, 300)}" for _ in range(80))
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.digest(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    truth = {i: y for i, _, y in rows}
    held = [(truth[x.doc_id], x.predicted) for x in got if x.held_out]
    assert sum(y and p for y, p in held) >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.02 * len(held)
