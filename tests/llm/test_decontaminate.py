import random

import numpy as np
from helpers import docs, empty, odd

from larkspur.llm import decontaminate as D
from larkspur.llm import kernel as K


def bench(spark, pairs):
    return spark.createDataFrame(pairs, "item_id long, text string")


def material(seed=3):
    r = random.Random(seed)
    vocabulary = ["Alpha", "béta", "g4mma", "d", "漢字", "zz-top", "o'clock"]
    item = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(10, item(20)), (2, item(13)), (3, item(4)), (4, "..."), (5, None), (6, ""), (7, item(1) + "x"), (2, item(15))]
    texts = [item(60) + " " + items[k % 8][1][:80] + "\n" + item(9) if items[k % 8][1] else item(30) for k in range(40)] + ["", None, "?!", item(5), items[0][1].upper()]
    return items, texts


def test_matches_brute_force_on_both_paths(spark):
    items, texts = material()
    want = [(i, *x) for i, x in enumerate(D.brute(items, texts))]
    df, b = docs(spark, texts), bench(spark, items)
    assert sorted(map(tuple, D.digest(df, b).collect())) == want
    for bound in (4_000_000, 0):
        got = D.hits(df, b, most_words=bound).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got) == [w[:4] for w in want]


def test_spans_cut_the_hit_passages(spark):
    passage = " ".join(f"unique{i}" for i in range(13))
    df = docs(spark, ["before " + passage.upper() + " after", "clean text", None])
    b = bench(spark, [(1, passage)])
    left = {r.doc_id: r.text for r in D.removed(df, b, spans=True).collect()}
    assert left == {0: "before  after", 1: "clean text", 2: None}
    assert sorted(r.doc_id for r in D.removed(df, b).collect()) == [1, 2]


def test_odd_rows(spark):
    b = bench(spark, [(1, "same text here"), (None, "word"), (2, "漢字")])
    got = {(r.doc_id, r.n_words, r.n_hit) for r in D.digest(odd(spark), b).collect()}
    assert (1, 3, 3) in got and (3, 0, 0) in got and (5, 30000, 30000) in got and (8, 5, 1) in got
    assert {r.n_items for r in D.digest(odd(spark), b).where("doc_id = 5").collect()} == {0}  # hit by the item without an id
    assert D.digest(odd(spark), bench(spark, [])).where("contaminated").count() == 0
    assert D.digest(empty(spark), b).count() == 0
    assert D.removed(odd(spark), b).columns == odd(spark).columns


def test_words_do_not_depend_on_segments():
    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n") for _ in range(r.randint(0, 50))) for _ in range(200)] + ["x" * 400, "", "y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = K.Words(data, off, K.SPACED)
    old, K.SEGMENT = K.SEGMENT, 37
    try:
        cut = K.Words(data, off, K.SPACED)
    finally:
        K.SEGMENT = old
    assert [bytes(data[s:e]).decode() for s, e in zip(whole.start, whole.end)] == [w for t in texts for w in t.split()]
    assert (whole.start == cut.start).all() and (whole.end == cut.end).all() and (whole.hash == cut.hash).all() and (whole.off == cut.off).all()
    by = {}
    for h, s, e in zip(whole.hash.tolist(), whole.start, whole.end):
        assert by.setdefault(bytes(data[s:e]), h) == h
    assert len(set(by.values())) == len(by)
