import hashlib
import re
from collections import defaultdict

from helpers import docs, empty, odd

from larkspur.llm import conflictpack, exactdedup


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_dedup(pairs):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(pairs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for norm, members in groups.items():
        first = min(members)
        out += [(m[4], first[4], len(members), m == first, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(spark):
    texts = ["a b", "ab", "a  b", None, "", " ", "x" * 300 + "y", "x" * 300 + "z", "x" * 300 + "y", "é", "é", " ab"]
    for kwargs in ({}, {"most_pairs": 0}):
        got = exactdedup.decide(docs(spark, texts), digest=True, **kwargs)
        assert sorted(rows(got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")), key=str) == brute_dedup(list(enumerate(texts)))


def test_exact_dedup_odd_rows(spark):
    df = odd(spark)
    got = exactdedup.digest(df)
    want = brute_dedup([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(rows(got), key=str) == want
    left = exactdedup.deduplicated(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(w[0]) for w in want if w[3])
    assert rows(exactdedup.digest(empty(spark))) == []
    assert rows(exactdedup.deduplicated(empty(spark))) == []


def test_exact_dedup_settles_rows_of_repeated_ids(spark):
    texts = ["three", "th ree", "only here", "t h ree", "here too", "seven", "s even", "eight", "eig ht", "eight and more", "eight"]
    ids = [3, None, None, None, None, 7, 8, 8, 9, 9, 10]
    df = docs(spark, texts, ids)
    got = sorted(((r.doc_id, r.text) for r in exactdedup.deduplicated(df).collect()), key=str)
    want = brute_dedup(list(zip(ids, texts)))
    assert sorted(str(d) for d, _ in got) == sorted(str(w[0]) for w in want if w[3])
    assert got == sorted([(None, "t h ree"), (None, "only here"), (None, "here too"), (8, "s even"), (9, "eig ht"), (9, "eight and more")], key=str)


def test_exact_dedup_keeps_every_distinct_text_once(spark):
    for texts, ids in ((["x", "unique text", "x "], [1, 1, 2]), (["x", "z", "z", "x "], [1, 1, 1, 2]), (["x", "one", "x", "two", "two"], [3, None, None, None, None])):
        df = docs(spark, texts, ids)
        for most in (2_000_000, 0):
            left = [re.sub(r"\s", "", r.text) for r in exactdedup.deduplicated(df, most).collect()]
            assert sorted(left) == sorted({re.sub(r"\s", "", t) for t in texts})


def brute_best_fit(pieces, capacity):
    bins = []
    for k in sorted(range(len(pieces)), key=lambda k: -pieces[k][0]):
        size, s, c = pieces[k]
        fit = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and not b["s"] & s and not b["c"] & c]
        if fit:
            b = bins[min(fit)[1]]
        else:
            bins.append(b := {"room": capacity, "s": 0, "c": 0, "m": []})
        b["room"] -= size
        b["s"] |= s
        b["c"] |= c
        b["m"].append(k)
    return [b["m"] for b in bins]


def test_pack_takes_the_tightest_compatible_bin():
    import random

    r = random.Random(5)
    for _ in range(40):
        pieces = [(r.randint(1, 20), 1 << r.randint(0, 4) if r.random() < 0.8 else 0, 1 << r.randint(0, 9) if r.random() < 0.4 else 0) for _ in range(60)]
        assert conflictpack.pack(pieces, 20) == brute_best_fit(pieces, 20)


def test_packing_is_lossless_and_keeps_conflicts_apart(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (5000, 10, 10, 700, 2048, 2049, 0)] + ["twin text"] * 3
    df = docs(spark, texts, source=None)
    got = conflictpack.packed(df, capacity=1000).collect()
    total = defaultdict(int)
    for b in got:
        assert b.used == sum(b.sizes) <= b.capacity
        assert list(b.starts) == [sum(b.sizes[:i]) for i in range(len(b.sizes))]
        for d, n in zip(b.doc_ids, b.sizes):
            total[d] += n
        assert len({7, 8, 9} & set(b.doc_ids)) <= 1
    assert dict(total) == {i: len(t.split()) for i, t in enumerate(texts) if t}
    one = conflictpack.packed(docs(spark, ["a b c"] * 5, source="hot")).collect()
    assert sorted(len(b.doc_ids) for b in one) == [1] * 5


def test_packing_odd_rows(spark):
    got = conflictpack.packed(odd(spark)).collect()
    assert sum(len([d for d, p in zip(b.doc_ids, b.parts) if p == 0]) for b in got) == 7
    assert sum(b.doc_ids.count(None) for b in got) == 1
    assert rows(conflictpack.packed(empty(spark))) == []
