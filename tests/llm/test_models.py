import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import docs, empty, odd
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm import langid, licences, minhash, suffixtree, tokenpack, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def buffers(texts):
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])])


def test_viterbi_finds_the_best_path():
    r = random.Random(3)
    for _ in range(60):
        k = r.randint(2, 4)
        off = np.concatenate([[0], np.cumsum([r.randint(0, 6) for _ in range(5)])])
        s = -np.random.default_rng(r.randint(0, 10**9)).random((off[-1], k)) * 10
        label = langid.viterbi(s, off, 3.0)
        for a, b in zip(off, off[1:]):
            if a < b:
                value = lambda p: sum(s[a + i, x] for i, x in enumerate(p)) - 3.0 * sum(p[i] != p[i - 1] for i in range(1, len(p)))  # noqa: B023, E731
                assert abs(value(label[a:b].tolist()) - max(map(value, itertools.product(range(k), repeat=b - a)))) < 1e-9


def test_language_held_out_and_odd(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    rows = {r.doc_id: r for r in langid.digest(odd(spark)).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[7].lang_pred == "und" and rows[3].score == 0
    assert langid.accepted(odd(spark)).columns == odd(spark).columns
    assert langid.digest(empty(spark)).count() == 0


def test_encoder_equals_the_tokenizer():
    import tiktoken

    vocabulary = tokenpack.ranks()
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    whole = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
    r = random.Random(2)
    parts = ["a", "b", "'", "s", "t", "re", "ve", " ", "  ", "\n", "\t", "1", "²", "é", "漢", ".", "🙂", "'s", " 's", "́", "\x1c", " ", "'LL"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    data, off = buffers(texts)
    e = tokenpack.Encoder(vocabulary)
    out, at = e.encode(data, off)
    assert all(out[a : b - 1].tolist() == whole.encode_ordinary(t) and out[b - 1] == e.end for t, a, b in zip(texts, at, at[1:]))


def test_token_packing_round_trip(spark):
    import tiktoken

    texts = ["one two three " * 500, "short", "", None, "é漢🙂 " * 90]
    rows = tokenpack.packed(docs(spark, texts), capacity=256).collect()
    whole = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=tokenpack.ranks(), special_tokens={})
    ids = tokenpack.unpack(rows)
    assert {d: whole.decode(x[:-1].tolist()) for d, x in ids.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(len(r.ids) == 512 for r in rows)
    for r in rows:
        at = tokenpack.positions(r.cu_seqlens, 256)
        assert list(r.resets) == np.flatnonzero(at == 0)[: len(r.resets)].tolist() and r.cu_seqlens[-1] in (*r.resets, 256)
    assert tokenpack.positions([0, 2, 5], 6).tolist() == [0, 1, 0, 1, 2, 0]
    assert sum(len(r.doc_ids) for r in tokenpack.packed(odd(spark)).collect()) >= 10
    assert tokenpack.packed(empty(spark)).count() == 0


def test_best_fit_decreasing_is_tight():
    r = random.Random(4)
    for _ in range(30):
        cap = r.randint(5, 40)
        sizes = [r.randint(1, cap) for _ in range(80)]
        left = []
        for k in sorted(sizes, reverse=True):
            fit = [x for x in left if x >= k]
            if fit:
                left.remove(min(fit))
            left.append((min(fit) if fit else cap) - k)
        assert sorted(cap - sum(sizes[k] for k in row) for row in tokenpack.best_fit_decreasing(sizes, cap)) == sorted(left)


def near_brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        ws = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_matches_brute_force(spark, size, percent):
    r = random.Random(size)
    base = [[f"w{r.randint(0, 400)}" for _ in range(120)] for _ in range(4)]
    texts = ["", None, "one", "One", "a b", "A  b"]
    for b in base:
        for _ in range(25):
            t = list(b)
            for _ in range(r.randint(0, 7)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 10**6)}"
            texts.append(" ".join(t[: r.randint(100, 120)]))
    got = sorted(map(tuple, minhash.components(docs(spark, texts), size=size, percent=percent).collect()))
    assert got == near_brute(list(enumerate(texts)), size, percent)


def test_near_dedup_odd(spark):
    got = {(r.doc_id, r.component_id) for r in minhash.digest(odd(spark)).collect()}
    assert (2, 1) in got and (3, 3) in got and (4, 4) in got
    assert minhash.deduplicated(odd(spark)).columns == odd(spark).columns
    assert minhash.digest(empty(spark)).count() == 0


def test_near_dedup_tells_rows_of_one_id_or_none_apart(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    texts = [a, a + " tail", b, "only here", a, "and here", "and here", None, b + " end", "last one"]
    ids = [1, 2, 2, 2, None, None, None, None, 9, 9]
    left = sorted((r.text or "") for r in minhash.deduplicated(docs(spark, texts, ids)).collect())
    assert [t[:8] for t in left] in (sorted([a[:8], b[:8], "only her", "and here", "", "last one"]),)


@pytest.mark.parametrize("head", [1_000_000, 20])
def test_suffix_tree_baseline_is_exact(spark, head):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(90001, None), (90002, "")], "doc_id long, text string"))
    words = {r.doc_id: SPACED.findall((r.text or "").translate(LOW)) for r in d.collect()}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for r in suffixtree.scores(d, head=head).collect():
        ws = words[r.doc_id]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(want, rel=1e-9) and (r.n_tokens, r.train_tokens) == (len(ws) + 1, n)
        assert r.n_known == sum(w in c for w in ws) + 1 and r.score < 0


def test_suffix_tree_distributions_sum_to_one(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = suffixtree.counts(d, 3)
    tree = suffixtree.grow(found.where("kind = 0"), 10**5, 3, 1e-4)
    contexts = np.array([ord("e") << 16 | ord("h") << 8 | ord("t"), ord("q") << 16 | ord("z") << 8 | ord("z")], np.uint64)
    for x in contexts:
        key = (x << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** suffixtree.score(tree, key)).sum() == pytest.approx(1, abs=1e-4)


def test_suffix_tree_keeps_rare_contexts_whichever_way_they_are_met(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train = d.where(~suffixtree.held_out(F.col("doc_id")))
    found = suffixtree.counts(train, suffixtree.DEPTH)
    tree = suffixtree.grow(found.where("kind = 0"), 1, suffixtree.DEPTH, 0)  # every context that was seen twice
    rows = d.orderBy("doc_id").collect()
    w, p, last = suffixtree.token_scores(tree, *buffers([r.text or "" for r in rows]))
    want = np.bincount(w.doc(), p, len(rows)) + last
    for kwargs in ({}, {"strings": 2000, "head": 500}):
        got = {r.doc_id: r.score for r in suffixtree.scores(d, **kwargs).collect()}
        assert [got[r.doc_id] for r in rows] == pytest.approx(want.tolist(), rel=1e-6)


def test_suffix_tree_alone_beats_the_baseline_on_held_out_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    r = suffixtree.scores(d).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_rare_languages_are_learned_and_unknown_scripts_rejected(spark):
    rows = [(i, "the cat and the dog went home with me", "en") for i in range(300)] + [(1000 + i, "der Hund und die Katze gehen nach Hause", "de") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, fit_rows=20).languages == ["de", "en"]
    strange = spark.createDataFrame([(5000, "漢字仮名交じり文", "en"), (5001, None, "en"), (5002, "12 34 !", "en")], df.schema)
    both = df.unionByName(strange).withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(1))
    left = langid.accepted(both)
    assert left.columns == both.columns and {r.doc_id for r in left.collect()} == {i for i, _, _ in rows}
    assert langid.predict(both, langid.fit(df)).columns.count("score") == 1


def test_toxicity_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.digest(d, l).where("held_out").join(l, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in got}
    assert share[1] > 0.7 and share[0] < 0.05


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.digest(odd(spark), labels).count() == 10
    assert toxicity.digest(empty(spark), labels).count() == 0


def test_licences(spark):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code"), ("d/x.py", "Licensed under the Apache License, Version 2.0.\ncode"), ("e/y.py", None), ("a/b/z.py", "This work is licensed under the GNU General Public License, version 3.")], "path string, text string")
    got = {r.path: (r.licence, r.origin, r.licence_dir) for r in licences.scan(files).collect()}
    assert got["a/b/c.py"] == ("GPL-3.0", "inherited", "a/b") and got["a/LICENSE"][:2] == ("MIT", "own")
    assert got["d/x.py"][0] == "Apache-2.0" and got["e/y.py"] == (None, "none", None)
    assert licences.digest(odd(spark)).count() == 10 and licences.digest(empty(spark)).count() == 0


def test_licences_in_long_and_wrapped_texts(spark):
    code = "x = 1\n" * 1000
    mpl = "# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0. If a copy of the MPL was not distributed with\n# this file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    files = [("a/x.py", mpl + code), ("b/y.txt", "some words of a story " * 40 + "licensed under the Apache License, Version 2.0 " + "and more of that story " * 400), ("c/z.py", code), ("d/w.py", " * Permission is hereby granted, free of\n * charge, to any person obtaining a copy\n * of this software\n" + code), ("a/b/v.py", code)]
    got = {r.path: (r.licence, r.origin, r.licence_dir) for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/x.py"] == ("MPL-2.0", "own", "a") and got["a/b/v.py"] == ("MPL-2.0", "inherited", "a")
    assert got["b/y.txt"][0] == "Apache-2.0" and got["d/w.py"][0] == "MIT" and got["c/z.py"] == (None, "none", None)



def test_licences_of_headings_tags_blocks_and_whole_files(spark):
    header = "/*\n * " + licences.TEXTS[3][1].replace("\n", "\n * ") + "\n */\n"
    files = [
        ("a/LICENSE", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007 a name"), ("b/x.py", "# SPDX-License-Identifier: MIT\ncode"), ("c/LICENSE", licences.TEXTS[0][1]),
        ("d/x.c", header + "int main;\n" * 3000), ("e/LICENSE", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("f/g/h.c", "int x;"), ("root", "Licensed under CC BY 4.0"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    for name in ("licence", "cosine", "part", "size", "b", "origin"):
        df = df.withColumn(name, F.lit(7))
    got = {r.path: (r.licence, r.origin, r.licence_dir, r.part) for r in licences.scan(df).collect()}
    own = {"a/LICENSE": "GPL-3.0", "b/x.py": "MIT", "c/LICENSE": "MIT", "d/x.c": "Apache-2.0", "e/LICENSE": "LGPL-3.0", "root": "CC-BY-4.0"}
    assert got == {p: (x, "own", p.rpartition("/")[0], 7) for p, x in own.items()} | {"f/g/h.c": ("CC-BY-4.0", "inherited", "", 7)}
