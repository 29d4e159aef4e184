import random

import numpy as np
import pytest
from helpers import docs, empty, odd

from larkspur.llm import suffixdedup as S


def material(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 25)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 60)
            parts += [p[a : a + r.randint(40, 120)], " ".join(word() for _ in range(r.randint(0, 9)))]
        out.append("".join(parts))
    return [*out, "x" * 300, "x" * 200, "ab" * 100, "ab" * 60 + "c", "", None, out[3], out[3], out[5] + "!"]


@pytest.mark.parametrize("kwargs", [{}, {"chunk": 2000, "per_bucket": 3000}, {"chunk": 2000, "per_bucket": 3000, "hot": 2}, {"hot": 1}])
def test_matches_brute_force(spark, kwargs):
    texts = material(7)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = S.removed(docs(spark, texts, ids), **kwargs).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(S.brute(list(zip(ids, texts))))


def test_odd_rows(spark):
    df = odd(spark)
    got = sorted((tuple(r)[:5] for r in S.digest(df).collect()), key=str)
    assert got == sorted(S.brute([(r.doc_id, r.text) for r in df.collect()]), key=str)
    assert S.digest(empty(spark)).count() == 0


def test_kept_text_and_spans(spark):
    p = "a passage that is certainly longer than fifty bytes, repeated here"
    got = {r.doc_id: r for r in S.removed(docs(spark, ["one " + p, "two " + p + " end"]), text=True).collect()}
    assert bytes(got[0].kept_text).decode() == "one " + p
    assert bytes(got[1].kept_text).decode() == "two end"[:3] + " end" and [tuple(s) for s in got[1].spans] == [(3, 4 + len(p))]


def test_rows_that_repeat_are_worked_on_once_and_told_each(spark):
    a, b = "passage " * 12, "another one of some length, which stands here and there too"
    rows = [(1, a)] * 30 + [(2, a + b), (None, b), (None, b), (None, a + "x"), (1, b), (3, b)]
    got = sorted(map(str, map(tuple, S.digest(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())))
    assert got == sorted(map(str, S.brute(rows)))


def test_refine_groups_by_equal_bytes():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 2, (300, 21), dtype=np.uint8)
    start = rng.integers(0, 3, 300)
    for depth, group in S.refine(start, raw):
        same = [tuple([g, *r[:depth]]) for g, r in zip(start.tolist(), raw.tolist())]
        assert len({(x, y) for x, y in zip(same, group.tolist())}) == len(set(same)) == len(set(group.tolist()))
