"""Dense vectors tile by tile, against a plain loop."""

import numpy as np

from larkspur.operators import dense
from larkspur.operators.graph import connected_components


def _rows():
    rng = np.random.default_rng(5)
    rows = [(int(k), int(k % 2), [float(x) for x in rng.normal(size=6)]) for k in rng.permutation(90)]
    return rows + [(100, 0, [0.0] * 6), (101, 0, None), (102, 0, []), (103, None, [1.0] * 6), (104, 1, [1.0, None, 2.0]), (105, 1, [1.0, 0.0, 2.0, 0.0]), (105, 1, [1.0, 0.0, 2.0])]


def _plain(rows, most):
    out = {}
    for a, la, x in rows:
        for b, lb, y in rows:
            if la is None or la != lb or a >= b or not x or not y:
                continue
            s = lambda p, q: sum(float(u or 0) * float(v or 0) for u, v in zip(p, q, strict=False))
            norm = (s(x, x) ** 0.5) * (s(y, y) ** 0.5)
            if norm and (d := round(1 - s(x, y) / norm, 6)) <= most:
                out.setdefault((a, b), []).append(d)
    return sorted((a, b, d) for (a, b), ds in out.items() for d in ds)


def test_tiles_give_all_pairs_and_links_all_components(spark, monkeypatch):
    """A vector of length 0 is near nothing, and is no error; tiles of any size give the same."""
    rows = _rows()
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    rows = [(a, b, None if c is None else [None if x is None else float(np.float32(x)) for x in c]) for a, b, c in rows]
    want = _plain(rows, 0.4)
    assert len(want) > 20
    for tile in (2048, 7):
        monkeypatch.setattr(dense, "TILE", tile)
        monkeypatch.setattr(dense, "ROWS", 5)
        assert sorted(map(tuple, dense.pairs(v, 0.4).collect())) == want
        links = dense.links(v, 0.4)
        name = {r.node: r.component for r in connected_components(links).collect()}
        assert name == {r.node: r.component for r in connected_components(spark.createDataFrame(want, "a long, b long, distance double")).collect()}
    one = spark.range(3000).selectExpr("id AS vec_id", "1 AS label", "array(1.0D, 2.0D) AS embedding")
    monkeypatch.setattr(dense, "TILE", 2048)
    assert dense.links(one, 0.1).count() < 3 * 3000  # not the 4.5 million pairs


def test_limit_is_of_the_rounded_distance():
    assert dense.below(0.75, 6) == 0.7500005 and dense.below(1, 2) == 1.005
