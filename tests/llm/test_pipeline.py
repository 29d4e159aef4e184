"""Each stage of the pipeline against plain code, on what the stage before it kept."""

import corpus_pipeline
from test_exact_and_packing import brute_dedup
from test_models import near_brute

from larkspur.llm import conflictpack, decontaminate, langid
from larkspur.llm.store import written

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], SF), name))
        kept[name] = steps[-1]
        if name != "best_fit_packing":
            assert steps[-1].columns == docs.columns
    known = {r.doc_id for r in langid.predict(docs, langid.fit(docs)).collect() if r.lang_pred != "und" and r.score >= 0.2}
    rows = [x for x in texts(docs) if x[0] in known]
    assert texts(kept["language_id"]) == rows
    stays = {r[0] for r in brute_dedup(rows) if r[3]}
    rows = [x for x in rows if x[0] in stays]
    assert texts(kept["exact_dedup"]) == rows
    stays = {r[0] for r in near_brute(rows, 5, 80) if r[3]}
    rows = [x for x in rows if x[0] in stays]
    assert texts(kept["near_dedup"]) == rows
    bad = [r[-1] for r in decontaminate.brute(bench, [t for _, t in rows])]
    rows = [x for x, b in zip(rows, bad, strict=True) if not b]
    assert rows and texts(kept["decontaminate"]) == rows
    size = {r.doc_id: r.n for r in docs.select("doc_id", conflictpack.words().alias("n")).collect()}
    bins = kept["best_fit_packing"].collect()
    got = {}
    for r in bins:
        assert sum(r.sizes) == r.used <= r.capacity
        known = [s for s in r.sources if s is not None]
        assert len(known) == len(set(known))
        for d, n in zip(r.doc_ids, r.sizes, strict=True):
            got[d] = got.get(d, 0) + n
    assert got == {d: size[d] for d, _ in rows if size[d]}
