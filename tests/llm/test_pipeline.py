"""The pipeline against its stages done by brute force."""

from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from tablekeep.llm import common, mixing, pu_quality

from .conftest import make_docs
from .test_copies import brute_components, brute_fingerprint, brute_lines


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.load(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = pu_quality.train(docs, common.load(spark, sf, "labels"))
    rows = {i: t for i, t in rows.items() if model.score(pd.DataFrame([pu_quality.text_features(t)]).to_numpy("float32").astype(float))[0] >= 0.3}
    gone = brute_lines(list(rows.items()))
    rows = {i: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone.get((i, t), [])) for i, t in rows.items()}
    ids = sorted(rows)
    fps = [brute_fingerprint(rows[i]) for i in ids]
    root = brute_components(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    rows = {ids[r]: rows[ids[r]] for r in set(root)}
    items = [r.text for r in common.load(spark, sf, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if not any(x in t for x in items)}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(rows), "text": list(rows.values()), "source": [source[i] for i in rows]}))
    want = Counter(con.execute(mixing.taken_sql()).fetchall())
    got = corpus_pipeline.run(spark, sf).select("doc_id", "size", "source_size", "target", "taken")
    assert Counter(map(tuple, got.collect())) == want


def test_stages_return_documents(spark, edge, empty):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for docs in (edge, empty, make_docs(spark, [(1, None), (None, None), (1, None), (2, "")])):
        for n, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = common.stage(step(spark, docs, sf), "test-stage")
            if n < 4:
                assert out.columns == docs.columns
                docs = out
        assert out.filter(F.col("taken") > 2 * F.col("size")).count() == 0
