"""All labelled rows and all documents are learned from, however many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekeep.llm import common, pu_quality

from .conftest import SF001


@pytest.mark.parametrize("bad", [True, False])
def test_rows_beyond_the_bound_are_summed_not_left_out(spark, bad):
    docs, labels = common.load(spark, SF001, "documents"), common.load(spark, SF001, "labels")
    labels = labels if bad else labels.filter("quality <> 0")
    whole, summed = pu_quality.train(docs, labels), pu_quality.train(docs, labels, max_rows=10)
    assert whole.prior == pytest.approx(summed.prior, abs=1e-9)
    for a, b in zip(whole[:-1], summed[:-1]):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


def test_documents_of_the_unlabelled_side_are_all_learned_from(spark):
    docs, labels = common.load(spark, SF001, "documents"), common.load(spark, SF001, "labels")
    x = np.array([pu_quality.text_features(r.text) for r in docs.select("text").collect()], np.float32).astype(float)
    model = pu_quality.train(docs, labels, max_rows=30)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0)))


def test_quantiles_of_a_table_equal_those_of_an_array(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(37, 3)).astype(np.float32)
    x[5] = x[6]
    rows = spark.createDataFrame([(1, i, x[i].tobytes()) for i in range(37)], "kind int, doc_id long, x binary").repartition(3)
    known = pu_quality.LabelledRows(rows, {1: 37}, 3).placed(np.zeros(3), np.ones(3))
    w, shares = rng.normal(size=4), np.linspace(0.0, 0.9, 46)
    assert np.allclose(known.quantiles(w, shares), np.quantile(pu_quality.scaled(x.astype(float), np.zeros(3), np.ones(3)) @ w, shares))
    assert known.sums(1, lambda z: z.sum(axis=0)).shape == (4,) and rows.agg(F.count("*")).first()[0] == 37


def test_repeated_rows_count_as_often_as_they_are_there(spark):
    docs, labels = common.load(spark, SF001, "documents").limit(300), common.load(spark, SF001, "labels")
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0"))
    known = labels.filter(~pu_quality.held_out()).join(twice, "doc_id").groupBy("quality").count().collect()
    count = {r.quality: r["count"] for r in known}
    for most in (20_000, 5):
        assert pu_quality.train(twice, labels, max_rows=most).prior == pytest.approx(count[1] / (count[0] + count[1]))
