"""Held-out accuracy, and odd inputs."""

import numpy as np
import pytest

from tidemark.llm import classifier, q_quality


def test_held_out_accuracy(spark):
    got = q_quality.op2_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 500 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([x >= 0.3 for x in good]) > 0.97 and np.mean([x < 0.3 for x in bad]) > 0.8
    assert np.mean([a > b for a in good for b in bad]) > 0.97


@pytest.mark.parametrize("labelled", [0, 1, 40])
def test_odd_inputs(spark, labelled):
    rows = [(i, f"word{i % 7} and some more {i} !!" if i % 2 else f"### {i} $$$ ###") for i in range(40)] + [(100, None), (101, ""), (102, "é" * 30_000), (None, "x")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(labelled)] + [(100, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in docs.select("doc_id", model.score(docs.text).alias("score")).collect()}
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in got.values())
    if labelled == 40:
        assert got[1] > 0.5 > got[2]
    again = classifier.fit(docs.repartition(3), labels.repartition(2))
    assert docs.select(again.score(docs.text)).count() == len(rows)
    assert docs.limit(0).select(model.score(docs.text)).count() == 0


def test_temperature_calibrates():
    rnd = np.random.default_rng(1)
    x = rnd.normal(0, 1, (4000, 5)).astype(np.float32)
    y = (rnd.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = classifier.train(x, y)
    score = net.scores(x[np.arange(4000) % 10 == 9])
    assert abs(score.mean() - y[np.arange(4000) % 10 == 9].mean()) < 0.06
